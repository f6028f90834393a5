"""The discovery log: appends, filters, and the statistics read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.keys import is_blank
from ratecheck.operators.master import by_number, first_per_key, insert_if_absent, part_errors
from ratecheck.schemas import LEGAL_ACTIONS


def newest_first() -> list[Column]:
    return [F.desc("discovery_date"), F.desc("id")]


def log_errors() -> Column:
    """All broken rules of a log entry."""
    return F.array_compact(F.array(
        F.when(is_blank("part_number"), "Part number must be a non-empty string"),
        F.when(~F.coalesce("action_taken", F.lit("")).isin(*LEGAL_ACTIONS),
               "Action taken must be one of: " + ", ".join(LEGAL_ACTIONS)),
        F.when(F.col("discovered_price") <= 0, "Discovered price must be positive"),
        F.when(F.col("authorized_price") <= 0, "Authorized price must be positive"),
    ))


def accepted_entries(entries: DataFrame, as_of: str, session_id: str | None = None) -> DataFrame:
    """Valid entries ready to append; a missing time is ``as_of``.

    With ``session_id`` the whole batch is stamped with it first (D2).
    """
    if session_id is not None:
        entries = entries.withColumn("processing_session_id", F.lit(session_id))
    return entries.filter(F.size(log_errors()) == 0).withColumn(
        "discovery_date", F.coalesce("discovery_date", F.lit(as_of).cast("timestamp")))


def rejected_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("errors", log_errors()).filter(F.size("errors") > 0)


def append_log(log: DataFrame, entries: DataFrame, as_of: str,
               session_id: str | None = None) -> DataFrame:
    return log.unionByName(accepted_entries(entries, as_of, session_id))


def within_days(as_of: str, days: int) -> Column:
    """Whole days back, the cutoff day included."""
    return F.to_date("discovery_date") >= F.date_sub(F.to_date(F.lit(as_of)), days)


def filter_log(log: DataFrame, as_of: str, part_number: str | None = None,
               invoice_number: str | None = None, session_id: str | None = None,
               days_back: int | None = None, limit: int | None = None) -> DataFrame:
    """Log rows by any of the filters, newest first (D3). No days or zero: no time filter."""
    out = log
    if part_number:
        out = out.filter(F.col("part_number") == part_number)
    if invoice_number:
        out = out.filter(F.col("invoice_number") == invoice_number)
    if session_id:
        out = out.filter(F.col("processing_session_id") == session_id)
    if days_back:
        out = out.filter(within_days(as_of, days_back))
    out = out.orderBy(*newest_first())
    return out.limit(limit) if limit else out


def recent_discoveries(log: DataFrame, master: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Recent log rows with the parts of that number, one row per part."""
    parts = master.select("part_number", F.col("description").alias("part_description"),
                          F.col("authorized_price").alias("current_price"))
    return log.filter(within_days(as_of, days)).join(parts, "part_number", "left").orderBy(
        *newest_first())


def window_summary(log: DataFrame, as_of: str, days_back: int = 30) -> DataFrame:
    """Totals of a time window (D5): null and empty sessions do not count."""
    recent = log.filter(within_days(as_of, days_back)) if days_back else log
    return recent.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct(F.nullif("processing_session_id", F.lit(""))).alias("sessions"),
        F.count_distinct("part_number").alias("parts_discovered"),
        F.count_if(F.col("action_taken") == "price_mismatch").alias("price_mismatches"),
    )


def window_actions(log: DataFrame, as_of: str, days_back: int = 30) -> DataFrame:
    recent = log.filter(within_days(as_of, days_back)) if days_back else log
    return recent.groupBy("action_taken").count()


def discovery_stats(log: DataFrame) -> DataFrame:
    """Totals and success rate (D6): here a null session counts as one session."""
    added = F.count_if(F.col("action_taken") == "added")
    skipped = F.count_if(F.col("action_taken") == "skipped")
    rate = added.cast("double") / F.nullif(added + skipped, F.lit(0)) * 100
    any_null = F.max(F.when(F.col("processing_session_id").isNull(), 1).otherwise(0))
    return log.agg(
        F.count(F.lit(1)).alias("total_discoveries"),
        F.count_distinct("part_number").alias("unique_parts"),
        added.alias("parts_added"), skipped.alias("parts_skipped"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
        (F.count_distinct("processing_session_id") + F.coalesce(any_null, F.lit(0)))
        .alias("active_sessions"),
    )


def _session_aggregates() -> list[Column]:
    return [
        F.count_distinct("part_number").alias("parts_discovered"),
        F.count_if(F.col("action_taken") == "added").alias("parts_added"),
        F.min("discovery_date").alias("first_seen"),
        F.max("discovery_date").alias("last_seen"),
    ]


def recent_sessions(log: DataFrame, limit: int = 10) -> DataFrame:
    """The newest sessions, each over all of its log rows."""
    return log.groupBy(F.col("processing_session_id").alias("session_id")).agg(
        *_session_aggregates()).orderBy(F.desc("last_seen"), "session_id").limit(limit)


def session_summaries(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Parts, occurrences and additions per session, or of one session."""
    chosen = log.filter(F.col("processing_session_id") == session_id) if session_id else log
    return chosen.groupBy(F.col("processing_session_id").alias("session_id")).agg(
        F.count_distinct("part_number").alias("unique_parts_discovered"),
        F.count(F.lit(1)).alias("total_occurrences"),
        F.count_if(F.col("action_taken") == "added").alias("parts_added"))


def _in_session(log: DataFrame, session_id: str | None) -> DataFrame:
    return log.filter(F.col("processing_session_id") == session_id) if session_id else log


def unknown_review(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Price statistics per part (D9). Null and zero prices are no prices."""
    price = F.when(F.col("discovered_price") != 0, F.col("discovered_price"))
    return _in_session(log, session_id).groupBy("part_number").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.coalesce(F.round(F.avg(price), 6), F.lit(0)).alias("avg_price"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        (F.max(price) - F.min(price)).alias("price_variance"),
        F.count_distinct(F.nullif("invoice_number", F.lit(""))).alias("unique_invoices"))


def review_invoices(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """The distinct invoices of every reviewed part, one row each."""
    return _in_session(log, session_id).filter(~is_blank("invoice_number")).select(
        "part_number", "invoice_number").distinct()


def review_descriptions(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """The distinct notes of every part, one row each."""
    return _in_session(log, session_id).filter(~is_blank("notes")).select(
        "part_number", "notes").distinct()


def _discovered_prices(log: DataFrame, session_id: str | None) -> DataFrame:
    found = _in_session(log, session_id).filter(F.col("action_taken") == "discovered")
    null_invoice = F.max(F.when(F.col("invoice_number").isNull(), 1).otherwise(0))
    return found.groupBy("part_number").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count("discovered_price").alias("priced"),
        F.avg("discovered_price").alias("avg_price"),
        F.min("discovered_price").alias("min_price"),
        F.max("discovered_price").alias("max_price"),
        (F.count_distinct("invoice_number") + null_invoice).alias("invoices"),
    ).filter("priced > 0")


def _four_places(c: str) -> Column:
    text = F.round(F.col(c).cast("decimal(28,10)"), 4).cast("decimal(28,4)").cast("string")
    return F.concat(F.lit("$"), text)


def session_review(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Discovered parts with price text (D10); parts never priced are left out."""
    low, high = _four_places("min_price"), _four_places("max_price")
    return _discovered_prices(log, session_id).select(
        "part_number", "occurrences",
        _four_places("avg_price").alias("avg_price"), low.alias("min_price"),
        high.alias("max_price"), "invoices",
        F.when(F.col("min_price") != F.col("max_price"), F.concat(low, F.lit(" - "), high))
        .otherwise(low).alias("price_range"))


def candidate_prices(log: DataFrame, policy: str = "avg", given=None,
                     session_id: str | None = None) -> DataFrame:
    """The price each discovered part would be authorized at."""
    choice = {
        "avg": F.round("avg_price", 4), "min": F.col("min_price"), "max": F.col("max_price"),
        "given": F.lit(given).cast("decimal(18,4)"),
    }[policy]
    return _discovered_prices(log, session_id).select(
        "part_number", choice.cast("decimal(18,4)").alias("authorized_price"))


def part_history(master: DataFrame, log: DataFrame, part_number: str | None = None) -> DataFrame:
    """Parts with their log rows, newest first; parts never logged stay.

    The log is the left side of an inner join, so a hot part number is split; parts without a
    log row are added by an anti join.
    """
    parts = master.filter(F.col("part_number") == part_number) if part_number else master
    parts = parts.select("composite_key", "part_number", "authorized_price")
    rows = log.select("part_number", "id", "action_taken", "discovered_price", "invoice_number",
                      "discovery_date")
    logged = rows.join(parts, "part_number")
    never = parts.join(rows.select("part_number").distinct(), "part_number", "left_anti")
    return logged.unionByName(never, allowMissingColumns=True).select(
        "part_number", "composite_key", "authorized_price", "id", "action_taken",
        "discovered_price", "invoice_number", "discovery_date").orderBy(
        "composite_key", *newest_first())


# ---- discovery from lines -----------------------------------------------------------


def discover_unknown(lines: DataFrame, invoices: DataFrame, master: DataFrame) -> DataFrame:
    """Lines whose part number is neither a key nor a number of the master."""
    keys = master.select(F.col("composite_key").alias("part_number"))
    numbers = by_number(master).select(F.col("lookup").alias("part_number"))
    unknown = lines.filter(~is_blank("part_number")).join(
        keys, "part_number", "left_anti").join(numbers, "part_number", "left_anti")
    return unknown.join(invoices.select("doc_id", "invoice_number", "invoice_date"),
                        "doc_id", "left").select(
        "part_number", "invoice_number", "invoice_date",
        F.col("rate").cast("decimal(18,4)").alias("discovered_price"),
        "description", "quantity", "line_number", "doc_id", "row_idx", "line_id")


def discovered_rows(contexts: DataFrame, session_id: str, as_of: str) -> DataFrame:
    """Contexts as ``discovered`` log rows."""
    return contexts.select(
        F.lit(None).cast("bigint").alias("id"), "part_number", "invoice_number", "invoice_date",
        "discovered_price", F.lit(None).cast("decimal(18,4)").alias("authorized_price"),
        F.lit("discovered").alias("action_taken"),
        F.lit(None).cast("string").alias("user_decision"),
        F.lit(as_of).cast("timestamp").alias("discovery_date"),
        F.lit(session_id).alias("processing_session_id"),
        F.col("description").alias("notes"))


def apply_decisions(unknowns: DataFrame, decisions: DataFrame, master: DataFrame,
                    as_of: str) -> DataFrame:
    """Outcome per unknown part: added, skipped or failed.

    ``unknowns`` and ``decisions`` are unique in ``composite_key``. The part columns of
    the result are those the master would get.
    """
    now = F.lit(as_of).cast("timestamp")
    joined = unknowns.join(decisions, "composite_key", "left")
    parts = joined.select(
        "composite_key", "part_number",
        F.col("decided_price").cast("decimal(18,4)").alias("authorized_price"),
        "description", "item_type", F.col("decided_category").alias("category"),
        F.lit("discovered").alias("source"),
        F.col("doc_id").alias("first_seen_invoice"),
        now.alias("created_date"), now.alias("last_updated"),
        F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("notes"), "action")
    errors = part_errors()
    wanted = F.coalesce(F.col("action") == "add_to_database_now", F.lit(False))
    return parts.withColumn(
        "outcome", F.when(~wanted, "skipped").when(F.size(errors) > 0, "failed")
        .otherwise("added"),
    ).withColumn("error", F.when(F.col("outcome") == "failed", F.array_join(errors, "; "))
                 ).drop("action")


def add_decided(master: DataFrame, decided: DataFrame) -> DataFrame:
    added = decided.filter("outcome = 'added'").select(*master.columns)
    return insert_if_absent(master, added, ["first_seen_invoice"])


def decision_log(decided: DataFrame, session_id: str, as_of: str) -> DataFrame:
    """Log rows of the added and skipped parts."""
    done = decided.filter("outcome IN ('added', 'skipped')")
    return done.select(
        "part_number", F.col("first_seen_invoice").alias("invoice_number"),
        F.when(F.col("outcome") == "added", F.col("authorized_price")).alias("authorized_price"),
        F.col("outcome").alias("action_taken"),
        F.lit(session_id).alias("processing_session_id"),
        F.lit(as_of).cast("timestamp").alias("discovery_date"))


def collect_batch(contexts: DataFrame) -> DataFrame:
    """Batch mode: every unique unknown recorded, nothing added."""
    firsts = first_per_key(contexts, ["part_number"], ["doc_id", "row_idx", "line_id"])
    return firsts.select(
        "part_number", F.lit("skipped").alias("action_taken"),
        F.lit("batch_collected").alias("user_decision"),
        F.col("discovered_price").alias("price"), "description",
        F.lit("batch_mode_no_auto_add").alias("reason"))


def retained(log: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Log rows kept by the retention rule."""
    return log.filter(within_days(as_of, days))


def removed_count(log: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    return log.agg(F.count_if(~within_days(as_of, days)).alias("removed"))
