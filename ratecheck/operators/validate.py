"""Line verdicts against the master, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.keys import composite_key, is_blank
from ratecheck.functions.text import money_text
from ratecheck.operators.master import insert_if_absent

TOLERANCE = 0.001
FIRST_LINE = ["doc_id", "row_idx", "line_id"]


def price_difference(found="discovered_price", authorized="authorized_price") -> Column:
    """Signed, positive for an overcharge."""
    return F.col(found) - F.col(authorized)


def is_price_mismatch(found="discovered_price", authorized="authorized_price",
                      tolerance: float = TOLERANCE) -> Column:
    return F.abs(price_difference(found, authorized).cast("double")) > tolerance


def line_verdicts(lines: DataFrame, master: DataFrame, tolerance: float = TOLERANCE,
                  item_type: Column | None = None, active_only: bool = False) -> DataFrame:
    """PASSED / FAILED / UNKNOWN per line.

    One left equi-join on the composite key. The master is unique in it, so a line never
    fans out and the buffered side of a key is one row however often the key is billed.
    Whether the master is broadcast is left to Spark, which measures it; a hot key on
    the line side is split by AQE. A line without a part number keeps its own key, so
    those lines spread over the shuffle too.
    """
    prices = (master.filter("is_active") if active_only else master).select(
        "composite_key", F.col("authorized_price").alias("_authorized"))
    kind = F.col("item_type") if item_type is None else item_type
    keyed = lines.withColumn("composite_key", composite_key(kind))
    joined = keyed.join(prices, "composite_key", "left")
    named = ~is_blank("part_number")
    found = F.when(named, F.col("_authorized"))
    # The tolerance is a test on binary floats, as the prices arrive as floats.
    gap = F.abs(F.col("rate").cast("double") - found.cast("double"))
    mismatch = F.concat(F.lit("Price mismatch: expected "), money_text(found, 4),
                        F.lit(", got "), money_text("rate", 4))
    status = (
        F.when(~named, "FAILED")
        .when(found.isNull(), "UNKNOWN")
        .when(F.col("rate").isNull() | (gap <= tolerance), "PASSED")
        .otherwise("FAILED")
    )
    error = (
        F.when(~named, "Missing part number")
        .when(found.isNull(), "Part not found in database")
        .when(gap > tolerance, mismatch)
    )
    return joined.select(
        *lines.columns, "composite_key",
        found.alias("database_price"),
        gap.alias("price_difference"),
        status.alias("validation_status"),
        F.array_compact(F.array(error)).alias("validation_errors"),
    )


def verdict_counts() -> list[Column]:
    """Lines by verdict, as aggregates."""
    status = F.col("validation_status")
    return [
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if(status == "PASSED").alias("passed_parts"),
        F.count_if(status == "FAILED").alias("failed_parts"),
        F.count_if(status == "UNKNOWN").alias("unknown_parts"),
    ]


def verdict_summary(verdicts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Line counts per invoice."""
    return verdicts.groupBy(by).agg(*verdict_counts())


def batch_summary(verdicts: DataFrame) -> DataFrame:
    """Counts over the whole batch."""
    per_invoice = verdict_summary(verdicts)
    return per_invoice.agg(
        F.count(F.lit(1)).alias("invoices"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("total_parts", "passed_parts", "failed_parts", "unknown_parts")],
        F.coalesce(F.sum(F.col("failed_parts") + F.col("unknown_parts")), F.lit(0))
        .alias("error_lines"),
    )


def line_amounts(verdicts: DataFrame) -> DataFrame:
    """Quantity, prices and totals as reported, for valid and for error lines.

    A total that is missing or not positive is price x quantity; the expected total of a
    valid line is its actual total.
    """
    qty = F.when(F.coalesce("quantity", F.lit(0)) == 0, 1).otherwise(F.col("quantity"))
    is_error = F.col("validation_status").isin("FAILED", "UNKNOWN")
    price = F.coalesce("rate", F.lit(0).cast("decimal(18,4)"))
    listed = F.coalesce("database_price", F.lit(0).cast("decimal(18,4)"))
    actual = F.when(F.col("total") > 0, F.col("total")).otherwise(
        (price * F.col("_qty")).cast("decimal(28,4)"))
    expected = F.when(is_error & (listed > 0),
                      (listed * F.col("_qty")).cast("decimal(28,4)")).otherwise(F.col("_actual"))
    return (
        verdicts
        .withColumn("_qty", qty)
        .withColumn("_actual", actual)
        .select(
            *verdicts.columns,
            F.col("_qty").alias("qty"),
            price.alias("actual_price"),
            F.when(is_error, listed.cast("decimal(18,4)")).otherwise(price).alias("expected_price"),
            F.col("_actual").alias("actual_total"),
            expected.alias("expected_total"),
            is_error.alias("is_error"),
        )
    )


def error_lines(verdicts: DataFrame) -> DataFrame:
    """FAILED and UNKNOWN lines with their money (E5)."""
    return line_amounts(verdicts).filter("is_error").withColumn(
        "error_text", F.array_join("validation_errors", "; ")).drop("is_error")


def item_verdicts(lines: DataFrame, master: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """PASS / FAIL for plain items, all taken as rentals."""
    verdicts = line_verdicts(lines, master, tolerance, item_type=F.lit("Rent"))
    passed = F.col("validation_status") == "PASSED"
    return verdicts.select(
        *lines.columns,
        F.when(passed, "PASS").otherwise("FAIL").alias("validation_result"),
        passed.alias("is_valid"),
        F.when(F.col("validation_status") == "UNKNOWN", "UNKNOWN_PART")
        .when(~passed, "THRESHOLD_EXCEEDED").alias("issue_type"),
        F.array_join("validation_errors", "; ").alias("notes"),
    )


# ---- unknown parts ----------------------------------------------------------------


def unknown_parts(lines: DataFrame, master: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """The first line of every part key the master lacks.

    The first line is a minimum over (document, row, line), combined before the shuffle, so a key
    billed a billion times costs one row per task. Only first lines travel and meet the master; where
    the master is small enough to be broadcast, known keys leave before lines are compared.
    The combining sorts whole lines; with ``needed``, columns behind the last needed one stay out of it.
    As ties fall to the columns in order, those before it keep the values they have without it.
    """
    if needed is not None:
        last = max(lines.columns.index(c) for c in {*needed, *FIRST_LINE, "item_type",
                                                    "description", "part_number"})
        lines = lines.select(*lines.columns[:last + 1])
    keyed = lines.filter(~is_blank("part_number")).withColumn("composite_key", composite_key())
    rest = [c for c in keyed.columns if c not in ("composite_key", *FIRST_LINE)]
    firsts = keyed.groupBy("composite_key").agg(F.min(F.struct(*FIRST_LINE, *rest)).alias("_row"))
    # Directly on the aggregate: Spark moves this lookup below it where the master can be broadcast.
    unknown = firsts.join(master.select("composite_key"), "composite_key", "left_anti")
    return unknown.select("composite_key", "_row.*").select(*keyed.columns)


def accept_first_seen(unknowns: DataFrame, as_of: str) -> DataFrame:
    """Unknown parts as new master rows priced at their first line."""
    now = F.lit(as_of).cast("timestamp")
    return unknowns.filter(F.col("rate") > 0).select(
        "composite_key", "part_number",
        F.col("rate").cast("decimal(18,4)").alias("authorized_price"),
        "description", "item_type",
        F.lit(None).cast("string").alias("category"),
        F.lit("discovered").alias("source"),
        F.col("doc_id").alias("first_seen_invoice"),
        now.alias("created_date"), now.alias("last_updated"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("string").alias("notes"),
    )


def verdicts_with_acceptance(lines: DataFrame, master: DataFrame, as_of: str,
                             tolerance: float = TOLERANCE) -> DataFrame:
    """Verdicts after every unknown part of the batch was accepted."""
    accepted = accept_first_seen(unknown_parts(lines, master, ["rate"]), as_of)
    return line_verdicts(lines, insert_if_absent(master, accepted, ["first_seen_invoice"]),
                         tolerance)


# ---- batch counters ---------------------------------------------------------------


def file_outcomes(files: DataFrame, verdicts: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row per file: ok or failed, with line counts and errors.

    ``rejects`` holds ``doc_id, error`` for documents that could not be processed; a
    rejected or line-less file fails but stays in the result.
    """
    summary = verdict_summary(verdicts)
    reasons = rejects.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("errors"), F.min("error").alias("first_error"))
    joined = files.join(summary, "doc_id", "full").join(reasons, "doc_id", "full")
    no_lines = F.col("total_parts").isNull()
    bad = F.col("errors").isNotNull() | no_lines
    zero = F.lit(0)
    return joined.select(
        "doc_id", "folder",
        (~bad).alias("success"),
        F.when(bad, zero).otherwise(F.col("total_parts")).alias("lines"),
        F.when(bad, zero).otherwise(F.col("unknown_parts")).alias("unknown_parts"),
        F.when(bad, zero).otherwise(F.col("failed_parts") + F.col("unknown_parts"))
        .alias("validation_errors"),
        F.coalesce(F.col("first_error"), F.when(no_lines, "No line items found"))
        .alias("error"),
    )


def _file_counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("success").alias("successful_files"),
        F.count_if(~F.col("success")).alias("failed_files"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("unknown_parts"), F.lit(0)).alias("total_unknown_parts"),
        F.coalesce(F.sum("validation_errors"), F.lit(0)).alias("total_errors"),
    ]


def batch_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*_file_counters())


def folder_statistics(outcomes: DataFrame, continue_on_error: bool = True) -> DataFrame:
    """Counters per folder (E9). The strict form refuses a batch with any failed file."""
    if not continue_on_error:
        failed = outcomes.filter(~F.col("success")).select("doc_id", "error").head(1)
        if failed:
            raise ValueError(f"{failed[0].doc_id}: {failed[0].error}")
    return outcomes.groupBy("folder").agg(*_file_counters())


def folder_errors(outcomes: DataFrame) -> DataFrame:
    """The failed files of each folder, one row each."""
    return outcomes.filter(~F.col("success")).select("folder", "doc_id", "error")


def unknown_parts_by_folder(lines: DataFrame, files: DataFrame, master: DataFrame) -> DataFrame:
    """Unknown keys, lines and invoices per folder."""
    keyed = lines.filter(~is_blank("part_number")).withColumn("composite_key", composite_key())
    unknown = keyed.join(master.select("composite_key"), "composite_key", "left_anti")
    placed = unknown.join(files.select("doc_id", "folder"), "doc_id")
    # Counted per (folder, key) first: folders are few and large.
    per_key = placed.groupBy("folder", "composite_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("folder").agg(
        F.count(F.lit(1)).alias("unknown_parts_found"),
        F.sum("n").alias("unknown_lines"))


# ---- anomalies --------------------------------------------------------------------


def severity_thresholds(mode: str = "parts_based", threshold=None) -> dict[str, float]:
    """Warning and critical price gaps (E17). 1.00 and 5.00 by default."""
    if mode == "threshold_based":
        return {"warning": float(threshold), "critical": 2 * float(threshold)}
    return {"warning": 1.00, "critical": 5.00}


def anomalies(verdicts: DataFrame, mode: str = "parts_based", threshold=None) -> DataFrame:
    """Anomalies of error lines: kind, severity and a detail map."""
    limits = severity_thresholds(mode, threshold)
    gap = F.col("price_difference")
    kind = (
        F.when(F.col("validation_status") == "UNKNOWN", "MISSING_PART")
        .when(gap.isNull(), "DATA_QUALITY_ISSUE")
        .otherwise("PRICE_DISCREPANCY")
    )
    severity = (
        F.when(gap.isNull(), "WARNING")
        .when(gap >= limits["critical"], "CRITICAL")
        .when(gap >= limits["warning"], "WARNING")
        .otherwise("INFORMATIONAL")
    )
    return verdicts.filter(F.col("validation_status") != "PASSED").select(
        "doc_id", "row_idx", "line_id", "part_number",
        kind.alias("anomaly_type"), severity.alias("severity"),
        F.array_join("validation_errors", "; ").alias("description"),
        F.create_map(
            F.lit("rate"), F.col("rate").cast("string"),
            F.lit("authorized"), F.col("database_price").cast("string"),
        ).alias("details"),
    )


def anomaly_summary(found: DataFrame) -> DataFrame:
    """Counts per invoice and severity."""
    return found.groupBy("doc_id").agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_anomalies"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_anomalies"),
        F.count_if(F.col("severity") == "INFORMATIONAL").alias("informational_anomalies"),
        F.count(F.lit(1)).alias("total_anomalies"),
    )


def integrity_report(log: DataFrame, master: DataFrame, settings: DataFrame,
                     setting_error: Column) -> DataFrame:
    """Counts of broken references, prices and settings."""
    numbers = master.select("part_number").distinct()
    # Counted per number before the join: the log repeats few numbers many times.
    logged = log.filter(~is_blank("part_number")).groupBy("part_number").agg(
        F.count(F.lit(1)).alias("n"))
    orphans = logged.join(numbers, "part_number", "left_anti").agg(
        F.lit("orphaned_log_entries").alias("issue"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    prices = master.filter(F.col("authorized_price") <= 0).agg(
        F.lit("invalid_prices").alias("issue"), F.count(F.lit(1)).alias("n"))
    values = settings.filter(setting_error.isNotNull()).agg(
        F.lit("invalid_settings").alias("issue"), F.count(F.lit(1)).alias("n"))
    return orphans.unionByName(prices).unionByName(values)
