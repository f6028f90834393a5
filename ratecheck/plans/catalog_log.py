"""Catalog: the discovery log and discovery from lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecheck.operators import log as dl
from ratecheck.operators.validate import unknown_parts
from ratecheck.plans.catalog_audit import AUDIT_VIEWS, doubles, money_sql
from ratecheck.plans.driver_views import AS_OF, DriverViews
from ratecheck.plans.oracle_views import with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SESSION = "batch-2024"

LOG_VIEWS = {
    **AUDIT_VIEWS,
    "v_ruled": """
        SELECT *, concat_ws('; ',
                 CASE WHEN part_number = '' THEN 'Part number must be a non-empty string' END,
                 CASE WHEN action_taken = 'collected' THEN 'Action taken must be one of: '
                      || 'discovered, added, updated, skipped, price_mismatch' END,
                 CASE WHEN discovered_price <= 0 THEN 'Discovered price must be positive' END)
                 AS errors
        FROM v_log_entries""",
    "v_priced": """
        SELECT part_number, count(*) AS occurrences, count(discovered_price) AS priced,
               CAST(sum(discovered_price) AS DECIMAL(28,8)) / count(discovered_price) AS avg_price,
               min(discovered_price) AS low, max(discovered_price) AS high,
               count(DISTINCT invoice_number)
                 + max(CASE WHEN invoice_number IS NULL THEN 1 ELSE 0 END) AS invoices
        FROM v_log WHERE action_taken = 'discovered' GROUP BY part_number
        HAVING count(discovered_price) > 0""",
    "v_context": """
        SELECT l.part_number, i.invoice_number, i.invoice_date,
               CAST(l.rate AS DECIMAL(18,4)) AS discovered_price, l.description, l.quantity,
               l.line_number, l.doc_id, l.row_idx, l.line_id
        FROM v_lines l LEFT JOIN v_invoices i ON l.doc_id = i.doc_id
        WHERE coalesce(l.part_number, '') <> ''
          AND l.part_number NOT IN (SELECT part_number FROM v_master)
          AND l.part_number NOT IN (SELECT composite_key FROM v_master)""",
    "v_decided": f"""
        SELECT u.composite_key, u.part_number, d.decided_price, u.description, u.item_type,
               u.doc_id,
               CASE WHEN d.action IS DISTINCT FROM 'add_to_database_now' THEN 'skipped'
                    WHEN d.decided_price <= 0 THEN 'failed' ELSE 'added' END AS outcome
        FROM v_unknown u LEFT JOIN v_decisions d ON u.composite_key = d.composite_key""",
}

TIME_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(DriverViews(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, LOG_VIEWS)
        return fn
    return keep


def time_text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _logged(df):
    return doubles(df.select(
        "id", "part_number", "invoice_number", "discovered_price", "action_taken",
        time_text("discovery_date"), "processing_session_id"), "discovered_price")


LOGGED_SQL = ("id, part_number, invoice_number, CAST(discovered_price AS DOUBLE) "
              "AS discovered_price, action_taken, "
              + TIME_SQL.format("discovery_date") + " AS discovery_date, processing_session_id")


@register("d1_append_log", f"""
    SELECT {LOGGED_SQL} FROM v_log UNION ALL
    SELECT {LOGGED_SQL} FROM (
      SELECT * REPLACE (coalesce(discovery_date, TIMESTAMP '{AS_OF}') AS discovery_date)
      FROM v_ruled WHERE errors = '')""")
def _(v):
    return _logged(dl.append_log(v.log(), v.log_entries(), AS_OF))


@register("d1_rejected_entries", "SELECT id, errors FROM v_ruled WHERE errors <> ''")
def _(v):
    return dl.rejected_entries(v.log_entries()).select(
        "id", F.array_join("errors", "; ").alias("errors"))


@register("d2_batch_append", f"""
    SELECT id, part_number, '{SESSION}' AS processing_session_id,
           {TIME_SQL.format(f"coalesce(discovery_date, TIMESTAMP '{AS_OF}')")} AS discovery_date
    FROM v_ruled WHERE errors = ''""")
def _(v):
    return dl.accepted_entries(v.log_entries(), AS_OF, SESSION).select(
        "id", "part_number", "processing_session_id", time_text("discovery_date"))


@register("d3_filter_log", f"""
    SELECT {LOGGED_SQL} FROM v_log
    WHERE CAST(discovery_date AS DATE) >= DATE '2024-01-24' AND part_number = 'P-8'""")
def _(v):
    return _logged(dl.filter_log(v.log(), AS_OF, part_number="P-8", days_back=7))


@register("d3_newest_rows", f"""
    SELECT {LOGGED_SQL} FROM v_log ORDER BY discovery_date DESC, id DESC LIMIT 100""")
def _(v):
    return _logged(dl.filter_log(v.log(), AS_OF, limit=100))


@register("d4_recent_discoveries", f"""
    SELECT l.id, l.part_number, p.description AS part_description,
           CAST(p.authorized_price AS DOUBLE) AS current_price
    FROM v_log l LEFT JOIN v_master p ON l.part_number = p.part_number
    WHERE CAST(l.discovery_date AS DATE) >= DATE '2024-01-11'""")
def _(v):
    return doubles(dl.recent_discoveries(v.log(), v.master(), AS_OF, 20).select(
        "id", "part_number", "part_description", "current_price"), "current_price")


@register("d5_window_summary", """
    SELECT count(*) AS total_entries, count(DISTINCT nullif(processing_session_id, '')) AS sessions,
           count(DISTINCT part_number) AS parts_discovered,
           count(*) FILTER (action_taken = 'price_mismatch') AS price_mismatches
    FROM v_log WHERE CAST(discovery_date AS DATE) >= DATE '2024-01-11'""")
def _(v):
    return dl.window_summary(v.log(), AS_OF, 20)


@register("d5_window_actions", """
    SELECT action_taken, count(*) AS count FROM v_log
    WHERE CAST(discovery_date AS DATE) >= DATE '2024-01-11' GROUP BY action_taken""")
def _(v):
    return dl.window_actions(v.log(), AS_OF, 20)


@register("d6_discovery_stats", """
    SELECT count(*) AS total_discoveries, count(DISTINCT part_number) AS unique_parts,
           count(*) FILTER (action_taken = 'added') AS parts_added,
           count(*) FILTER (action_taken = 'skipped') AS parts_skipped,
           round(CAST(count(*) FILTER (action_taken = 'added') AS DOUBLE)
           / count(*) FILTER (action_taken IN ('added', 'skipped')) * 100, 6) AS success_rate,
           count(DISTINCT processing_session_id)
             + max(CASE WHEN processing_session_id IS NULL THEN 1 ELSE 0 END) AS active_sessions
    FROM v_log""")
def _(v):
    return dl.discovery_stats(v.log()).withColumn("success_rate", F.round("success_rate", 6))


@register("d7_recent_sessions", f"""
    SELECT processing_session_id AS session_id, count(DISTINCT part_number) AS parts_discovered,
           count(*) FILTER (action_taken = 'added') AS parts_added,
           {TIME_SQL.format('min(discovery_date)')} AS first_seen,
           {TIME_SQL.format('max(discovery_date)')} AS last_seen
    FROM v_log
    GROUP BY processing_session_id
    ORDER BY max(discovery_date) DESC, processing_session_id LIMIT 20""")
def _(v):
    return dl.recent_sessions(v.log(), 20).select(
        "session_id", "parts_discovered", "parts_added", time_text("first_seen"),
        time_text("last_seen"))


@register("d8_session_summaries", """
    SELECT processing_session_id AS session_id,
           count(DISTINCT part_number) AS unique_parts_discovered, count(*) AS total_occurrences,
           count(*) FILTER (action_taken = 'added') AS parts_added
    FROM v_log GROUP BY processing_session_id""")
def _(v):
    return dl.session_summaries(v.log())


@register("d9_unknown_review", """
    SELECT part_number, count(*) AS occurrences,
           CAST(coalesce(round(CAST(sum(discovered_price) AS DECIMAL(28,8))
                / nullif(count(discovered_price), 0), 6), 0) AS DOUBLE) AS avg_price,
           CAST(min(discovered_price) AS DOUBLE) AS min_price,
           CAST(max(discovered_price) AS DOUBLE) AS max_price,
           CAST(max(discovered_price) - min(discovered_price) AS DOUBLE) AS price_variance,
           count(DISTINCT invoice_number) AS unique_invoices
    FROM (SELECT * REPLACE (nullif(discovered_price, 0) AS discovered_price) FROM v_log)
    GROUP BY part_number""")
def _(v):
    return doubles(dl.unknown_review(v.log()), "avg_price", "min_price", "max_price",
                   "price_variance")


@register("d9_review_invoices", """
    SELECT DISTINCT part_number, invoice_number FROM v_log WHERE invoice_number <> ''""")
def _(v):
    return dl.review_invoices(v.log())


@register("a14_review_descriptions", """
    SELECT DISTINCT part_number, notes FROM v_log WHERE notes <> ''""")
def _(v):
    return dl.review_descriptions(v.log())


@register("d10_session_review", f"""
    SELECT part_number, occurrences, {money_sql('avg_price', 4)} AS avg_price,
           {money_sql('low', 4)} AS min_price, {money_sql('high', 4)} AS max_price, invoices,
           CASE WHEN low <> high THEN {money_sql('low', 4)} || ' - ' || {money_sql('high', 4)}
                ELSE {money_sql('low', 4)} END AS price_range FROM v_priced""")
def _(v):
    return dl.session_review(v.log())


@register("d11_candidate_prices", """
    SELECT part_number, CAST(round(avg_price, 4) AS DOUBLE) AS avg_candidate,
           CAST(low AS DOUBLE) AS min_candidate, CAST(high AS DOUBLE) AS max_candidate
    FROM v_priced""")
def _(v):
    log = v.log()
    out = None
    for policy in ("avg", "min", "max"):
        one = dl.candidate_prices(log, policy).select(
            "part_number", F.col("authorized_price").cast("double").alias(f"{policy}_candidate"))
        out = one if out is None else out.join(one, "part_number")
    return out


@register("d12_part_history", f"""
    SELECT m.composite_key, m.part_number, CAST(m.authorized_price AS DOUBLE) AS authorized_price,
           l.id, l.action_taken, CAST(l.discovered_price AS DOUBLE) AS discovered_price,
           l.invoice_number, {TIME_SQL.format('l.discovery_date')} AS discovery_date
    FROM v_master m LEFT JOIN v_log l ON m.part_number = l.part_number""")
def _(v):
    return doubles(dl.part_history(v.master(), v.log()), "authorized_price",
                   "discovered_price").withColumn("discovery_date", time_text("discovery_date"))


@register("d13_discovered_contexts", """
    SELECT part_number, invoice_number, invoice_date,
           CAST(discovered_price AS DOUBLE) AS discovered_price, description, quantity,
           line_number, doc_id, line_id FROM v_context""")
def _(v):
    out = dl.discover_unknown(v.lines(), v.invoices(), v.master()).drop("row_idx")
    return doubles(out, "discovered_price")


@register("d13_discovered_rows", f"""
    SELECT part_number, invoice_number, CAST(discovered_price AS DOUBLE) AS discovered_price,
           'discovered' AS action_taken, '{SESSION}' AS processing_session_id,
           description AS notes FROM v_context""")
def _(v):
    rows = dl.discovered_rows(dl.discover_unknown(v.lines(), v.invoices(), v.master()),
                              SESSION, AS_OF)
    return doubles(rows.select("part_number", "invoice_number", "discovered_price",
                               "action_taken", "processing_session_id", "notes"),
                   "discovered_price")


def _decided(v):
    unknowns = unknown_parts(v.lines(), v.master(), ["part_number", "description", "item_type"])
    return dl.apply_decisions(unknowns, v.decisions(), v.master(), AS_OF)


@register("d14_decision_outcomes", """
    SELECT composite_key, part_number, CAST(decided_price AS DOUBLE) AS authorized_price,
           outcome, CASE WHEN outcome = 'failed' THEN 'Authorized price must be positive' END
             AS error FROM v_decided""")
def _(v):
    return doubles(_decided(v).select("composite_key", "part_number", "authorized_price",
                                      "outcome", "error"), "authorized_price")


@register("d14_master_after_decisions", """
    SELECT composite_key, CAST(authorized_price AS DOUBLE) AS authorized_price, source
    FROM v_master UNION ALL
    SELECT composite_key, CAST(decided_price AS DOUBLE), 'discovered' FROM v_decided
    WHERE outcome = 'added'""")
def _(v):
    return doubles(dl.add_decided(v.master(), _decided(v)).select(
        "composite_key", "authorized_price", "source"), "authorized_price")


@register("d14_decision_log", f"""
    SELECT part_number, doc_id AS invoice_number,
           CAST(CASE WHEN outcome = 'added' THEN decided_price END AS DOUBLE) AS authorized_price,
           outcome AS action_taken, '{SESSION}' AS processing_session_id
    FROM v_decided WHERE outcome IN ('added', 'skipped')""")
def _(v):
    return doubles(dl.decision_log(_decided(v), SESSION, AS_OF).drop("discovery_date"),
                   "authorized_price")


@register("d15_batch_collection", """
    SELECT part_number, 'skipped' AS action_taken, 'batch_collected' AS user_decision,
           CAST(discovered_price AS DOUBLE) AS price, description,
           'batch_mode_no_auto_add' AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY part_number
                                       ORDER BY doc_id, row_idx, line_id) AS rn FROM v_context)
    WHERE rn = 1""")
def _(v):
    contexts = dl.discover_unknown(v.lines(), v.invoices(), v.master())
    return doubles(dl.collect_batch(contexts), "price")


@register("d16_retention", f"""
    SELECT {LOGGED_SQL} FROM v_log WHERE CAST(discovery_date AS DATE) >= DATE '2024-01-11'""")
def _(v):
    return _logged(dl.retained(v.log(), AS_OF, 20))


@register("d16_removed_count", """
    SELECT count(*) AS removed FROM v_log WHERE CAST(discovery_date AS DATE) < DATE '2024-01-11'""")
def _(v):
    return dl.removed_count(v.log(), AS_OF, 20)
