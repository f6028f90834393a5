"""Catalog: file inventory, nested records, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecheck.operators import lines as li
from ratecheck.operators.validate import anomalies
from ratecheck.plans.catalog_audit import ANOMALY_SQL, doubles, money_sql, verdicts
from ratecheck.plans.catalog_log import LOG_VIEWS
from ratecheck.plans.driver_views import AS_OF, DriverViews
from ratecheck.plans.oracle_views import with_views
from ratecheck.schemas import PARTS
from ratecheck.sinks import exports
from ratecheck.sources import files, records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FILE_VIEWS = {
    **LOG_VIEWS,
    "v_files": """
        SELECT '/invoices/' || o_orderpriority || '/' || (o_orderkey // 2)
               || CASE o_orderstatus WHEN 'O' THEN '.pdf' WHEN 'F' THEN '.PDF' ELSE '.txt' END
                 AS path FROM orders""",
    "v_valid_lines": """
        SELECT * FROM v_lines WHERE coalesce(quantity, 0) <> 0 AND rate IS NOT NULL
          AND trim(coalesce(description, '')) <> ''""",
}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(DriverViews(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, FILE_VIEWS)
        return fn
    return keep


def listed_files(v):
    return v.table("orders").selectExpr(
        "concat('/invoices/', o_orderpriority, '/', o_orderkey div 2, CASE o_orderstatus "
        "WHEN 'O' THEN '.pdf' WHEN 'F' THEN '.PDF' ELSE '.txt' END) AS path")


@register("a1_invoice_files", """
    SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM v_files
    WHERE path LIKE '%.pdf' OR path LIKE '%.PDF'""")
def _(v):
    return files.invoice_files(listed_files(v))


@register("a2_invoice_folders", """
    SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(DISTINCT path) AS count
    FROM v_files WHERE path LIKE '%.pdf' OR path LIKE '%.PDF' GROUP BY 1""")
def _(v):
    return files.invoice_folders(listed_files(v))


@register("a8_extraction_lines", """
    SELECT l.doc_id, coalesce(i.invoice_number, 'UNKNOWN') AS invoice_number,
           coalesce(i.invoice_date, '') AS invoice_date, l.line_number, l.part_number,
           l.description, l.item_type, CAST(l.rate AS DOUBLE) AS rate, l.quantity,
           CAST(l.total AS DOUBLE) AS total, 'extracted' AS source, l.raw_text
    FROM v_valid_lines l LEFT JOIN v_invoices i ON l.doc_id = i.doc_id""")
def _(v):
    texts = records.to_text(records.nest_extractions(v.lines(), v.invoices(), v.sections()))
    return doubles(records.flat_lines(records.parse_extractions(texts)).drop(
        "row_idx", "line_id"), "rate", "total")


@register("a8_extraction_sections", """
    SELECT s.doc_id, section_type, CAST(row_number() OVER (PARTITION BY s.doc_id
             ORDER BY section_pos) AS INTEGER) AS section_pos, CAST(amount AS DOUBLE) AS amount
    FROM v_sections s WHERE s.doc_id IN (SELECT doc_id FROM v_valid_lines)""")
def _(v):
    texts = records.to_text(records.nest_extractions(v.lines(), v.invoices(), v.sections()))
    return doubles(records.flat_sections(records.parse_extractions(texts)), "amount")


@register("a9_invoice_record_round_trip", """
    SELECT l.doc_id, any_value(i.invoice_number) AS invoice_number,
           CAST(count(*) AS INTEGER) AS n_lines,
           CAST(sum(l.total) AS DOUBLE) AS total
    FROM v_lines l LEFT JOIN v_invoices i ON l.doc_id = i.doc_id GROUP BY l.doc_id""")
def _(v):
    back = records.invoices_from_text(records.to_text(records.nest_invoices(
        v.lines(), v.invoices())))
    zero = F.lit(0).cast("decimal(28,4)")
    filled = F.filter("line_items", lambda x: x["total"].isNotNull())
    total = F.aggregate(filled, zero, lambda acc, x: (acc + x["total"]).cast("decimal(28,4)"))
    return back.select("doc_id", "invoice_number", F.size("line_items").alias("n_lines"),
                       F.when(F.size(filled) > 0, total).cast("double").alias("total"))


EXPORT_SQL = f"""
    part_number, substr({money_sql('authorized_price')}, 2) AS authorized_price, description,
    {{item_type}} coalesce(category, '') AS category, source,
    coalesce(first_seen_invoice, '') AS first_seen_invoice,
    strftime(created_date, '%Y-%m-%dT%H:%M:%S') AS created_date,
    strftime(last_updated, '%Y-%m-%dT%H:%M:%S') AS last_updated,
    CASE WHEN is_active THEN 'true' ELSE 'false' END AS is_active, notes"""


@register("a10_parts_export", f"SELECT {EXPORT_SQL.format(item_type='item_type,')} FROM v_master")
def _(v):
    return exports.parts_export(v.master())


@register("a11_parts_export_plain",
          f"SELECT {EXPORT_SQL.format(item_type='')} FROM v_master WHERE is_active")
def _(v):
    return exports.parts_export_plain(v.master())


@register("a12_parts_export_short", """
    SELECT part_number, CAST(authorized_price AS DOUBLE) AS authorized_price, description,
           coalesce(category, '') AS category, source,
           coalesce(first_seen_invoice, '') AS first_seen_invoice, is_active, notes
    FROM v_master WHERE is_active""")
def _(v):
    return exports.parts_export_short(v.master())


@register("a13_log_export", """
    SELECT part_number, invoice_number, invoice_date,
           CAST(nullif(discovered_price, 0) AS DOUBLE) AS discovered_price,
           CAST(nullif(authorized_price, 0) AS DOUBLE) AS authorized_price, action_taken,
           user_decision, processing_session_id, notes,
           strftime(discovery_date, '%Y-%m-%dT%H:%M:%S') AS created_at
    FROM v_log WHERE action_taken <> 'added'""")
def _(v):
    return exports.log_export(v.log())


@register("a14_unknown_parts_export", """
    SELECT part_number, count(*) AS occurrences, count(DISTINCT invoice_number) AS unique_invoices,
           CAST(coalesce(round(CAST(sum(p) AS DECIMAL(28,8)) / nullif(count(p), 0), 6), 0)
                AS DOUBLE) AS avg_price,
           CAST(min(p) AS DOUBLE) AS min_price, CAST(max(p) AS DOUBLE) AS max_price,
           CAST(max(p) - min(p) AS DOUBLE) AS price_variance
    FROM (SELECT *, nullif(discovered_price, 0) AS p FROM v_log) GROUP BY part_number""")
def _(v):
    return doubles(exports.unknown_parts_export(v.log()), "avg_price", "min_price", "max_price",
                   "price_variance")


@register("a15_lines_export", """
    SELECT l.part_number AS item_code, l.description, l.item_type, CAST(l.rate AS DOUBLE) AS rate,
           l.quantity, CAST(l.total AS DOUBLE) AS total, l.line_number, l.raw_text,
           i.invoice_number
    FROM v_lines l LEFT JOIN v_invoices i ON l.doc_id = i.doc_id""")
def _(v):
    return doubles(exports.lines_export(v.lines(), v.invoices()), "rate", "total")


@register("a15_parts_export", """
    SELECT l.part_number, CAST(l.rate AS DOUBLE) AS authorized_price, l.description, l.item_type,
           i.invoice_number AS first_seen_invoice
    FROM v_lines l LEFT JOIN v_invoices i ON l.doc_id = i.doc_id""")
def _(v):
    return doubles(li.candidate_parts(v.lines(), v.invoices()).drop("doc_id", "line_id"),
                   "authorized_price")


@register("a16_nested_results", """
    SELECT v.doc_id, 0 AS page, any_value(i.invoice_number) AS invoice_number,
           CAST(count(*) AS INTEGER) AS n_parts,
           CAST(count(*) FILTER (validation_status <> 'PASSED') AS INTEGER) AS n_errors,
           count(*) FILTER (validation_status = 'PASSED') AS passed_parts,
           string_agg(validation_status, ',' ORDER BY row_idx, line_id) AS statuses
    FROM v_verdicts v LEFT JOIN v_invoices i ON v.doc_id = i.doc_id GROUP BY v.doc_id""")
def _(v):
    nested = records.nest_verdicts(verdicts(v), v.invoices())
    return nested.select(
        "doc_id", "page", F.col("invoice_metadata.invoice_number").alias("invoice_number"),
        F.size("parts").alias("n_parts"), F.size("error_lines").alias("n_errors"),
        F.col("validation_summary.passed_parts").alias("passed_parts"),
        F.array_join("parts.validation_status", ",").alias("statuses"))


@register("a17_report_names", """
    SELECT doc_id, CASE WHEN coalesce(n, '') = '' OR lower(n) = 'unknown' THEN 'report' ELSE n END
             AS name, '20240131' AS run_date
    FROM (SELECT doc_id, CASE folder WHEN '5-LOW' THEN 'Unknown' WHEN '2-HIGH' THEN NULL
                              ELSE invoice_number END AS n FROM v_invoices)""")
def _(v):
    named = v.invoices().selectExpr(
        "doc_id", "CASE folder WHEN '5-LOW' THEN 'Unknown' WHEN '2-HIGH' THEN NULL "
                  "ELSE invoice_number END AS invoice_number")
    return exports.dated_reports(named, AS_OF).select("doc_id", "name", "run_date")


@register("a18_flat_values", """
    SELECT id, CAST(discovered_price AS DOUBLE) AS discovered_price,
           strftime(discovery_date, '%Y-%m-%dT%H:%M:%S') AS discovery_date FROM v_log""")
def _(v):
    return exports.flat_values(v.log().select("id", "discovered_price", "discovery_date"))


@register("a19_anomaly_report", f"""
    SELECT a.*, v.error_text AS description FROM ({ANOMALY_SQL.format(critical=5.0, warning=1.0)}) a
    JOIN v_verdicts v ON a.doc_id = v.doc_id AND a.line_id = v.line_id""")
def _(v):
    return exports.anomaly_report(anomalies(verdicts(v)))


@register("a19_empty_report", """
    SELECT CAST(NULL AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS line_id,
           CAST(NULL AS VARCHAR) AS part_number, CAST(NULL AS VARCHAR) AS anomaly_type,
           CAST(NULL AS VARCHAR) AS severity, 'No anomalies found.' AS description
    FROM v_verdicts WHERE price_difference > 1000000 HAVING count(*) = 0""")
def _(v):
    return exports.anomaly_report(anomalies(verdicts(v)).join(
        verdicts(v).filter("price_difference > 1000000").select("doc_id", "line_id"),
        ["doc_id", "line_id"], "left_semi"))


@register("c22_typed_round_trip", """
    SELECT composite_key, part_number, CAST(authorized_price AS DOUBLE) AS authorized_price,
           description, is_active, nullif(category, '') AS category,
           strftime(created_date, '%Y-%m-%d %H:%M:%S') AS created_date FROM v_master""")
def _(v):
    back = records.typed_rows(records.as_text(v.master()), PARTS)
    return doubles(back.select(
        "composite_key", "part_number", "authorized_price", "description", "is_active", "category",
        F.date_format("created_date", "yyyy-MM-dd HH:mm:ss").alias("created_date")),
        "authorized_price")
