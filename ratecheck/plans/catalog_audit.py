"""Catalog: line verdicts, invoice rules, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecheck.operators import invoices as inv
from ratecheck.operators import validate as val
from ratecheck.plans import report as rep
from ratecheck.plans.audit import audit, audit_summary
from ratecheck.plans.driver_views import AS_OF, DriverViews
from ratecheck.plans.oracle_views import NORMAL, key_sql, with_views
from ratecheck.functions.text import setting_error

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Money as double at the edge, so both engines hand over the same type."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(DriverViews(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, {**AUDIT_VIEWS, **(extra or {})})
        return fn
    return keep


def money_sql(value: str, places: int = 2) -> str:
    return f"'$' || CAST(CAST(round({value}, {places}) AS DECIMAL(28,{places})) AS VARCHAR)"


AUDIT_VIEWS = {
    "v_keyed": f"SELECT *, {key_sql()} AS composite_key FROM v_lines",
    "v_verdicts": f"""
        SELECT l.*,
               CASE WHEN coalesce(l.part_number, '') <> '' THEN m.authorized_price END
                 AS database_price,
               CASE WHEN coalesce(l.part_number, '') <> ''
                    THEN abs(CAST(l.rate AS DOUBLE) - CAST(m.authorized_price AS DOUBLE)) END
                 AS price_difference,
               CASE WHEN coalesce(l.part_number, '') = '' THEN 'FAILED'
                    WHEN m.authorized_price IS NULL THEN 'UNKNOWN'
                    WHEN l.rate IS NULL THEN 'PASSED'
                    WHEN abs(CAST(l.rate AS DOUBLE) - CAST(m.authorized_price AS DOUBLE)) <= 0.001
                    THEN 'PASSED' ELSE 'FAILED' END AS validation_status,
               CASE WHEN coalesce(l.part_number, '') = '' THEN 'Missing part number'
                    WHEN m.authorized_price IS NULL THEN 'Part not found in database'
                    WHEN abs(CAST(l.rate AS DOUBLE) - CAST(m.authorized_price AS DOUBLE)) > 0.001
                    THEN 'Price mismatch: expected ' || {money_sql('m.authorized_price', 4)}
                         || ', got ' || {money_sql('l.rate', 4)}
                    ELSE '' END AS error_text
        FROM v_keyed l LEFT JOIN v_master m ON l.composite_key = m.composite_key""",
    "v_amounts": """
        SELECT *,
               CASE WHEN is_error AND listed > 0 THEN CAST(listed * qty AS DECIMAL(18,4))
                    ELSE actual_total END AS expected_total,
               CASE WHEN is_error THEN listed ELSE actual_price END AS expected_price
        FROM (SELECT *,
                     CASE WHEN total > 0 THEN total
                          ELSE CAST(CAST(actual_price AS DECIMAL(14,4)) * qty AS DECIMAL(18,4))
                     END AS actual_total
              FROM (SELECT *,
                           CASE WHEN coalesce(quantity, 0) = 0 THEN 1 ELSE quantity END AS qty,
                           coalesce(rate, CAST(0 AS DECIMAL(18,4))) AS actual_price,
                           CAST(coalesce(database_price, 0) AS DECIMAL(14,4)) AS listed,
                           validation_status IN ('FAILED', 'UNKNOWN') AS is_error
                    FROM v_verdicts))""",
    "v_summary": """
        SELECT doc_id, count(*) AS total_parts,
               count(*) FILTER (validation_status = 'PASSED') AS passed_parts,
               count(*) FILTER (validation_status = 'FAILED') AS failed_parts,
               count(*) FILTER (validation_status = 'UNKNOWN') AS unknown_parts
        FROM v_verdicts GROUP BY doc_id""",
    "v_unknown": """
        SELECT * EXCLUDE (rn) FROM (
          SELECT k.*, row_number() OVER (PARTITION BY k.composite_key
                                         ORDER BY k.doc_id, k.row_idx, k.line_id) AS rn
          FROM v_keyed k LEFT JOIN v_master m ON k.composite_key = m.composite_key
          WHERE m.composite_key IS NULL AND coalesce(k.part_number, '') <> '') WHERE rn = 1""",
    "v_section_amounts": """
        SELECT doc_id,
               arg_min(amount, section_pos) FILTER (section_type = 'SUBTOTAL') AS subtotal,
               arg_min(amount, section_pos) FILTER (section_type = 'FREIGHT') AS freight,
               max(amount) FILTER (section_type = 'TAX') AS tax,
               arg_min(amount, section_pos) FILTER (section_type = 'TOTAL') AS total,
               count(*) AS n_sections, count(*) FILTER (amount IS NULL) AS n_missing
        FROM v_sections GROUP BY doc_id""",
    "v_counts": """
        SELECT i.doc_id, i.folder, i.invoice_number, i.invoice_date,
               coalesce(c.n, 0) AS total_line_items, coalesce(c.v, 0) AS valid_line_items
        FROM v_invoices i LEFT JOIN (
          SELECT doc_id, count(*) AS n,
                 count(*) FILTER (coalesce(quantity, 0) <> 0 AND rate IS NOT NULL
                                  AND trim(coalesce(description, '')) <> '') AS v
          FROM v_lines GROUP BY doc_id) c ON i.doc_id = c.doc_id""",
    "v_gate": """
        SELECT *, concat_ws('; ',
                 CASE WHEN NOT regexp_matches(coalesce(invoice_number, ''), '^[0-9]+$')
                      THEN 'Invalid invoice number format: ' || coalesce(invoice_number, 'None')
                 END,
                 CASE WHEN coalesce(invoice_date, '') = '' THEN 'Invoice date is missing' END,
                 CASE WHEN valid_line_items = 0 THEN 'No valid line items found' END) AS errors
        FROM v_counts""",
    "v_outcomes": """
        SELECT i.doc_id, i.folder, g.errors = '' AND s.total_parts IS NOT NULL AS success,
               CASE WHEN g.errors = '' THEN coalesce(s.total_parts, 0) ELSE 0 END AS lines,
               CASE WHEN g.errors = '' THEN coalesce(s.unknown_parts, 0) ELSE 0 END
                 AS unknown_parts,
               CASE WHEN g.errors = '' THEN coalesce(s.failed_parts + s.unknown_parts, 0)
                    ELSE 0 END AS validation_errors,
               coalesce(nullif(g.errors, ''),
                        CASE WHEN s.total_parts IS NULL THEN 'No line items found' END) AS error
        FROM v_invoices i JOIN v_gate g ON i.doc_id = g.doc_id
        LEFT JOIN v_summary s ON i.doc_id = s.doc_id""",
    "v_line_report": f"""
        SELECT a.doc_id AS sort_doc, 0 AS sort_block, row_idx, line_id,
               coalesce(invoice_number, '') AS invoice_number,
               coalesce(invoice_date, '') AS invoice_date,
               coalesce(line_number, '') AS line_number,
               coalesce(part_number, '') AS part_number,
               coalesce(description, '') AS description, coalesce(item_type, '') AS item_type,
               CAST(qty AS VARCHAR) AS quantity,
               {money_sql('actual_price')} AS actual_rate,
               {money_sql('actual_total')} AS actual_total,
               {money_sql('expected_price')} AS expected_rate,
               {money_sql('expected_total')} AS expected_total,
               {money_sql('expected_total - actual_total')} AS delta,
               CASE WHEN is_error THEN 'ERROR' ELSE 'VALID' END AS status,
               coalesce(raw_text, '') AS raw_text
        FROM v_amounts a LEFT JOIN v_invoices i ON a.doc_id = i.doc_id""",
    "v_totals": """
        SELECT t.*, i.invoice_number, i.invoice_date FROM (
          SELECT doc_id, CAST(sum(CASE WHEN is_error THEN actual_total
                                       ELSE coalesce(total, 0) END) AS DECIMAL(28,4)) AS actual,
                 CAST(sum(CASE WHEN is_error THEN expected_total
                               ELSE coalesce(total, 0) END) AS DECIMAL(28,4)) AS expected
          FROM v_amounts GROUP BY doc_id) t LEFT JOIN v_invoices i ON t.doc_id = i.doc_id""",
}


def _total_sql(source: str, block: int, label: str, number: str, date: str, text: str,
               note: str, sort_doc: str = "doc_id") -> str:
    return f"""
        SELECT {sort_doc} AS sort_doc, {block} AS sort_block, CAST(NULL AS BIGINT) AS row_idx,
               CAST(NULL AS VARCHAR) AS line_id, {number} AS invoice_number,
               {date} AS invoice_date, '{label}' AS line_number, '' AS part_number,
               {text} AS description, '' AS item_type, '' AS quantity, '' AS actual_rate,
               {money_sql('actual')} AS actual_total, '' AS expected_rate,
               {money_sql('expected')} AS expected_total,
               {money_sql('expected - actual')} AS delta, '{label}' AS status,
               '{note}' || {money_sql('expected - actual')} AS raw_text
        FROM {source}"""


def verdicts(v: DriverViews) -> DataFrame:
    return audit(v.lines(), v.master())


@register("e3_line_verdicts", """
    SELECT doc_id, line_id, composite_key, CAST(database_price AS DOUBLE) AS database_price,
           price_difference, validation_status, error_text FROM v_verdicts""")
def _(v):
    return verdicts(v).select(
        "doc_id", "line_id", "composite_key", F.col("database_price").cast("double"),
        "price_difference", "validation_status",
        F.array_join("validation_errors", "; ").alias("error_text"))


@register("e4_invoice_summary", "SELECT * FROM v_summary")
def _(v):
    return audit_summary(v.lines(), v.master())


@register("e5_error_lines", """
    SELECT doc_id, line_id, part_number, CAST(qty AS INTEGER) AS qty,
           CAST(actual_price AS DOUBLE) AS actual_price,
           CAST(expected_price AS DOUBLE) AS expected_price,
           CAST(actual_total AS DOUBLE) AS actual_total,
           CAST(expected_total AS DOUBLE) AS expected_total, validation_status, error_text
    FROM v_amounts WHERE is_error""")
def _(v):
    out = val.error_lines(verdicts(v)).select(
        "doc_id", "line_id", "part_number", "qty", "actual_price", "expected_price",
        "actual_total", "expected_total", "validation_status", "error_text")
    return doubles(out, "actual_price", "expected_price", "actual_total", "expected_total")


@register("e6_item_verdicts", f"""
    SELECT doc_id, line_id, part_number,
           CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS validation_result, ok AS is_valid,
           CASE WHEN ok THEN NULL WHEN named AND price IS NULL THEN 'UNKNOWN_PART'
                ELSE 'THRESHOLD_EXCEEDED' END AS issue_type,
           CASE WHEN ok THEN '' WHEN NOT named THEN 'Missing part number'
                WHEN price IS NULL THEN 'Part not found in database'
                ELSE 'Price mismatch: expected ' || {money_sql('price', 4)} || ', got '
                     || {money_sql('rate', 4)} END AS notes
    FROM (SELECT l.*, m.authorized_price AS price, coalesce(l.part_number, '') <> '' AS named,
                 coalesce(l.part_number, '') <> '' AND m.authorized_price IS NOT NULL
                 AND (l.rate IS NULL OR abs(CAST(l.rate AS DOUBLE)
                      - CAST(m.authorized_price AS DOUBLE)) <= 0.001) AS ok
          FROM v_lines l LEFT JOIN v_rentals m
            ON {key_sql("'Rent'", 'l.description', 'l.part_number')} = m.composite_key)""",
          {"v_rentals": f"""
            SELECT {key_sql("'Rent'")} AS composite_key, min(authorized_price) AS authorized_price
            FROM v_master GROUP BY 1"""})
def _(v):
    # The items are taken as rentals, so the prices are keyed as rentals too.
    from ratecheck.functions.keys import composite_key
    rentals = v.master().withColumn("composite_key", composite_key(F.lit("Rent"))).groupBy(
        "composite_key").agg(F.min("authorized_price").alias("authorized_price"))
    return val.item_verdicts(v.lines(), rentals).select(
        "doc_id", "line_id", "part_number", "validation_result", "is_valid", "issue_type", "notes")


@register("e7_batch_summary", """
    SELECT count(*) AS invoices, CAST(sum(total_parts) AS BIGINT) AS total_parts,
           CAST(sum(passed_parts) AS BIGINT) AS passed_parts,
           CAST(sum(failed_parts) AS BIGINT) AS failed_parts,
           CAST(sum(unknown_parts) AS BIGINT) AS unknown_parts,
           CAST(sum(failed_parts + unknown_parts) AS BIGINT) AS error_lines FROM v_summary""")
def _(v):
    return val.batch_summary(verdicts(v))


@register("e1_unknown_parts", """
    SELECT composite_key, doc_id, line_id, part_number, description, item_type,
           CAST(rate AS DOUBLE) AS rate, quantity FROM v_unknown""")
def _(v):
    out = val.unknown_parts(v.lines(), v.master(), ["rate", "quantity"]).select(
        "composite_key", "doc_id", "line_id", "part_number", "description", "item_type", "rate",
        "quantity")
    return doubles(out, "rate")


@register("e2_first_seen_acceptance", """
    SELECT v.doc_id, count(*) AS total_parts,
           count(*) FILTER (st = 'PASSED') AS passed_parts,
           count(*) FILTER (st = 'FAILED') AS failed_parts,
           count(*) FILTER (st = 'UNKNOWN') AS unknown_parts
    FROM (SELECT v.doc_id,
                 CASE WHEN v.validation_status = 'UNKNOWN' AND u.rate > 0
                      THEN CASE WHEN v.rate IS NULL OR abs(CAST(v.rate AS DOUBLE)
                                  - CAST(CAST(u.rate AS DECIMAL(18,4)) AS DOUBLE)) <= 0.001
                                THEN 'PASSED' ELSE 'FAILED' END
                      ELSE v.validation_status END AS st
          FROM v_verdicts v LEFT JOIN v_unknown u ON v.composite_key = u.composite_key) v
    GROUP BY v.doc_id""")
def _(v):
    return val.verdict_summary(
        audit(v.lines(), v.master(), accept_unknown=True, as_of=AS_OF))


def outcomes(v: DriverViews) -> DataFrame:
    # Verdicts carry the line columns, so the gate needs no other lines.
    return inv.audited_files(v.invoices(), audit(v.lines(), v.master()))


FILE_COUNTS = """
    count(*) AS total_files, count(*) FILTER (success) AS successful_files,
    count(*) FILTER (NOT success) AS failed_files, CAST(sum(lines) AS BIGINT) AS total_lines,
    CAST(sum(unknown_parts) AS BIGINT) AS total_unknown_parts,
    CAST(sum(validation_errors) AS BIGINT) AS total_errors"""


@register("e8_file_outcomes", """
    SELECT doc_id, folder, success, CAST(lines AS BIGINT) AS lines,
           CAST(unknown_parts AS BIGINT) AS unknown_parts,
           CAST(validation_errors AS BIGINT) AS validation_errors, error FROM v_outcomes""")
def _(v):
    return outcomes(v)


@register("e8_batch_counters", f"SELECT {FILE_COUNTS} FROM v_outcomes")
def _(v):
    return val.batch_counters(outcomes(v))


@register("e9_folder_statistics", f"SELECT folder, {FILE_COUNTS} FROM v_outcomes GROUP BY folder")
def _(v):
    return val.folder_statistics(outcomes(v))


@register("e9_folder_errors", "SELECT folder, doc_id, error FROM v_outcomes WHERE NOT success")
def _(v):
    return val.folder_errors(outcomes(v))


@register("e10_unknown_parts_by_folder", """
    SELECT folder, count(DISTINCT k.composite_key) AS unknown_parts_found,
           count(*) AS unknown_lines
    FROM v_keyed k JOIN v_invoices i ON k.doc_id = i.doc_id
    LEFT JOIN v_master m ON k.composite_key = m.composite_key
    WHERE m.composite_key IS NULL AND coalesce(k.part_number, '') <> '' GROUP BY folder""")
def _(v):
    return val.unknown_parts_by_folder(v.lines(), v.invoices(), v.master())


@register("e11_totals_check", """
    SELECT doc_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(freight AS DOUBLE) AS freight,
           CAST(tax AS DOUBLE) AS tax, CAST(total AS DOUBLE) AS total,
           CAST(subtotal + freight + tax AS DOUBLE) AS expected_total,
           CAST(total - (subtotal + freight + tax) AS DOUBLE) AS discrepancy,
           coalesce(abs(total - (subtotal + freight + tax)) <= 0.01, false) AS totals_valid
    FROM v_section_amounts""")
def _(v):
    return doubles(inv.totals_check(v.sections()), "subtotal", "freight", "tax", "total",
                   "expected_total", "discrepancy")


@register("e12_section_order", """
    SELECT doc_id, count(*) AS n_sections,
           string_agg(section_type, ',' ORDER BY section_pos) = 'SUBTOTAL,FREIGHT,TAX,TOTAL'
             AS sequence_valid
    FROM v_sections GROUP BY doc_id""")
def _(v):
    return inv.section_order(v.sections())


@register("e13_invoice_validity", """
    SELECT c.doc_id, total_line_items, valid_line_items,
           trim(coalesce(invoice_number, '')) <> '' AND invoice_date IS NOT NULL
           AND total_line_items > 0 AND coalesce(s.n_sections, 0) >= 4 AS is_valid
    FROM v_counts c LEFT JOIN v_section_amounts s ON c.doc_id = s.doc_id""")
def _(v):
    return inv.invoice_validity(v.invoices(), v.lines(), v.sections())


@register("e14_quality_gate", """
    SELECT doc_id, errors, errors = '' AS passed,
           CASE WHEN valid_line_items > 0 AND valid_line_items < total_line_items
                THEN 'Data quality: ' || valid_line_items || '/' || total_line_items
                     || ' line items are valid' END AS note FROM v_gate""")
def _(v):
    return inv.quality_gate(v.invoices(), v.lines()).withColumn(
        "errors", F.array_join("errors", "; "))


ANOMALY_SQL = """
    SELECT doc_id, line_id, part_number,
           CASE WHEN validation_status = 'UNKNOWN' THEN 'MISSING_PART'
                WHEN price_difference IS NULL THEN 'DATA_QUALITY_ISSUE'
                ELSE 'PRICE_DISCREPANCY' END AS anomaly_type,
           CASE WHEN price_difference IS NULL THEN 'WARNING'
                WHEN price_difference >= {critical} THEN 'CRITICAL'
                WHEN price_difference >= {warning} THEN 'WARNING'
                ELSE 'INFORMATIONAL' END AS severity
    FROM v_verdicts WHERE validation_status <> 'PASSED'"""


@register("e15_anomaly_summary", f"""
    SELECT doc_id, count(*) FILTER (severity = 'CRITICAL') AS critical_anomalies,
           count(*) FILTER (severity = 'WARNING') AS warning_anomalies,
           count(*) FILTER (severity = 'INFORMATIONAL') AS informational_anomalies,
           count(*) AS total_anomalies
    FROM ({ANOMALY_SQL.format(critical=0.08, warning=0.04)}) GROUP BY doc_id""")
def _(v):
    return val.anomaly_summary(val.anomalies(verdicts(v), "threshold_based", 0.04))


@register("e17_anomaly_severity", ANOMALY_SQL.format(critical=5.0, warning=1.0))
def _(v):
    return val.anomalies(verdicts(v)).select(
        "doc_id", "line_id", "part_number", "anomaly_type", "severity")


@register("e16_price_mismatch", """
    SELECT id, CAST(discovered_price - authorized_price AS DOUBLE) AS price_difference,
           abs(CAST(discovered_price - authorized_price AS DOUBLE)) > 0.001 AS mismatch
    FROM v_log WHERE discovered_price IS NOT NULL AND authorized_price IS NOT NULL""")
def _(v):
    priced = v.log().filter("discovered_price IS NOT NULL AND authorized_price IS NOT NULL")
    return priced.select(
        "id", val.price_difference().cast("double").alias("price_difference"),
        val.is_price_mismatch().alias("mismatch"))


@register("e18_integrity_report", """
    SELECT 'orphaned_log_entries' AS issue, count(*) AS n FROM v_log
    WHERE coalesce(part_number, '') <> ''
      AND part_number NOT IN (SELECT part_number FROM v_master)
    UNION ALL SELECT 'invalid_prices', count(*) FROM v_master WHERE authorized_price <= 0
    UNION ALL SELECT 'invalid_settings', count(*) FROM v_settings
    WHERE (data_type = 'number' AND try_cast(value AS DOUBLE) IS NULL)
       OR (data_type = 'boolean' AND lower(value) NOT IN
           ('true', '1', 'yes', 'on', 'false', '0', 'no', 'off'))
       OR (data_type = 'json' AND NOT json_valid(value))""")
def _(v):
    return val.integrity_report(v.log(), v.master(), v.settings(), setting_error())


@register("f1_line_report", "SELECT * FROM v_line_report")
def _(v):
    return rep.line_report(verdicts(v), v.invoices())


@register("f2_invoice_report", "SELECT * FROM v_line_report UNION ALL " + _total_sql(
    "v_totals", 1, "SUMMARY", "coalesce(invoice_number, '')", "coalesce(invoice_date, '')",
    "'Invoice Totals'", "Total Delta: "))
def _(v):
    return rep.invoice_report(verdicts(v), v.invoices())


@register("f3_batch_report", "SELECT * FROM v_line_report UNION ALL " + _total_sql(
    "v_totals", 1, "SUB-TOTAL", "coalesce(invoice_number, '')", "coalesce(invoice_date, '')",
    "'Invoice ' || coalesce(invoice_number, '') || ' Totals'", "Invoice Delta: ")
    + """ UNION ALL SELECT doc_id, 2, NULL, NULL,
          '', '', '', '', '', '', '', '', '', '', '', '', '', '' FROM v_totals UNION ALL """
    + _total_sql("(SELECT sum(actual) AS actual, sum(expected) AS expected FROM v_totals)", 3,
                 "GRAND TOTAL", "'BATCH'", "''", "'Batch Grand Totals'", "Batch Total Delta: ",
                 "CAST(NULL AS VARCHAR)"))
def _(v):
    return rep.in_report_order(rep.batch_report(verdicts(v), v.invoices()))


def _unnest_sql(source: str, block: int, lines: list[str], keyed: bool = False) -> str:
    keys = "row_idx, line_id" if keyed else \
        "CAST(NULL AS BIGINT) AS row_idx, CAST(NULL AS VARCHAR) AS line_id"
    items = ", ".join(lines)
    return f"""
        SELECT doc_id, {block} AS block, row_idx, line_id, CAST(i - 1 AS INTEGER) AS seq,
               t[i] AS text
        FROM (SELECT doc_id, {keys}, list_filter([{items}], lambda x: x IS NOT NULL) AS t
              FROM {source}) r, unnest(range(1, len(t) + 1)) u(i)"""


def _signed_sql(value: str) -> str:
    return f"CASE WHEN {value} >= 0 THEN '+' ELSE '' END || {money_sql(value)}"


TEXT_VIEWS = {
    "v_error_totals": """
        SELECT doc_id, count(*) FILTER (is_error) AS errors,
               CAST(sum(actual_total) FILTER (is_error) AS DECIMAL(28,4)) AS actual,
               CAST(sum(expected_total) FILTER (is_error) AS DECIMAL(28,4)) AS expected
        FROM v_amounts GROUP BY doc_id""",
    "v_billed": "SELECT * FROM v_invoices WHERE doc_id IN (SELECT doc_id FROM v_summary)",
    "v_billed_sections": """
        SELECT b.doc_id, s.n_missing FROM v_billed b
        LEFT JOIN v_section_amounts s ON b.doc_id = s.doc_id""",
    "v_all_sections": """
        SELECT b.doc_id, s.n_missing FROM v_invoices b
        LEFT JOIN v_section_amounts s ON b.doc_id = s.doc_id""",
}

ERROR_TEXT_SQL = " UNION ALL ".join([
    _unnest_sql("v_error_totals", 20, [
        "'RATE VALIDATION ERRORS:'", f"'{'-' * 24}'",
        "CASE WHEN errors = 0 THEN "
        "'No validation errors found - all rates match authorized prices.' END", "''"]),
    _unnest_sql("v_amounts WHERE is_error", 21, [
        "'Line ' || coalesce(line_number, 'None') || ': ' || coalesce(part_number, 'None') "
        "|| ' - ' || coalesce(description, 'None')",
        f"'  Expected: ' || qty || ' × ' || {money_sql('expected_price')} || ' = ' "
        f"|| {money_sql('expected_total')}",
        f"'  Actual:   ' || qty || ' × ' || {money_sql('actual_price')} || ' = ' "
        f"|| {money_sql('actual_total')}",
        f"'  Delta:    ' || {_signed_sql('(expected_total - actual_total)')}",
        "'  Raw: ' || coalesce(raw_text, 'None')", "''"], keyed=True),
    _unnest_sql("v_error_totals WHERE errors > 0", 22, [
        "'INVOICE SUMMARY:'", f"'{'-' * 16}'",
        f"'Invoice Grand Total:   ' || {money_sql('actual')}",
        f"'Total Delta:           ' || {_signed_sql('(expected - actual)')}",
        f"'Correct Grand Total:   ' || {money_sql('expected')}", "''"]),
])


def _totals_text_sql(docs: str, sections: str) -> str:
    return " UNION ALL ".join([
        _unnest_sql(docs, 10, ["'INVOICE TOTALS VALIDATION:'", f"'{'-' * 26}'"]),
        f"""SELECT doc_id, 11, CAST(section_pos AS BIGINT), NULL, 0,
                   upper(section_type[1]) || lower(section_type[2:]) || ': '
                   || coalesce({money_sql('amount')}, '[Not found]') FROM {sections}""",
        _unnest_sql(docs, 12, [
            "CASE WHEN n_missing IS NULL THEN 'No format validation data available' END",
            "CASE WHEN n_missing IS NULL THEN 'Validation: [SKIPPED]' "
            "WHEN n_missing > 0 THEN 'Validation: FAILED' ELSE 'Validation: PASSED' END", "''"]),
    ])


RATE_SQL = ("CAST(CASE WHEN total_parts > 0 THEN round(CAST(failed_parts AS DECIMAL(18,6)) * 100 "
            "/ total_parts, 1) ELSE 0 END AS DECIMAL(5,1))")


@register("f4_error_text", ERROR_TEXT_SQL, TEXT_VIEWS)
def _(v):
    return rep.error_text(verdicts(v))


@register("f5_totals_text", _totals_text_sql("v_all_sections", "v_sections"), TEXT_VIEWS)
def _(v):
    return rep.totals_text(v.invoices(), v.sections())


@register("f6_text_report", " UNION ALL ".join([
    _unnest_sql("v_billed", 0, [
        "'INVOICE VALIDATION REPORT'", f"'{'=' * 50}'",
        "'Invoice: ' || coalesce(invoice_number, 'Unknown')",
        "'Date: ' || coalesce(invoice_date, 'Unknown')", f"'Generated: {AS_OF}'", "''"]),
    _totals_text_sql("v_billed_sections",
                     "v_sections WHERE doc_id IN (SELECT doc_id FROM v_summary)"),
    ERROR_TEXT_SQL,
    _unnest_sql("v_summary", 30, [
        "'SUMMARY:'", f"'{'-' * 8}'", "'Total Line Items: ' || total_parts",
        "'Passed Validation: ' || passed_parts", "'Failed Validation: ' || failed_parts",
        f"'Error Rate: ' || {RATE_SQL} || '%'", "''"]),
]), TEXT_VIEWS)
def _(v):
    return rep.text_report(verdicts(v), v.invoices(), v.sections(), AS_OF)


@register("s5_error_rate", f"""
    SELECT doc_id, total_parts, failed_parts, CAST({RATE_SQL} AS DOUBLE) AS error_rate
    FROM v_summary""")
def _(v):
    return audit_summary(v.lines(), v.master()).select(
        "doc_id", "total_parts", "failed_parts",
        rep.error_rate(F.col("failed_parts"), F.col("total_parts")).cast("double")
        .alias("error_rate"))
