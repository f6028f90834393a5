"""Catalog: value rules, batch rules, display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecheck.functions import checks, text
from ratecheck.operators import rules
from ratecheck.plans.catalog_audit import doubles, money_sql
from ratecheck.plans.catalog_master import MASTER_VIEWS
from ratecheck.plans.driver_views import DriverViews
from ratecheck.plans.oracle_views import with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PART_NUMBER_SQL = """
    CASE WHEN coalesce(part_number, '') = '' THEN 'Part number must be a non-empty string'
         WHEN trim(part_number) = '' THEN 'Part number cannot be empty or whitespace only'
         WHEN length(trim(part_number)) < 2 THEN 'Part number must be at least 2 characters long'
         WHEN length(trim(part_number)) > 20 THEN 'Part number cannot exceed 20 characters'
         WHEN NOT regexp_full_match(upper(trim(part_number)), '[A-Z0-9_.-]+')
         THEN 'Part number can only contain letters, numbers, underscores, hyphens, and periods'
    END"""

PRICE_SQL = """
    CASE WHEN authorized_price IS NULL THEN 'Price cannot be None'
         WHEN p IS NULL THEN 'Invalid price format'
         WHEN p <= 0 THEN 'Price must be positive'
         WHEN regexp_matches(t, '\\.[0-9]{5,}') THEN 'Price cannot have more than 4 decimal places'
         WHEN p < 0.01 THEN 'Price must be at least $0.01'
         WHEN p > 999999.99 THEN 'Price cannot exceed $999,999.99' END"""

RULE_VIEWS = {
    **MASTER_VIEWS,
    "v_rule_rows": f"""
        SELECT *, {PART_NUMBER_SQL} AS number_error, {PRICE_SQL} AS price_error
        FROM (SELECT *, try_cast(t AS DECIMAL(18,6)) AS p FROM (
          SELECT *, replace(replace(trim(authorized_price), '$', ''), ',', '') AS t
          FROM v_import_rows))""",
    "v_errors": """
        SELECT row_no, 'part_number' AS field, number_error AS message, 'CRITICAL' AS severity
        FROM v_rule_rows WHERE number_error IS NOT NULL
        UNION ALL
        SELECT row_no, 'authorized_price', price_error, 'ERROR' FROM v_rule_rows
        WHERE price_error IS NOT NULL
        UNION ALL
        SELECT row_no, 'category', 'Category is blank', 'WARNING' FROM v_rule_rows
        WHERE trim(coalesce(category, '')) = ''""",
    "v_mail": """
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name
                 ELSE ' ' || replace(c_name, '#', '.') || '@' || c_mktsegment
                      || CASE WHEN c_nationkey < 5 THEN '.c' ELSE '.com' END END AS email
        FROM customer""",
    "v_dates": """
        SELECT o_orderkey, CASE o_orderpriority
                 WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
                 WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y')
                 WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%m-%d-%Y ')
                 WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M')
                 ELSE '' END AS date_text
        FROM orders""",
}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(DriverViews(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, RULE_VIEWS)
        return fn
    return keep


def mails(v):
    return v.table("customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_acctbal < 0 THEN c_name ELSE concat(' ', replace(c_name, '#', '.'), '@', "
        "c_mktsegment, CASE WHEN c_nationkey < 5 THEN '.c' ELSE '.com' END) END AS email")


def dates(v):
    return v.table("orders").selectExpr(
        "o_orderkey",
        "CASE o_orderpriority WHEN '1-URGENT' THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "WHEN '2-HIGH' THEN date_format(o_orderdate, 'MM/dd/yyyy') "
        "WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'MM-dd-yyyy ') "
        "WHEN '4-NOT SPECIFIED' THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm\") "
        "ELSE '' END AS date_text")


@register("g1_part_number_rule", "SELECT row_no, number_error AS error FROM v_rule_rows")
def _(v):
    return v.import_rows().select("row_no", checks.part_number_error("part_number").alias("error"))


@register("g2_loose_part_numbers", """
    SELECT row_no, regexp_full_match(part_number, '[A-Za-z0-9_.-]+') AS plain,
           regexp_full_match(trim(part_number), '[A-Za-z0-9_.-]+')
             AND length(trim(part_number)) >= 2 AS short FROM v_import_rows""")
def _(v):
    return v.import_rows().select(
        "row_no", checks.is_plain_part_number("part_number").alias("plain"),
        checks.is_short_part_number("part_number").alias("short"))


@register("g3_description_rule", """
    SELECT doc_id,
           CASE WHEN coalesce(text, '') = '' THEN 'Description must be a non-empty string'
                WHEN t = '' THEN 'Description cannot be empty or whitespace only'
                WHEN length(t) < 3 THEN 'Description must be at least 3 characters long'
                WHEN length(t) > 200 THEN 'Description cannot exceed 200 characters' END AS error
    FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def _(v):
    return v.table("documents").select("doc_id", checks.description_error("text").alias("error"))


@register("g4_price_rule", "SELECT row_no, price_error AS error FROM v_rule_rows")
def _(v):
    return v.import_rows().select("row_no", checks.price_error("authorized_price").alias("error"))


@register("g5_email_rule", """
    SELECT c_custkey, CASE WHEN regexp_matches(lower(trim(email)),
             '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN NULL
             ELSE 'Invalid email address format' END AS error FROM v_mail""")
def _(v):
    return mails(v).select("c_custkey", checks.email_error("email").alias("error"))


@register("g6_date_rule", """
    SELECT o_orderkey, CASE WHEN date_text = '' THEN 'Date cannot be empty'
             WHEN NOT regexp_full_match(trim(date_text), '[0-9]{4}-[0-9]{2}-[0-9]{2}'
                  || '|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}')
             THEN 'Invalid date format' END AS error FROM v_dates""")
def _(v):
    return dates(v).select("o_orderkey", checks.date_error("date_text").alias("error"))


@register("g7_invoice_date_rule", """
    SELECT o_orderkey, regexp_matches(trim(date_text),
             '^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})') AS valid
    FROM v_dates""")
def _(v):
    return dates(v).select("o_orderkey", checks.is_invoice_date("date_text").alias("valid"))


@register("g8_invoice_number_rule", """
    SELECT doc_id, regexp_full_match(trim(invoice_number), '[0-9]{8,}') AS valid
    FROM v_invoices""")
def _(v):
    return v.invoices().select("doc_id", checks.is_invoice_number("invoice_number").alias("valid"))


@register("g9_integer_rule", """
    SELECT key, CASE WHEN NOT regexp_full_match(trim(value), '[+-]?[0-9]+')
                     THEN 'Invalid integer value'
                     WHEN CAST(trim(value) AS BIGINT) < 1 THEN 'Value must be at least 1'
                     WHEN CAST(trim(value) AS BIGINT) > 5 THEN 'Value cannot exceed 5' END AS error
    FROM (SELECT key, CASE WHEN data_type = 'number' THEN regexp_replace(value, '\\.[0-9]+$', '')
                           ELSE value END AS value FROM v_settings)""")
def _(v):
    whole = F.when(F.col("data_type") == "number",
                   F.regexp_replace("value", r"\.[0-9]+$", "")).otherwise(F.col("value"))
    return v.settings().select("key", checks.integer_error(whole, 1, 5).alias("error"))


@register("g10_key_name_rule", """
    SELECT key, CASE WHEN NOT regexp_full_match(lower(trim(key)), '[a-z][a-z0-9_]*')
                     THEN 'Configuration key must start with a letter and contain only '
                          || 'lowercase letters, numbers, and underscores' END AS error
    FROM (SELECT CASE WHEN data_type = 'json' THEN '9' || key ELSE upper(key) END AS key
          FROM v_settings)""")
def _(v):
    keys = v.settings().selectExpr(
        "CASE WHEN data_type = 'json' THEN concat('9', key) ELSE upper(key) END AS key")
    return keys.select("key", checks.key_name_error("key").alias("error"))


@register("g11_session_id_rule", """
    SELECT id, CASE WHEN coalesce(processing_session_id, '') = ''
                    THEN 'Session ID cannot be empty'
                    WHEN length(processing_session_id) NOT BETWEEN 8 AND 50
                    THEN 'Session ID must be between 8 and 50 characters' END AS error
    FROM v_log""")
def _(v):
    return v.log().select("id", checks.session_id_error("processing_session_id").alias("error"))


@register("g12_currency_text", f"""
    SELECT id, coalesce({money_sql('discovered_price')}, 'N/A') AS currency,
           {money_sql('discovered_price', 4)} AS price FROM v_log""")
def _(v):
    return v.log().select("id", text.format_currency("discovered_price").alias("currency"),
                          text.format_price("discovered_price").alias("price"))


@register("g13_time_text", """
    SELECT id, coalesce(strftime(discovery_date, '%Y-%m-%d %H:%M:%S'), 'N/A') AS shown
    FROM v_log_entries""")
def _(v):
    return v.log_entries().select("id", text.format_datetime("discovery_date").alias("shown"))


@register("g14_boolean_text", """
    SELECT id, CASE WHEN action_taken = 'added' THEN 'Yes'
                    WHEN discovered_price IS NULL THEN 'N/A' ELSE 'No' END AS shown FROM v_log""")
def _(v):
    flag = F.when(F.col("action_taken") == "added", F.lit(True)).when(
        F.col("discovered_price").isNotNull(), F.lit(False))
    return v.log().select("id", text.format_boolean(flag).alias("shown"))


@register("g15_truncated_text", """
    SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 50 THEN coalesce(text, '')
                        ELSE substr(text, 1, 47) || '...' END AS shown FROM documents""")
def _(v):
    return v.table("documents").select("doc_id", text.truncate_text("text").alias("shown"))


@register("g16_boolean_words", """
    SELECT key, lower(value) IN ('true', '1', 'yes') AS import_flag,
           lower(value) IN ('true', '1', 'yes', 'active') AS status_flag FROM v_settings""")
def _(v):
    return v.settings().select("key", text.parse_boolean("value").alias("import_flag"),
                               text.parse_boolean("value", ("active",)).alias("status_flag"))


@register("g17_typed_values", """
    SELECT key, CASE WHEN data_type = 'string' THEN value END AS string_value,
           CASE WHEN data_type = 'number' THEN try_cast(value AS DOUBLE) END AS number_value,
           CASE WHEN data_type = 'boolean' THEN
             CASE WHEN lower(value) IN ('true', '1', 'yes', 'on') THEN true
                  WHEN lower(value) IN ('false', '0', 'no', 'off') THEN false END END
             AS boolean_value,
           CASE WHEN data_type = 'json' AND json_valid(value) THEN value END AS json_value,
           CASE WHEN data_type = 'number' AND try_cast(value AS DOUBLE) IS NULL
                THEN 'Cannot convert to number'
                WHEN data_type = 'boolean' AND lower(value) NOT IN
                     ('true', '1', 'yes', 'on', 'false', '0', 'no', 'off')
                THEN 'Cannot convert to boolean'
                WHEN data_type = 'json' AND NOT json_valid(value) THEN 'Cannot parse json' END
             AS error
    FROM v_settings""")
def _(v):
    return v.settings().select("key", text.typed_value().alias("t")).select("key", "t.*")


@register("g18_value_text", """
    SELECT event_id, CAST(value AS VARCHAR) AS number_text,
           CASE WHEN value < 20 THEN 'true' ELSE 'false' END AS boolean_text,
           '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS json_text
    FROM events""")
def _(v):
    record = F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))
    return v.table("events").select(
        "event_id", text.value_text(F.col("value"), "number").alias("number_text"),
        text.value_text(F.col("value") < 20, "boolean").alias("boolean_text"),
        text.value_text(record, "json").alias("json_text"))


@register("g19_inferred_types", """
    SELECT key, CASE WHEN lower(value) IN ('true', '1', 'yes', 'on', 'false', '0', 'no', 'off')
                     THEN 'boolean' WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 'number'
                     WHEN regexp_matches(value, '^[\\{\\[].*[\\}\\]]$') AND json_valid(value)
                     THEN 'json' ELSE 'string' END AS inferred FROM v_settings""")
def _(v):
    return v.settings().select("key", text.inferred_type("value").alias("inferred"))


@register("h1_batch_result", """
    SELECT count(*) AS total_count, count(*) FILTER (price_error IS NULL) AS success_count,
           count(*) FILTER (price_error IS NOT NULL) AS error_count,
           round(count(*) FILTER (price_error IS NULL) * 100.0 / count(*), 6) AS success_rate,
           CAST(NULL AS VARCHAR) AS warning FROM v_rule_rows""")
def _(v):
    checked = rules.check(v.import_rows(), "authorized_price", checks.price_error)
    return rules.batch_result(checked, "price").withColumn(
        "success_rate", F.round("success_rate", 6))


@register("h1_stop_at_first_error", """
    WITH f AS (SELECT min(row_no) AS n FROM v_rule_rows WHERE number_error IS NOT NULL),
    c AS (SELECT count(*) AS total FROM v_rule_rows),
    s AS (SELECT count(*) FILTER (number_error IS NULL) AS ok,
                 count(*) FILTER (number_error IS NOT NULL) AS bad
          FROM v_rule_rows, f WHERE n IS NULL OR row_no <= n)
    SELECT total AS total_count, ok AS success_count, bad AS error_count,
           round(ok * 100.0 / total, 6) AS success_rate,
           CASE WHEN ok * 100.0 / total < 50 THEN 'Low success rate: '
                || CAST(round(ok * 100.0 / total, 1) AS DECIMAL(5,1))
                || '% of part_number items validated successfully' END AS warning
    FROM s, c""")
def _(v):
    rows = v.import_rows()
    checked = rules.check(rows, "part_number", checks.part_number_error)
    return rules.batch_result(rules.until_first_error(checked), "part_number", rows).withColumn(
        "success_rate", F.round("success_rate", 6))


@register("h2_row_rules", """
    SELECT row_no, CASE WHEN number_error IS NOT NULL OR price_error IS NOT NULL
             THEN 'Row ' || row_no || ' validation failed: ' || concat_ws('; ',
                  'part_number: ' || number_error, 'authorized_price: ' || price_error)
             END AS error, 'Unexpected fields ignored: notes' AS warning
    FROM v_rule_rows""")
def _(v):
    rows = v.import_rows().select("row_no", "part_number", "authorized_price", "notes")
    return rules.check_rows(rows, {
        "part_number": checks.part_number_error, "authorized_price": checks.price_error,
    }).select("row_no", "error", "warning")


@register("c21_import_dry_run", """
    SELECT count(*) AS total_count,
           count(*) FILTER (number_error IS NULL AND price_error IS NULL) AS success_count,
           count(*) FILTER (number_error IS NOT NULL OR price_error IS NOT NULL) AS error_count,
           round(count(*) FILTER (number_error IS NULL AND price_error IS NULL) * 100.0
                 / count(*), 6) AS success_rate,
           CAST(NULL AS VARCHAR) AS warning FROM v_rule_rows""")
def _(v):
    checked = rules.check_rows(v.import_rows(), {
        "part_number": checks.part_number_error, "authorized_price": checks.price_error})
    return rules.batch_result(checked, "part_data").withColumn(
        "success_rate", F.round("success_rate", 6))


def error_rows(v):
    rows = v.import_rows()
    number = rows.select("row_no", F.lit("part_number").alias("field"),
                         checks.part_number_error("part_number").alias("message"),
                         F.lit("CRITICAL").alias("severity"))
    price = rows.select("row_no", F.lit("authorized_price").alias("field"),
                        checks.price_error("authorized_price").alias("message"),
                        F.lit("ERROR").alias("severity"))
    blank = F.trim(F.coalesce("category", F.lit(""))) == ""
    category = rows.select("row_no", F.lit("category").alias("field"),
                           F.when(blank, "Category is blank").alias("message"),
                           F.lit("WARNING").alias("severity"))
    return number.unionByName(price).unionByName(category).filter(F.col("message").isNotNull())


@register("h3_error_digest", """
    WITH n AS (SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS c,
                      count(*) FILTER (severity = 'ERROR') AS e,
                      count(*) FILTER (severity = 'WARNING') AS w FROM v_errors),
    r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY row_no, field) AS seq,
                 CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'ERROR' THEN 2 ELSE 3 END AS block
          FROM v_errors),
    f AS (SELECT * FROM v_errors ORDER BY row_no, field LIMIT 10),
    a AS (SELECT row_no, field, i AS pos, s[i] AS advice FROM (
            SELECT row_no, field, CASE
              WHEN field = 'part_number' THEN [
                'Use only alphanumeric characters, underscores, hyphens, and periods',
                'Ensure part number is 2-20 characters long',
                'Example: GP0171NAVY, ITEM-123, PART_001']
              WHEN field = 'authorized_price' THEN [
                'Enter a positive number (e.g., 15.50, 0.25)', 'Use maximum 4 decimal places',
                'Remove currency symbols ($) if present']
              ELSE ['Check the input format and try again',
                    'Refer to command help for format requirements'] END AS s FROM f),
          unnest(range(1, len(s) + 1)) u(i)),
    t AS (SELECT advice, row_number() OVER (ORDER BY min((row_no, field, pos))) AS seq
          FROM a GROUP BY advice)
    SELECT 0 AS block, 0 AS seq, 'Found ' || total || ' validation error(s):' AS text FROM n
    UNION ALL SELECT 0, 1, repeat('-', 50) FROM n
    UNION ALL SELECT 9, -1, '' FROM n
    UNION ALL SELECT 9, 0, '💡 SUGGESTIONS:' FROM n
    UNION ALL SELECT 1, 0, 'CRITICAL ERRORS:' FROM n WHERE c > 0
    UNION ALL SELECT 2, 0, 'ERRORS:' FROM n WHERE e > 0
    UNION ALL SELECT 3, 0, 'WARNINGS:' FROM n WHERE w > 0
    UNION ALL SELECT block, seq, '  • ' || field || ': ' || message FROM r, n
    WHERE seq <= CASE block WHEN 1 THEN 10 WHEN 2 THEN greatest(0, 10 - c)
                            ELSE greatest(1, 10 - c - e) END
    UNION ALL SELECT 8, 0, '... and ' || (total - 10) || ' more errors' FROM n WHERE total > 10
    UNION ALL SELECT 9, seq, '  • ' || advice FROM t WHERE seq <= 5""")
def _(v):
    return rules.error_digest(error_rows(v)).select(
        F.col("block").cast("int"), F.col("seq").cast("bigint"), "text")


@register("h4_suggestions", """
    SELECT row_no, field, CASE WHEN field = 'part_number'
             THEN 'Use only alphanumeric characters, underscores, hyphens, and periods'
             WHEN field = 'authorized_price' THEN 'Enter a positive number (e.g., 15.50, 0.25)'
             ELSE 'Check the input format and try again' END AS first_advice,
           CASE WHEN field = 'category' THEN 2 ELSE 3 END AS advice_count
    FROM v_errors""")
def _(v):
    advice = rules.suggestions(F.col("field"), F.col("message"))
    return error_rows(v).select("row_no", "field", advice[0].alias("first_advice"),
                                F.size(advice).alias("advice_count"))
