"""Catalog: the master table, its imports and bulk changes, and its statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecheck.functions.keys import composite_key, normalize_component
from ratecheck.operators import bulk, imports, master as mas, stats
from ratecheck.plans.catalog_audit import doubles
from ratecheck.plans.driver_views import AS_OF, DriverViews
from ratecheck.plans.oracle_views import NORMAL, key_sql, with_views
from ratecheck.sources import csv_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

CLEAN = "nullif(trim({0}), '')"

MASTER_VIEWS = {
    # Import rows after cleaning, with the first reason to refuse each.
    "v_clean": f"""
        SELECT *, {key_sql()} AS composite_key FROM (
          SELECT row_no, upper(trim(part_number)) AS part_number,
                 replace(replace(trim(authorized_price), '$', ''), ',', '') AS price_text,
                 try_cast(replace(replace(trim(authorized_price), '$', ''), ',', '')
                          AS DECIMAL(18,6)) AS price,
                 {CLEAN.format('description')} AS description,
                 {CLEAN.format('item_type')} AS item_type,
                 {CLEAN.format('category')} AS category,
                 coalesce({CLEAN.format('source')}, 'imported') AS source,
                 lower(is_active) IN ('true', '1', 'yes') AS is_active,
                 {CLEAN.format('notes')} AS notes
          FROM v_import_rows)""",
    "v_checked": """
        SELECT *, CAST(price AS DECIMAL(18,4)) AS authorized_price,
               CASE WHEN part_number = '' THEN 'Missing part_number'
                    WHEN price_text = '' THEN 'Missing authorized_price'
                    WHEN price IS NULL THEN 'Invalid price format'
                    WHEN price <= 0 THEN 'Invalid price (must be positive)'
                    WHEN regexp_matches(price_text, '\\.[0-9]{5,}')
                      THEN 'Authorized price cannot have more than 4 decimal places'
                    WHEN source NOT IN ('manual', 'discovered', 'imported')
                      THEN 'Source must be one of: manual, discovered, imported' END AS error
        FROM v_clean""",
    "v_valid": """
        SELECT c.*, m.composite_key IS NOT NULL AS known,
               min(row_no) OVER (PARTITION BY c.composite_key) AS first_row,
               max(row_no) OVER (PARTITION BY c.composite_key) AS last_row
        FROM v_checked c LEFT JOIN v_master m ON c.composite_key = m.composite_key
        WHERE error IS NULL""",
    "v_outcome": """
        SELECT row_no, part_number, composite_key,
               CASE WHEN NOT known AND row_no = first_row THEN 'created' ELSE 'updated' END
                 AS outcome, CAST(NULL AS VARCHAR) AS error FROM v_valid
        UNION ALL SELECT row_no, part_number, composite_key, 'error', error FROM v_checked
        WHERE error IS NOT NULL""",
    "v_numbers": """
        SELECT part_number AS lookup, min(composite_key) AS target_key FROM v_master
        WHERE part_number IS NOT NULL GROUP BY 1""",
    "v_changes": """
        SELECT row_no, upper(trim(part_number)) AS part_number,
               nullif(trim(price), '') AS price_text,
               try_cast(nullif(trim(price), '') AS DECIMAL(18,4)) AS authorized_price,
               nullif(trim(description), '') AS description,
               nullif(trim(category), '') AS category, nullif(trim(notes), '') AS notes,
               nullif(trim(status), '') AS status
        FROM v_change_rows
        WHERE trim(part_number) <> ''
          AND (trim(price) = '' OR try_cast(trim(price) AS DECIMAL(18,6)) IS NOT NULL)
          AND (trim(price) <> '' OR trim(description) <> '' OR trim(category) <> ''
               OR trim(status) <> '')""",
    "v_located": """
        SELECT c.*, n.target_key, m.category AS old_category, m.is_active AS old_active,
               m.authorized_price AS old_price, m.description AS old_description
        FROM v_changes c LEFT JOIN v_numbers n ON c.part_number = n.lookup
        LEFT JOIN v_master m ON n.target_key = m.composite_key""",
    "v_cut": """
        SELECT l.*, min(CASE WHEN target_key IS NOT NULL AND NOT coalesce(authorized_price <= 0, false)
                              AND old_category = 'Category Brand#2' AND category <> old_category
                             THEN row_no END) OVER (PARTITION BY target_key) AS last_row
        FROM v_located l""",
    "v_updates": """
        SELECT *, CASE WHEN target_key IS NULL THEN 'not_found'
                       WHEN authorized_price <= 0 THEN 'errors' ELSE 'updated' END AS outcome
        FROM v_located""",
    "v_requests": """
        SELECT p_partkey AS row_no, upper(trim(part_number)) AS part_number
        FROM (SELECT row_no AS p_partkey, part_number FROM v_change_rows)
        WHERE trim(part_number) <> ''""",
    "v_found": """
        SELECT r.*, n.target_key, m.category AS old_category, m.is_active AS old_active,
               min(row_no) OVER (PARTITION BY r.part_number) AS first_row
        FROM v_requests r LEFT JOIN v_numbers n ON r.part_number = n.lookup
        LEFT JOIN v_master m ON n.target_key = m.composite_key""",
    "v_merged": f"""
        SELECT composite_key, part_number, authorized_price, description, item_type, category,
               source, first_seen_invoice, is_active, notes, created_date, last_updated
        FROM v_master WHERE composite_key NOT IN (SELECT composite_key FROM v_valid)
        UNION ALL
        SELECT v.composite_key, v.part_number, v.authorized_price, v.description, v.item_type,
               v.category, v.source, NULL, v.is_active, v.notes,
               coalesce(m.created_date, TIMESTAMP '{AS_OF}'), TIMESTAMP '{AS_OF}'
        FROM v_valid v LEFT JOIN v_master m ON v.composite_key = m.composite_key
        WHERE v.row_no = v.last_row""",
}

SHOWN = ["composite_key", "part_number", "authorized_price", "description", "item_type",
         "category", "source", "is_active"]
SHOWN_SQL = ("composite_key, part_number, CAST(authorized_price AS DOUBLE) AS authorized_price, "
             "description, item_type, category, source, is_active")


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(DriverViews(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, MASTER_VIEWS)
        return fn
    return keep


def shown(df):
    return doubles(df.select(*SHOWN), "authorized_price")


def dated(df):
    """Whole rows with times as text."""
    return doubles(df, "authorized_price").withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_date", "last_updated")})


DATED_SQL = """composite_key, part_number, CAST(authorized_price AS DOUBLE) AS authorized_price,
    description, item_type, category, source, first_seen_invoice, is_active, notes,
    strftime(created_date, '%Y-%m-%d %H:%M:%S') AS created_date,
    strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated"""


@register("c1_composite_key", f"""
    SELECT line_id, doc_id, {NORMAL.format('description')} AS component,
           {key_sql()} AS composite_key FROM v_lines""")
def _(v):
    return v.lines().select("line_id", "doc_id",
                            normalize_component("description").alias("component"),
                            composite_key().alias("composite_key"))


@register("c2_part_rules", """
    SELECT row_no, concat_ws('; ',
             CASE WHEN price IS NULL THEN 'Authorized price must be a number' END,
             CASE WHEN price <= 0 THEN 'Authorized price must be positive' END,
             CASE WHEN regexp_matches(price_text, '\\.[0-9]{5,}')
                  THEN 'Authorized price cannot have more than 4 decimal places' END,
             CASE WHEN source NOT IN ('manual', 'discovered', 'imported')
                  THEN 'Source must be one of: manual, discovered, imported' END) AS errors
    FROM v_clean""")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return rows.select("row_no", F.array_join(mas.part_errors("price_text"), "; ").alias("errors"))


@register("c3_insert_if_absent", f"""
    SELECT {SHOWN_SQL} FROM v_master UNION ALL
    SELECT {SHOWN_SQL} FROM v_valid WHERE NOT known AND row_no = first_row""")
def _(v):
    new = imports.valid_rows(csv_files.clean_import(v.import_rows()))
    now = F.lit(AS_OF).cast("timestamp")
    new = new.withColumns({"created_date": now, "last_updated": now})
    return shown(mas.insert_if_absent(v.master(), new, ["row_no"]))


@register("c3_rejected_inserts", """
    SELECT row_no, composite_key,
           CASE WHEN known THEN 'exists in master' ELSE 'repeated in input' END AS reason
    FROM v_valid WHERE known OR row_no > first_row""")
def _(v):
    new = imports.valid_rows(csv_files.clean_import(v.import_rows()))
    return mas.rejected_inserts(v.master(), new, "row_no").select(
        "row_no", "composite_key", "reason")


@register("c4_import_upsert", f"SELECT {DATED_SQL} FROM v_merged")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return dated(imports.import_upsert(v.master(), rows, AS_OF, update_existing=True))


@register("c4_import_new_only", f"""
    SELECT {SHOWN_SQL} FROM v_master UNION ALL
    SELECT {SHOWN_SQL} FROM v_valid WHERE NOT known AND row_no = first_row""")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return shown(imports.import_upsert(v.master(), rows, AS_OF, update_existing=False))


@register("c5_import_counts", "SELECT outcome, count(*) AS count FROM v_outcome GROUP BY outcome")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return imports.outcome_counts(imports.import_outcomes(rows, v.master(), True))


@register("c5_import_by_number", f"""
    WITH g AS (SELECT {SHOWN_SQL} FROM v_master UNION ALL
               SELECT {SHOWN_SQL} FROM v_valid WHERE NOT known AND row_no = first_row),
    n AS (SELECT part_number AS lookup, min(composite_key) AS target FROM g GROUP BY 1),
    r AS (SELECT v.*, n.target,
                 row_number() OVER (PARTITION BY n.target ORDER BY v.row_no DESC) AS rn
          FROM v_valid v JOIN n ON v.part_number = n.lookup
          WHERE v.known OR v.row_no > v.first_row)
    SELECT g.composite_key, g.part_number,
           CASE WHEN r.target IS NULL THEN g.authorized_price
                ELSE CAST(r.authorized_price AS DOUBLE) END AS authorized_price,
           CASE WHEN r.target IS NULL THEN g.description ELSE r.description END AS description,
           g.item_type,
           CASE WHEN r.target IS NULL THEN g.category ELSE r.category END AS category,
           g.source, g.is_active
    FROM g LEFT JOIN r ON g.composite_key = r.target AND r.rn = 1""")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return shown(imports.import_by_number(v.master(), rows, AS_OF))


@register("c6_import_errors", """
    SELECT row_no, 'Row ' || row_no || ': ' || error AS message FROM v_outcome
    WHERE outcome = 'error'""")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return imports.import_errors(imports.import_outcomes(rows, v.master(), True))


@register("c7_import_totals", """
    SELECT count(*) AS total_rows, count(*) FILTER (outcome <> 'error') AS valid_rows_processed,
           count(*) FILTER (outcome = 'error') AS invalid_rows_skipped,
           count(*) FILTER (outcome <> 'error') > 0 AS success FROM v_outcome""")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return imports.import_totals(imports.import_outcomes(rows, v.master(), True))


@register("c7_import_outcomes", "SELECT row_no, part_number, outcome, error FROM v_outcome")
def _(v):
    rows = csv_files.clean_import(v.import_rows())
    return imports.import_outcomes(rows, v.master(), True).select(
        "row_no", "part_number", "outcome", "error")


@register("c8_lookup_by_number", """
    SELECT row_no, part_number, n.target_key FROM v_requests r
    LEFT JOIN v_numbers n ON r.part_number = n.lookup""")
def _(v):
    return mas.resolve(csv_files.part_numbers(v.change_rows()), v.master(), "part_number").select(
        "row_no", "part_number", "target_key")


@register("c8_lookup_by_components", f"""
    SELECT l.doc_id, l.line_id, m.composite_key, CAST(m.authorized_price AS DOUBLE) AS price,
           m.category
    FROM (SELECT *, {key_sql()} AS request_key FROM v_lines) l
    LEFT JOIN v_master m ON l.request_key = m.composite_key""")
def _(v):
    return mas.find_by_components(v.lines(), v.master()).select(
        "doc_id", "line_id", F.col("part.composite_key"),
        F.col("part.authorized_price").cast("double").alias("price"), F.col("part.category"))


UPDATED_SQL = f"""
    WITH u AS (SELECT target_key,
                 arg_max(authorized_price, row_no) FILTER (authorized_price IS NOT NULL) AS price,
                 arg_max(description, row_no) FILTER (description IS NOT NULL) AS description,
                 arg_max(category, row_no) FILTER (category IS NOT NULL) AS category,
                 arg_max(status, row_no) FILTER (status IS NOT NULL) AS status
               FROM v_updates WHERE outcome = 'updated' GROUP BY target_key)
    SELECT {{key}} AS composite_key, m.part_number,
           CAST(coalesce(u.price, m.authorized_price) AS DOUBLE) AS authorized_price,
           coalesce(u.description, m.description) AS description, m.item_type,
           coalesce(u.category, m.category) AS category, m.source,
           coalesce(lower(u.status) IN ('true', '1', 'yes', 'active'), m.is_active) AS is_active
    FROM v_master m LEFT JOIN u ON m.composite_key = u.target_key"""


def _update_outcomes(v, category=None):
    return bulk.update_outcomes(csv_files.bulk_updates(v.change_rows()), v.master(), category)


@register("c9_update_with_new_keys", UPDATED_SQL.format(key=(
    "CASE WHEN u.target_key IS NULL THEN m.composite_key ELSE "
    + key_sql("m.item_type", "coalesce(u.description, m.description)", "m.part_number")
    + " END")))
def _(v):
    from ratecheck.functions.text import parse_boolean
    done = _update_outcomes(v).filter("outcome = 'updated'")
    last = done.groupBy("target_key").agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("row_no"))).alias(f)
        for f in ("authorized_price", "description", "category", "status")])
    last = last.withColumn("is_active", parse_boolean("status", ("active",))).drop("status")
    return shown(mas.update_parts(v.master(), last, AS_OF, rekey=True))


@register("c10_soft_delete", f"""
    SELECT {SHOWN_SQL.replace('is_active', '''is_active AND part_number NOT IN
        (SELECT part_number FROM v_requests) AS is_active''')},
      strftime(CASE WHEN part_number IN (SELECT part_number FROM v_requests)
                    THEN TIMESTAMP '{AS_OF}' ELSE last_updated END, '%Y-%m-%d %H:%M:%S')
        AS last_updated FROM v_master""")
def _(v):
    after = mas.delete_parts(v.master(), csv_files.part_numbers(v.change_rows()),
                             "part_number", soft=True, as_of=AS_OF)
    return doubles(after.select(*SHOWN, F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss")
                                .alias("last_updated")), "authorized_price")


@register("c10_hard_delete", f"""
    SELECT {SHOWN_SQL} FROM v_master
    WHERE part_number NOT IN (SELECT part_number FROM v_requests)""")
def _(v):
    return shown(mas.delete_parts(v.master(), csv_files.part_numbers(v.change_rows()),
                                  "part_number", soft=False))


@register("c11_list_parts", f"""
    SELECT {SHOWN_SQL} FROM v_master WHERE is_active ORDER BY composite_key
    LIMIT 50 OFFSET 20""")
def _(v):
    return shown(mas.list_parts(v.master(), active_only=True, limit=50, offset=20))


@register("c11_list_category", f"""
    SELECT {SHOWN_SQL} FROM v_master WHERE category = 'Category Brand#2' ORDER BY composite_key""")
def _(v):
    return shown(mas.list_parts(v.master(), active_only=False, category="Category Brand#2"))


@register("c12_sorted_page", f"""
    SELECT {SHOWN_SQL} FROM (SELECT * FROM v_master WHERE is_active ORDER BY composite_key
                             LIMIT 100)
    ORDER BY authorized_price DESC, composite_key""")
def _(v):
    page = mas.list_parts(v.master(), active_only=True, limit=100)
    return shown(mas.sorted_page(page, "price", descending=True))


@register("c13_search_parts", f"""
    SELECT {SHOWN_SQL} FROM v_master
    WHERE contains(lower(coalesce(part_number, '')), 'ring')
       OR contains(lower(coalesce(description, '')), 'ring')
       OR contains(lower(coalesce(category, '')), 'ring')""")
def _(v):
    return shown(mas.search_parts(v.master(), "Ring"))


@register("c14_price_range", f"""
    SELECT {SHOWN_SQL} FROM v_master
    WHERE is_active AND authorized_price >= 910.5 AND authorized_price <= 950.25""")
def _(v):
    return shown(mas.price_range(v.master(), "910.5", "950.25"))


@register("c15_active_parts", f"""
    SELECT {SHOWN_SQL.replace(', is_active', '')} FROM v_master WHERE is_active""")
def _(v):
    return doubles(mas.active_parts(v.master()).select(
        *[c for c in SHOWN if c != "is_active"]), "authorized_price")


@register("c16_set_category", f"""
    SELECT {SHOWN_SQL.replace('category,', '''CASE WHEN composite_key IN
        (SELECT target_key FROM v_found WHERE target_key IS NOT NULL)
        THEN 'Reviewed' ELSE category END AS category,''')} FROM v_master""")
def _(v):
    ids = csv_files.part_numbers(v.change_rows())
    return shown(mas.set_category(v.master(), ids, "part_number", "Reviewed", AS_OF))


@register("c16_missing_parts", """
    SELECT row_no, part_number, 'Part ' || part_number || ' not found' AS error
    FROM v_found WHERE target_key IS NULL""")
def _(v):
    return mas.missing_parts(v.master(), csv_files.part_numbers(v.change_rows()), "part_number")


@register("c17_bulk_update", UPDATED_SQL.format(key="m.composite_key"))
def _(v):
    return shown(bulk.apply_updates(_update_outcomes(v), v.master(), AS_OF))


@register("c17_bulk_update_counts", """
    SELECT count(*) AS total_parts, count(*) FILTER (outcome = 'updated') AS updated,
           count(*) FILTER (outcome = 'not_found') AS not_found,
           count(*) FILTER (outcome = 'filtered_out') AS filtered_out,
           count(*) FILTER (outcome = 'errors') AS errors,
           CAST(ceil(count(*) / 50) AS BIGINT) AS batches FROM v_updates""")
def _(v):
    return bulk.outcome_totals(_update_outcomes(v))


@register("c17_filtered_update_counts", """
    SELECT count(*) AS total_parts, count(*) FILTER (o = 'updated') AS updated,
           count(*) FILTER (o = 'not_found') AS not_found,
           count(*) FILTER (o = 'filtered_out') AS filtered_out,
           count(*) FILTER (o = 'errors') AS errors,
           CAST(ceil(count(*) / 50) AS BIGINT) AS batches
    FROM (SELECT CASE WHEN target_key IS NULL THEN 'not_found'
                      WHEN old_category IS DISTINCT FROM 'Category Brand#2'
                           OR coalesce(row_no > last_row, false) THEN 'filtered_out'
                      WHEN authorized_price <= 0 THEN 'errors' ELSE 'updated' END AS o
          FROM v_cut)""")
def _(v):
    return bulk.outcome_totals(_update_outcomes(v, "Category Brand#2"))


@register("c18_update_preview", """
    SELECT row_no, part_number, CAST(old_price AS DOUBLE) AS current_authorized_price,
           CAST(authorized_price AS DOUBLE) AS new_authorized_price,
           old_description AS current_description, description AS new_description,
           old_category AS current_category, category AS new_category,
           old_active AS current_is_active,
           lower(status) IN ('true', '1', 'yes', 'active') AS new_is_active
    FROM v_located WHERE target_key IS NOT NULL""")
def _(v):
    out = bulk.update_preview(csv_files.bulk_updates(v.change_rows()), v.master())
    return doubles(out, "current_authorized_price", "new_authorized_price")


@register("c19_bulk_delete_counts", """
    SELECT CASE WHEN target_key IS NULL OR row_no > first_row THEN 'not_found' ELSE 'deleted' END
             AS outcome, count(*) AS count FROM v_found GROUP BY 1""")
def _(v):
    out = bulk.delete_outcomes(csv_files.part_numbers(v.change_rows()), v.master(), soft=False)
    return imports.outcome_counts(out)


@register("c19_bulk_delete", f"""
    SELECT {SHOWN_SQL} FROM v_master
    WHERE part_number NOT IN (SELECT part_number FROM v_found
                              WHERE old_category = 'Category Brand#2')""")
def _(v):
    out = bulk.delete_outcomes(csv_files.part_numbers(v.change_rows()), v.master(), soft=False,
                               filter_category="Category Brand#2")
    return shown(bulk.apply_deletes(out, v.master(), soft=False))


@register("c19_delete_preview", """
    SELECT row_no, part_number, old_category AS category,
           CASE WHEN old_active THEN 'Active' ELSE 'Inactive' END AS status,
           'Deactivate' AS deletion_type FROM v_found WHERE target_key IS NOT NULL""")
def _(v):
    return bulk.delete_preview(csv_files.part_numbers(v.change_rows()), v.master())


@register("c20_bulk_activate_counts", """
    SELECT CASE WHEN target_key IS NULL THEN 'not_found'
                WHEN old_active OR row_no > first_row THEN 'already_active'
                ELSE 'activated' END AS outcome, count(*) AS count FROM v_found GROUP BY 1""")
def _(v):
    return imports.outcome_counts(
        bulk.activate_outcomes(csv_files.part_numbers(v.change_rows()), v.master()))


@register("c20_bulk_activate", f"""
    SELECT {SHOWN_SQL.replace('is_active', '''is_active OR composite_key IN
        (SELECT target_key FROM v_found WHERE target_key IS NOT NULL) AS is_active''')}
    FROM v_master""")
def _(v):
    out = bulk.activate_outcomes(csv_files.part_numbers(v.change_rows()), v.master())
    return shown(bulk.apply_activations(out, v.master(), AS_OF))


@register("c20_activate_preview", """
    SELECT row_no, part_number, old_category AS category FROM v_found WHERE NOT old_active""")
def _(v):
    return bulk.activate_preview(csv_files.part_numbers(v.change_rows()), v.master())


# ---- input cleaning -----------------------------------------------------------------


@register("a3_parts_csv_rows", f"""
    SELECT row_no, composite_key, part_number, CAST(CAST(price AS DECIMAL(18,4)) AS DOUBLE)
             AS authorized_price, description, category, source, is_active, notes
    FROM v_clean WHERE part_number <> '' AND price > 0""")
def _(v):
    return doubles(csv_files.usable_import(v.import_rows()).select(
        "row_no", "composite_key", "part_number", "authorized_price", "description", "category",
        "source", "is_active", "notes"), "authorized_price")


@register("a4_column_rename", """
    SELECT row_no, upper(trim(part_number)) AS part_number, nullif(trim(description), '')
             AS description FROM v_import_rows""")
def _(v):
    spark = v.spark
    rows = v.import_rows().withColumnsRenamed({"part_number": "item_code", "description": "desc"})
    mapping = spark.createDataFrame(
        [("item_code", "part_number"), (" desc ", "description"), ("", "notes"), ("x", "")],
        "source_column string, target_column string")
    renamed = csv_files.rename_columns(rows, csv_files.column_mapping(mapping))
    return csv_files.clean_import(renamed).select("row_no", "part_number", "description")


@register("a5_import_cleaning", """
    SELECT row_no, part_number, price_text, CAST(CAST(price AS DECIMAL(18,4)) AS DOUBLE)
             AS authorized_price, description, category, notes FROM v_clean""")
def _(v):
    return doubles(csv_files.clean_import(v.import_rows()).select(
        "row_no", "part_number", "price_text", "authorized_price", "description", "category",
        "notes"), "authorized_price")


@register("a6_bulk_update_rows", """
    SELECT row_no, part_number, CAST(authorized_price AS DOUBLE) AS authorized_price,
           description, category, notes, status FROM v_changes""")
def _(v):
    return doubles(csv_files.bulk_updates(v.change_rows()).drop("price_text"), "authorized_price")


@register("a7_key_list", "SELECT row_no, part_number FROM v_requests")
def _(v):
    return csv_files.part_numbers(v.change_rows())


# ---- statistics ---------------------------------------------------------------------


@register("s1_parts_statistics", """
    SELECT count(*) AS total_parts, count(*) FILTER (is_active) AS active_parts,
           count(*) FILTER (NOT is_active) AS inactive_parts,
           count(DISTINCT nullif(category, '')) AS categories_count,
           CAST(min(authorized_price) FILTER (is_active) AS DOUBLE) AS min_price,
           CAST(max(authorized_price) FILTER (is_active) AS DOUBLE) AS max_price,
           CAST(round(CAST(sum(authorized_price) FILTER (is_active) AS DECIMAL(28,8))
                / count(*) FILTER (is_active), 2) AS DOUBLE) AS avg_price
    FROM v_master""")
def _(v):
    return doubles(stats.parts_statistics(v.master()), "min_price", "max_price", "avg_price")


@register("s1_category_statistics", """
    SELECT count(*) AS total_parts, count(*) FILTER (is_active) AS active_parts,
           count(*) FILTER (NOT is_active) AS inactive_parts,
           CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS categories_count
    FROM v_master WHERE category = 'Category Brand#2'""")
def _(v):
    return stats.parts_statistics(v.master(), "Category Brand#2")


@register("s1_category_breakdown", """
    SELECT category, count(*) AS count FROM v_master WHERE category <> '' GROUP BY category""")
def _(v):
    return stats.category_breakdown(v.master())


@register("s2_detailed_statistics", """
    SELECT count(*) AS total_parts, count(*) FILTER (is_active) AS active_parts,
           count(*) FILTER (NOT is_active) AS inactive_parts,
           CAST(min(authorized_price) FILTER (is_active) AS DOUBLE) AS min_price,
           CAST(max(authorized_price) FILTER (is_active) AS DOUBLE) AS max_price,
           CAST(round(CAST(sum(authorized_price) FILTER (is_active) AS DECIMAL(28,8))
                / count(*) FILTER (is_active), 6) AS DOUBLE) AS avg_price,
           CAST(list_sort(list(authorized_price) FILTER (is_active))
                [count(*) FILTER (is_active) // 2 + 1] AS DOUBLE) AS median_price
    FROM v_master""")
def _(v):
    return doubles(stats.detailed_statistics(v.master()),
                   "min_price", "max_price", "avg_price", "median_price")


@register("s2_active_categories", """
    SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, count(*) AS count
    FROM v_master WHERE is_active GROUP BY 1""")
def _(v):
    return stats.active_categories(v.master())


@register("s2_source_counts", "SELECT source, count(*) AS count FROM v_master GROUP BY source")
def _(v):
    return stats.source_counts(v.master())


@register("s3_display_statistics", """
    WITH c AS (SELECT coalesce(nullif(category, ''), 'Uncategorized') AS category, count(*) AS n
               FROM v_master WHERE is_active GROUP BY 1)
    SELECT count(*) AS total_parts, count(*) FILTER (is_active) AS active_parts,
           count(*) FILTER (NOT is_active) AS inactive_parts,
           CAST(round(CAST(sum(authorized_price) FILTER (is_active) AS DECIMAL(28,8))
                / count(*) FILTER (is_active), 2) AS DOUBLE) AS average_price,
           CAST(min(authorized_price) FILTER (is_active) AS DOUBLE) AS min_price,
           CAST(max(authorized_price) FILTER (is_active) AS DOUBLE) AS max_price,
           (SELECT count(*) FROM c) AS categories,
           (SELECT category FROM c ORDER BY n DESC, category LIMIT 1) AS top_category
    FROM v_master""")
def _(v):
    return doubles(stats.display_statistics(v.master()), "average_price", "min_price", "max_price")


@register("s4_table_counts", """
    SELECT 'parts' AS table_name, count(*) AS n FROM v_master
    UNION ALL SELECT 'active_parts', count(*) FROM v_master WHERE is_active
    UNION ALL SELECT 'config', count(*) FROM v_settings
    UNION ALL SELECT 'discovery_log', count(*) FROM v_log""")
def _(v):
    return stats.table_counts(v.master(), v.settings(), v.log())
