"""The audit tables as views over the driver's parquet tables.

Every view is a plain projection or join of whole tables; nothing is sampled. Attributes
the driver tables lack (category, activity, broken input text and so on) are derived
from attributes they have, so each rule meets rows that pass and rows that fail.
``ratecheck.plans.oracle_views`` states the same views in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecheck.functions.keys import composite_key
from ratecheck.operators.master import first_per_key
from ratecheck.session import configure
from ratecheck.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"

# Parts not authorized yet have numbers of their own; of the others two share a number.
PART_NUMBER = ("CASE WHEN p_brand = 'Brand#25' THEN concat('U-', p_partkey) "
               "ELSE concat('P-', p_partkey div 2) END")

PART_COLUMNS = [
    f"{PART_NUMBER} AS part_number",
    "CAST(p_retailprice AS DECIMAL(18,4)) AS authorized_price",
    "p_name AS description",
    "p_type AS item_type",
    "CASE WHEN p_size <= 8 THEN NULL WHEN p_size <= 12 THEN '' "
    "ELSE concat('Category ', p_brand) END AS category",
    "CASE WHEN p_size <= 16 THEN 'manual' WHEN p_size <= 33 THEN 'discovered' "
    "ELSE 'imported' END AS source",
    "CASE WHEN p_size BETWEEN 17 AND 33 THEN concat('INV', p_partkey) END AS first_seen_invoice",
    "timestampadd(DAY, p_size, TIMESTAMP '2024-01-01 00:00:00') AS created_date",
    "timestampadd(DAY, p_size + 1, TIMESTAMP '2024-01-01 00:00:00') AS last_updated",
    "p_size < 44 AS is_active",
    "p_brand AS notes",
]


class DriverViews:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    # ---- master table -------------------------------------------------------------
    def parts_all(self) -> DataFrame:
        """Every part, before key uniqueness; ``row_no`` is the arrival order."""
        return (
            self.table("part").selectExpr("p_partkey AS row_no", *PART_COLUMNS)
            .withColumn("composite_key", composite_key())
        )

    def master(self) -> DataFrame:
        """One row per key; parts of one brand are not authorized yet."""
        authorized = self.parts_all().filter("notes <> 'Brand#25'")
        return first_per_key(authorized, ["composite_key"], ["row_no"]).drop("row_no")

    # ---- invoices -----------------------------------------------------------------
    def invoices(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('doc-', o_orderkey) AS doc_id",
            "o_orderpriority AS folder",
            "concat('/invoices/', o_orderpriority, '/doc-', o_orderkey, '.pdf') AS path",
            "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' "
            "THEN concat('X', o_orderkey) ELSE CAST(10000000 + o_orderkey AS STRING) END "
            "AS invoice_number",
            "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL "
            "ELSE date_format(o_orderdate, 'MM/dd/yyyy') END AS invoice_date",
            "CAST(o_custkey AS STRING) AS customer_number",
        )

    def lines(self) -> DataFrame:
        priced = self.table("lineitem").join(
            self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return priced.selectExpr(
            "concat('doc-', l_orderkey) AS doc_id",
            "CAST(l_linenumber AS BIGINT) AS row_idx",
            "concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS line_id",
            "CAST(l_linenumber AS STRING) AS line_number",
            "CASE WHEN l_quantity = 50 THEN NULL WHEN l_quantity = 49 THEN '' "
            f"ELSE {PART_NUMBER} END AS part_number",
            "CASE WHEN l_quantity = 48 THEN NULL "
            "WHEN l_returnflag = 'A' THEN concat('  ', upper(p_name), ' ') "
            "ELSE p_name END AS description",
            "p_type AS item_type",
            "CASE WHEN l_tax = 0.08 THEN NULL "
            "WHEN l_returnflag = 'R' THEN CAST(CAST(p_retailprice AS DECIMAL(18,4)) "
            "+ CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4)) "
            "ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS rate",
            "CAST(l_quantity AS INT) AS quantity",
            "l_tax",
        ).selectExpr(
            "doc_id", "row_idx", "line_id", "line_number", "part_number", "description",
            "item_type", "rate", "quantity",
            "CASE WHEN l_tax = 0.07 THEN NULL WHEN l_tax = 0.06 THEN CAST(0 AS DECIMAL(18,4)) "
            "ELSE CAST(rate * quantity AS DECIMAL(18,4)) END AS total",
            "concat_ws(' | ', line_number, 'A Wearer', part_number, trim(description), '', "
            "item_type, quantity, CAST(rate AS STRING), '0.00') AS raw_text",
        )

    def sections(self) -> DataFrame:
        """Four amounts per order: some wrong, some missing, some out of order."""
        amounts = self.table("orders").selectExpr(
            "concat('doc-', o_orderkey) AS doc_id", "o_orderstatus", "o_orderpriority",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal")
        return amounts.selectExpr(
            "doc_id", "o_orderstatus", "o_orderpriority",
            "stack(4, 'SUBTOTAL', 1, subtotal, "
            "'FREIGHT', CASE WHEN o_orderpriority = '2-HIGH' THEN 3 ELSE 2 END, "
            "CAST(12.50 AS DECIMAL(18,2)), "
            "'TAX', CASE WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 3 END, "
            "CAST(7.25 AS DECIMAL(18,2)), "
            "'TOTAL', 4, CAST(subtotal + CASE WHEN o_orderstatus = 'F' THEN 20.75 "
            "ELSE 19.75 END AS DECIMAL(18,2))) "
            "AS (section_type, section_pos, amount)",
        ).filter("NOT (section_type = 'TAX' AND o_orderpriority = '5-LOW')").selectExpr(
            "doc_id", "section_type", "section_pos",
            "CASE WHEN section_type = 'TAX' AND o_orderpriority = '3-MEDIUM' "
            "AND o_orderstatus = 'O' THEN NULL ELSE CAST(amount AS DECIMAL(18,4)) END AS amount",
        )

    # ---- discovery log ------------------------------------------------------------
    def log(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS id",
            "concat('P-', user_id) AS part_number",
            "CASE WHEN value >= 5 THEN concat('INV', event_id div 10) END AS invoice_number",
            "date_format(ts, 'MM/dd/yyyy') AS invoice_date",
            "CASE WHEN event_type = 'error' AND value < 20 THEN NULL "
            "WHEN value < 1 THEN CAST(0 AS DECIMAL(18,4)) "
            "ELSE CAST(value AS DECIMAL(18,4)) END AS discovered_price",
            "CASE WHEN event_type IN ('purchase', 'error') "
            "THEN CAST(100 AS DECIMAL(18,4)) END AS authorized_price",
            "CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'purchase' THEN 'added' "
            "WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'updated' "
            "ELSE 'price_mismatch' END AS action_taken",
            "CAST(NULL AS STRING) AS user_decision",
            "CAST(ts AS TIMESTAMP) AS discovery_date",
            "CASE WHEN value > 150 THEN NULL WHEN value > 140 THEN '' "
            "ELSE concat('session-', event_id div 50) END AS processing_session_id",
            "CASE WHEN value < 30 THEN props END AS notes",
        )

    def log_entries(self) -> DataFrame:
        """Entries offered to the log: some break a rule, some have no time yet."""
        return self.log().selectExpr(
            "id",
            "CASE WHEN discovered_price BETWEEN 1 AND 3 THEN '' ELSE part_number END "
            "AS part_number",
            "invoice_number", "invoice_date", "discovered_price", "authorized_price",
            "CASE WHEN action_taken = 'updated' AND discovered_price < 40 THEN 'collected' "
            "ELSE action_taken END AS action_taken",
            "user_decision",
            "CASE WHEN action_taken = 'skipped' THEN NULL ELSE discovery_date END "
            "AS discovery_date",
            "processing_session_id", "notes",
        )

    # ---- input files as all-string rows -----------------------------------------------
    def import_rows(self) -> DataFrame:
        """A parts CSV as read: text only, with blanks, bad prices and repeats."""
        return self.table("part").selectExpr(
            "p_partkey AS row_no",
            "CASE WHEN p_size = 1 THEN '' WHEN p_size <= 25 THEN concat(' p-', p_partkey div 2) "
            "ELSE concat('n-', p_partkey div 4, ' ') END AS part_number",
            "CASE p_size WHEN 2 THEN '' WHEN 3 THEN 'not_a_number' WHEN 4 THEN '-5.00' "
            "WHEN 5 THEN '$1,234.56' WHEN 6 THEN '12.34567' "
            "ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING) END AS authorized_price",
            "CASE WHEN p_size > 25 THEN ' bulk item' ELSE p_name END AS description",
            "CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS item_type",
            "CASE WHEN p_size < 10 THEN '  ' ELSE concat('Import ', p_type) END AS category",
            "CASE WHEN p_size = 7 THEN 'batch' WHEN p_size < 30 THEN 'imported' "
            "ELSE 'manual' END AS source",
            "CASE WHEN p_size < 40 THEN 'True' ELSE 'no' END AS is_active",
            "p_brand AS notes",
        )

    def change_rows(self) -> DataFrame:
        """A bulk-update CSV as read; numbers repeat and some are unknown."""
        return self.table("part").selectExpr(
            "p_partkey AS row_no",
            "CASE WHEN p_size = 50 THEN '  ' ELSE concat('p-', p_partkey * 2 div 3) END "
            "AS part_number",
            "CASE WHEN p_size < 10 THEN '' WHEN p_size = 11 THEN 'abc' WHEN p_size = 12 THEN '-1' "
            "ELSE concat(p_size, '.50') END AS price",
            "CASE WHEN p_size BETWEEN 15 AND 30 THEN concat('Renamed ', p_name) ELSE '' END "
            "AS description",
            "CASE WHEN p_size BETWEEN 25 AND 35 THEN 'Bulk' ELSE '' END AS category",
            "'' AS notes",
            "CASE WHEN p_size > 40 THEN 'active' WHEN p_size > 30 THEN 'no' ELSE '' END AS status",
        )

    def decisions(self) -> DataFrame:
        """Answers for unknown parts: add, skip, or an unusable price."""
        return self.parts_all().filter("notes = 'Brand#25'").groupBy("composite_key").agg(
            F.min("row_no").alias("row_no"),
        ).selectExpr(
            "composite_key",
            "CASE WHEN row_no < 400 THEN 'skip' ELSE 'add_to_database_now' END AS action",
            "CASE WHEN row_no < 800 THEN CAST(0 AS DECIMAL(18,4)) "
            "ELSE CAST(10.25 AS DECIMAL(18,4)) END AS decided_price",
            "CAST(NULL AS STRING) AS decided_category",
        )

    def settings(self) -> DataFrame:
        """Key / text value / declared type rows; some values do not parse."""
        return self.table("events").selectExpr(
            "concat(event_type, '_', event_id) AS key",
            "CASE event_type WHEN 'view' THEN CAST(CAST(value AS DECIMAL(10,2)) AS STRING) "
            "WHEN 'click' THEN CASE WHEN value < 20 THEN 'Yes' WHEN value < 40 THEN 'off' "
            "WHEN value < 60 THEN '1' ELSE 'maybe' END "
            "WHEN 'signup' THEN CASE WHEN value < 60 THEN props ELSE concat('{', props) END "
            "WHEN 'purchase' THEN CASE WHEN value < 60 THEN 'n/a' ELSE '12e2' END "
            "ELSE concat('text ', user_id) END AS value",
            "CASE event_type WHEN 'view' THEN 'number' WHEN 'click' THEN 'boolean' "
            "WHEN 'signup' THEN 'json' WHEN 'purchase' THEN 'number' "
            "ELSE 'string' END AS data_type",
        )
