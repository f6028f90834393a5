"""Nested invoice records and their flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecheck.functions.keys import is_blank
from ratecheck.operators.invoices import is_valid_line
from ratecheck.schemas import EXTRACTION, INVOICE_RECORD

PAGE_LINES = 10_000


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction documents, one JSON object per file, with their path."""
    return spark.read.schema(EXTRACTION).json(path, multiLine=True).withColumn(
        "doc_id", F.col("_metadata.file_path"))


def parse_extractions(texts: DataFrame, column: str = "json") -> DataFrame:
    return texts.select("doc_id", F.from_json(column, EXTRACTION).alias("r")).select("doc_id", "r.*")


def flat_lines(records: DataFrame) -> DataFrame:
    """Lines of extraction records, with the defaults of missing keys."""
    each = records.select(
        "doc_id", F.coalesce("invoice_metadata.invoice_number", F.lit("UNKNOWN"))
        .alias("invoice_number"),
        F.coalesce("invoice_metadata.invoice_date", F.lit("")).alias("invoice_date"),
        F.coalesce("invoice_metadata.first_line", F.lit(0)).alias("first_line"),
        F.posexplode("parts").alias("pos", "p"))
    place = (F.col("first_line") + F.col("pos")).cast("bigint")
    db, line = F.col("p.database_fields"), F.col("p.lineitem_fields")
    return each.select(
        "doc_id", "invoice_number", "invoice_date",
        place.alias("row_idx"), place.cast("string").alias("line_id"),
        line["line_number"].alias("line_number"), db["part_number"].alias("part_number"),
        F.coalesce(db["description"], F.lit("")).alias("description"),
        db["item_type"].alias("item_type"), db["authorized_price"].alias("rate"),
        line["quantity"].alias("quantity"), line["total"].alias("total"),
        F.coalesce(db["source"], F.lit("extracted")).alias("source"),
        F.coalesce(line["raw_text"], F.lit("")).alias("raw_text"))


def flat_sections(records: DataFrame) -> DataFrame:
    each = records.select("doc_id", F.posexplode("format_sections").alias("pos", "s"))
    return each.select("doc_id", F.col("s.section_type").alias("section_type"),
                       (F.col("pos") + 1).alias("section_pos"), F.col("s.amount").alias("amount"))


def paged(lines: DataFrame, size: int = PAGE_LINES) -> DataFrame:
    """Add ``page``: a nested record holds the lines of one page of ``size`` rows at most.

    Every invoice is paged by its row numbers, whatever its length, so pages keep line order.
    """
    page = F.floor(F.coalesce("row_idx", F.lit(0)) / size)
    return lines.withColumn("page", page.cast("int"))


def numbered(pages: DataFrame) -> DataFrame:
    """Add ``first_line``, the lines on earlier pages, and ``first_page`` to rows of pages.

    ``pages`` has one narrow row per page with its number of ``lines``.
    """
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(
        Window.unboundedPreceding, -1)
    return pages.withColumns({
        "first_line": F.coalesce(F.sum("lines").over(before), F.lit(0)),
        "first_page": F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) == 1})


def _gathered(value: Column) -> Column:
    """Values in line order."""
    ordered = F.sort_array(F.collect_list(F.struct("row_idx", "line_id", value.alias("v"))))
    return F.transform(ordered, lambda s: s["v"])


def nest_extractions(lines: DataFrame, invoices: DataFrame, sections: DataFrame,
                     size: int = PAGE_LINES) -> DataFrame:
    """Extraction records of the valid lines, one per page (A8, the producing side).

    Sections and the number of all lines stand in the record of an invoice's first page only.
    ``first_line`` says how many lines the pages before hold.
    """
    fields = F.struct(
        "row_idx", "line_id", "part_number", "rate", "description", "item_type", "line_number",
        "quantity", "total", "raw_text")

    def part(line: Column, head: Column) -> Column:
        return F.struct(line["row_idx"], line["line_id"], F.struct(
            F.struct(
                line["part_number"].alias("part_number"), line["rate"].alias("authorized_price"),
                line["description"].alias("description"), line["item_type"].alias("item_type"),
                F.lit(None).cast("string").alias("category"), F.lit("extracted").alias("source"),
                head["invoice_number"].alias("first_seen_invoice")).alias("database_fields"),
            F.struct(*[line[c].alias(c) for c in ("line_number", "quantity", "total", "raw_text")])
            .alias("lineitem_fields")).alias("v"))

    heads = invoices.select("doc_id", "invoice_number", "invoice_date", "customer_number")
    # The numbers of an invoice join its pages, not its lines, so lines travel once.
    numbers = heads.groupBy("doc_id").agg(
        F.collect_list(F.struct("invoice_number")).alias("numbers"))
    valid = paged(lines.filter(is_valid_line()), size)
    lists = valid.groupBy("doc_id", "page").agg(F.collect_list(fields).alias("lines"))
    counts = numbered(valid.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines")))
    whole = counts.groupBy("doc_id").agg(F.sum("lines").cast("int").alias("all_lines"))
    amounts = sections.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("section_pos", "section_type", "amount"))),
        lambda s: F.struct(s["section_type"].alias("section_type"), s["amount"].alias("amount"),
                           F.lit(None).cast("string").alias("raw_text"),
                           F.lit(None).cast("string").alias("line_number"))).alias("amounts"))
    headed = counts.drop("lines").join(whole, "doc_id").join(numbers, "doc_id", "left").join(
        heads, "doc_id", "left").join(amounts, "doc_id", "left")
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("invoice_number")))
    each = F.flatten(F.transform("lines", lambda line: F.transform(
        F.coalesce("numbers", unknown), lambda head: part(line, head))))
    parts = F.transform(F.sort_array(each), lambda s: s["v"]).alias("parts")
    return lists.join(headed, ["doc_id", "page"]).select(
        "doc_id", "page",
        F.struct("invoice_number", "invoice_date", "customer_number",
                 F.lit(None).cast("string").alias("customer_name"),
                 F.when(F.col("first_page"), F.col("all_lines")).alias("total_line_items"),
                 F.col("first_line").cast("int").alias("first_line")).alias("invoice_metadata"),
        F.when(F.col("first_page"), F.col("amounts")).alias("format_sections"), parts)


def nest_invoices(lines: DataFrame, invoices: DataFrame, size: int = PAGE_LINES) -> DataFrame:
    """Invoice records with their lines as an array, one record per page."""
    item = F.struct(F.col("part_number").alias("item_code"), "description", "item_type", "rate",
                    "quantity", "total", "line_number", "raw_text")
    arrays = paged(lines, size).groupBy("doc_id", "page").agg(_gathered(item).alias("line_items"))
    return arrays.join(invoices, "doc_id", "left").select(
        "doc_id", "page", "invoice_number", "invoice_date", "customer_number",
        F.lit(None).cast("string").alias("customer_name"), "line_items")


def to_text(records: DataFrame) -> DataFrame:
    """Records as JSON text."""
    body = [c for c in records.columns if c not in ("doc_id", "page")]
    return records.select("doc_id", "page", F.to_json(F.struct(*body)).alias("json"))


def invoices_from_text(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "page", F.from_json("json", INVOICE_RECORD).alias("r")).select(
        "doc_id", "page", "r.*")


def nest_verdicts(verdicts: DataFrame, invoices: DataFrame, size: int = PAGE_LINES) -> DataFrame:
    """Validation results as nested records, one per page.

    The summary counts the whole invoice and stands in the record of its first page only.
    """
    part = F.struct("line_number", "part_number", "description", "item_type", "rate", "quantity",
                    "total", "database_price", "price_difference", "validation_status",
                    "validation_errors", "raw_text")
    status = F.col("validation_status")
    # Dealt by invoice, as its summary is: lines travel once, gathered pages not at all.
    pages = paged(verdicts, size).repartition("doc_id").groupBy("doc_id", "page").agg(
        _gathered(part).alias("parts"),
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if(status == "PASSED").alias("passed_parts"),
        F.count_if(status == "FAILED").alias("failed_parts"),
        F.count_if(status == "UNKNOWN").alias("unknown_parts"))
    own = Window.partitionBy("doc_id")
    names = ("total_parts", "passed_parts", "failed_parts", "unknown_parts")
    summary = F.struct(*[F.sum(n).over(own).alias(n) for n in names])
    first = F.row_number().over(own.orderBy("page")) == 1
    return pages.withColumns({"_summary": summary, "_first": first}).join(
        invoices.select("doc_id", "invoice_number", "invoice_date"), "doc_id", "left").select(
        "doc_id", "page",
        F.struct("invoice_number", "invoice_date").alias("invoice_metadata"), "parts",
        F.filter("parts", lambda p: p["validation_status"] != "PASSED").alias("error_lines"),
        F.when(F.col("_first"), F.col("_summary")).alias("validation_summary"))


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: ISO times, plain decimals, true / false."""
    def text(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(field.name)
        return c.cast("string").alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])


def typed_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns by a schema; values that do not parse become null."""
    def parsed(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            flag = F.lower(c).isin("true", "1", "yes")
            return F.when(~is_blank(c), flag).alias(field.name)
        return F.nullif(c, F.lit("")).try_cast(field.dataType).alias(field.name)

    return df.select(*[parsed(f) for f in schema.fields])
