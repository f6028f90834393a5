"""CSV inputs: every column is read as text and parsed row by row without failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratecheck.functions.checks import clean_part_number, clean_price
from ratecheck.functions.keys import blank_to_null, composite_key, is_blank, strip
from ratecheck.functions.text import parse_boolean


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header row, UTF-8, all columns strings.

    Large files are split over tasks. With ``multi_line`` quoted cells may hold line breaks, and
    a file is read by one task.
    """
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"',
                          encoding="UTF-8")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"CSV file must contain columns: {', '.join(missing)}")
    return df


def number_rows(df: DataFrame, start: int = 1) -> DataFrame:
    """Add ``row_no``, consecutive in input order.

    Each task numbers its own rows; the offset of a task is the row count of the tasks
    before it. Only those counts, one per task, are gathered.
    """
    tagged = df.withColumn("_tag", F.monotonically_increasing_id())
    task = F.shiftright("_tag", 33)
    inner = F.col("_tag").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(task.alias("_task")).agg((F.max(inner) + 1).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = tagged.withColumn("_task", task).join(offsets, "_task")
    return placed.withColumn("row_no", inner + F.col("_offset") + F.lit(start)).drop(
        "_tag", "_task", "_offset")


def column_mapping(mapping: DataFrame) -> dict[str, str]:
    """``source_column -> target_column`` of a mapping file; blank pairs are ignored (A4).

    The mapping names columns, so it is as small as a table header.
    """
    require_columns(mapping, "source_column", "target_column")
    pairs = mapping.select(strip("source_column").alias("s"), strip("target_column").alias("t"))
    return {r.s: r.t for r in pairs.filter(~is_blank("s") & ~is_blank("t")).collect()}


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def clean_import(rows: DataFrame) -> DataFrame:
    """Text import rows as typed part columns (A3, A5).

    '$' and ',' are dropped before the price is parsed. Texts lose outer space, blanks
    become null; a missing source is 'imported'. ``price_text`` keeps the price as
    written and ``price`` its exact value.
    """
    require_columns(rows, "part_number", "authorized_price")

    def optional(name: str) -> Column:
        if name in rows.columns:
            return blank_to_null(name)
        return F.lit(None).cast("string")

    active = F.coalesce(parse_boolean("is_active"), F.lit(False)) \
        if "is_active" in rows.columns else F.lit(True)
    keep = ["row_no"] if "row_no" in rows.columns else []
    text = F.translate(strip("authorized_price"), "$,", "")
    typed = rows.select(
        *keep,
        F.coalesce(clean_part_number("part_number"), F.lit("")).alias("part_number"),
        text.alias("price_text"),
        clean_price("authorized_price").alias("price"),
        clean_price("authorized_price", "decimal(18,4)").alias("authorized_price"),
        optional("description").alias("description"),
        optional("item_type").alias("item_type"),
        optional("category").alias("category"),
        F.coalesce(optional("source"), F.lit("imported")).alias("source"),
        optional("first_seen_invoice").alias("first_seen_invoice"),
        active.alias("is_active"),
        optional("notes").alias("notes"),
    )
    return typed.withColumn("composite_key", composite_key())


def usable_import(rows: DataFrame) -> DataFrame:
    """Cleaned rows with a part number and a positive price (A3)."""
    return clean_import(rows).filter(~is_blank("part_number") & (F.col("price") > 0))


UPDATE_FIELDS = ("price", "description", "category", "notes", "status")


def bulk_updates(rows: DataFrame, fields: tuple[str, ...] = UPDATE_FIELDS) -> DataFrame:
    """Change rows: key plus the non-empty chosen fields.

    Rows without any field are dropped, and so are rows whose price is no number.
    """
    require_columns(rows, "part_number")
    available = [f for f in fields if f in rows.columns]
    if not available:
        raise ValueError(f"CSV file must contain at least one of: {', '.join(fields)}")
    values = {f: blank_to_null(f) for f in available}
    readable = F.lit(True)
    if "price" in values:
        text = values.pop("price")
        readable = text.isNull() | text.try_cast("decimal(38,10)").isNotNull()
        values["price_text"] = text
        values["authorized_price"] = text.try_cast("decimal(18,4)")
    typed = rows.filter(readable).select("row_no", clean_part_number("part_number").alias("part_number"),
                        *[c.alias(n) for n, c in values.items()])
    some = F.coalesce(*[F.col(n).cast("string") for n in values]).isNotNull()
    return typed.filter(~is_blank("part_number") & some)


def part_numbers(rows: DataFrame) -> DataFrame:
    """Key list: stripped, upper case, blanks skipped."""
    require_columns(rows, "part_number")
    keep = ["row_no"] if "row_no" in rows.columns else []
    return rows.select(*keep, clean_part_number("part_number").alias("part_number")).filter(
        ~is_blank("part_number"))


def read_parts_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None,
                   multi_line: bool = False) -> DataFrame:
    """A parts file as numbered, cleaned rows; the first data row is number 2."""
    rows = read_text_csv(spark, path, multi_line)
    if mapping:
        rows = rename_columns(rows, mapping)
    return clean_import(number_rows(rows, start=2))
