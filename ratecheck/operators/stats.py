"""Statistics of the master table and the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecheck.functions.keys import is_blank
from ratecheck.session import cut_lineage


def _two_places(c: Column) -> Column:
    return F.round(c, 2)


def parts_statistics(master: DataFrame, category: str | None = None) -> DataFrame:
    """Counts, category count and active price range (S1). A category leaves only counts."""
    chosen = master.filter(F.col("category") == category) if category else master
    active = F.col("is_active")
    price = F.when(active, F.col("authorized_price"))
    counts = [
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if(active).alias("active_parts"),
        F.count_if(~active).alias("inactive_parts"),
    ]
    if category:
        return chosen.agg(*counts).withColumn(
            "categories_count", F.when(F.col("total_parts") > 0, 1).otherwise(0))
    return chosen.agg(
        *counts,
        F.count_distinct(F.when(~is_blank("category"), F.col("category")))
        .alias("categories_count"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        _two_places(F.avg(price)).alias("avg_price"),
    )


def category_breakdown(master: DataFrame) -> DataFrame:
    """Parts per non-empty category, largest first."""
    return master.filter(~is_blank("category")).groupBy("category").count().orderBy(
        F.desc("count"), "category")


def upper_median(df: DataFrame, column: str = "authorized_price", parts: int = 32) -> DataFrame:
    """The element at position n // 2 of the sorted column, exactly.

    Values are counted once each and range-partitioned. The rows before a value are those of
    the ranges before, one sum per range, and those before it in its own range; the value
    whose span holds the rank is the median. No rows give no row.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("median")).agg(
        F.count(F.lit(1)).alias("n"))
    ranged = cut_lineage(
        counts.repartitionByRange(parts, "median").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("part_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "part", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("before"),
        F.floor(F.sum("part_n").over(everything) / 2).alias("rank"))
    inside = Window.partitionBy("part").orderBy("median").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("n").over(inside)
    placed = ranged.join(offsets, "part").withColumn("upto", upto)
    return placed.filter("upto - n <= rank AND rank < upto").select("median")


def detailed_statistics(master: DataFrame) -> DataFrame:
    """Counts and active price statistics with the upper median."""
    active = F.col("is_active")
    price = F.when(active, F.col("authorized_price"))
    median = upper_median(master.filter("is_active"))
    return master.agg(
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if(active).alias("active_parts"),
        F.count_if(~active).alias("inactive_parts"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.round(F.avg(price), 6).alias("avg_price"),
    ).withColumn("median_price", median.scalar())


def _named_category() -> Column:
    return F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized"))


def active_categories(master: DataFrame) -> DataFrame:
    """Active parts per category, blanks as Uncategorized."""
    return master.filter("is_active").groupBy(_named_category().alias("category")).count()


def source_counts(master: DataFrame) -> DataFrame:
    return master.groupBy("source").count()


def display_statistics(master: DataFrame, category: str | None = None) -> DataFrame:
    """Statistics as shown: zero prices without active parts, and the top category (S3).

    Categories tied for the top fall to the first by name.
    """
    chosen = master.filter(F.col("category") == category) if category else master
    per_category = chosen.groupBy(_named_category().alias("category")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_active").alias("active"),
        F.min(F.when(F.col("is_active"), F.col("authorized_price"))).alias("low"),
        F.max(F.when(F.col("is_active"), F.col("authorized_price"))).alias("high"),
        F.sum(F.when(F.col("is_active"), F.col("authorized_price"))).alias("sum"))
    shown = F.col("active") > 0
    zero = F.lit(0).cast("bigint")
    price = F.lit(0).cast("decimal(18,4)")
    average = F.sum("sum") / F.nullif(F.sum("active"), F.lit(0))
    top = F.min(F.when(shown, F.struct((-F.col("active")).alias("n"), "category")))
    return per_category.agg(
        F.coalesce(F.sum("total"), zero).alias("total_parts"),
        F.coalesce(F.sum("active"), zero).alias("active_parts"),
        (F.coalesce(F.sum("total"), zero) - F.coalesce(F.sum("active"), zero))
        .alias("inactive_parts"),
        F.coalesce(_two_places(average), F.lit(0)).alias("average_price"),
        F.coalesce(F.min("low"), price).alias("min_price"),
        F.coalesce(F.max("high"), price).alias("max_price"),
        F.count_if(shown).alias("categories"),
        F.coalesce(top["category"], F.lit("None")).alias("top_category"),
    )


def table_counts(master: DataFrame, settings: DataFrame, log: DataFrame) -> DataFrame:
    """Row counts of the stored tables."""
    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))

    return (
        counted("parts", master)
        .unionByName(counted("active_parts", master.filter("is_active")))
        .unionByName(counted("config", settings))
        .unionByName(counted("discovery_log", log))
    )


def missing_columns(tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> DataFrame:
    """Required tables and columns that are absent.

    Works on schemas only: no table is read.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "table_name string, column_name string"
    found = [(t, c) for t, df in tables.items() for c in df.columns]
    wanted = [(t, c) for t, columns in expected.items() for c in columns]
    return spark.createDataFrame(wanted, schema).exceptAll(
        spark.createDataFrame(found, schema))
