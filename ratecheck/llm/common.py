"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def digest_number(value: Column) -> Column:
    """The first 60 bits of a column's MD5 as a non-negative long; -1 for null."""
    text = value.cast("string")
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate tables.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, as in tests, a
    folder below the warehouse serves, on a local master only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later jobs start from files that every executor sees, whichever executor wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark a staged table for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= most_rows else df


def running(df: DataFrame, order: list[Column], values: dict[str, Column], parts: int = 32
            ) -> DataFrame:
    """Add the sum of each value over all earlier rows of a total order.

    Rows are range-partitioned, summed within a range, and shifted by the sum of the ranges
    before; the only rows in one task are one per range. ``values`` names the new columns.
    """
    ranged = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    ranged = stage(
        ranged.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "running")
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[
        F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = (Window.partitionBy("_part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, *[
        (F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0))).alias(k)
        for k in values])
