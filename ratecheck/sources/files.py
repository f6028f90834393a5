"""The inventory of invoice files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files below a folder: path, length, time. Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{pdf,PDF}")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def invoice_files(files: DataFrame) -> DataFrame:
    """The ``.pdf`` / ``.PDF`` files, each path once, in path order (A1)."""
    named = files.filter(F.col("path").rlike(r"\.(pdf|PDF)$"))
    return named.dropDuplicates(["path"]).withColumn(
        "folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).orderBy("path")


def invoice_folders(files: DataFrame) -> DataFrame:
    """Folders that hold invoice files, with how many (A2)."""
    return invoice_files(files).groupBy("folder").count()
