"""Imports into the master: one outcome per input row, and the merged master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.keys import is_blank
from ratecheck.operators.master import (
    first_per_key, insert_if_absent, last_per_key, part_errors, resolve, update_parts,
)


def import_error() -> Column:
    """First reason to refuse a cleaned import row, or null."""
    rules = part_errors("price_text")
    return (
        F.when(is_blank("part_number"), "Missing part_number")
        .when(is_blank("price_text"), "Missing authorized_price")
        .when(F.col("price").isNull(), "Invalid price format")
        .when(F.col("price") <= 0, "Invalid price (must be positive)")
        .otherwise(F.element_at(F.when(F.size(rules) > 0, rules), 1))
    )


def import_outcomes(rows: DataFrame, master: DataFrame, update_existing: bool) -> DataFrame:
    """created / updated / skipped / error per row.

    A row creates its part when the key is new and no earlier row has it. ``rows`` are
    cleaned rows with a unique ``row_no``.
    """
    checked = rows.withColumn("error", import_error())
    valid = checked.filter(F.col("error").isNull())
    known = master.select("composite_key", F.lit(True).alias("_known"))
    firsts = valid.groupBy("composite_key").agg(F.min("row_no").alias("_first")).join(
        known, "composite_key", "left")
    repeat = F.lit("updated" if update_existing else "skipped")
    marked = valid.join(firsts, "composite_key").withColumn(
        "outcome",
        F.when(F.col("_known").isNull() & (F.col("row_no") == F.col("_first")), "created")
        .otherwise(repeat)).drop("_known", "_first")
    refused = checked.filter(F.col("error").isNotNull()).withColumn("outcome", F.lit("error"))
    return marked.unionByName(refused)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").count()


def import_errors(outcomes: DataFrame) -> DataFrame:
    """Numbered messages of refused rows."""
    return outcomes.filter("outcome = 'error'").select(
        "row_no", F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "),
                           F.col("error")).alias("message"))


def import_totals(outcomes: DataFrame) -> DataFrame:
    """Totals and the success flag of an import with error handling."""
    done = F.count_if(F.col("outcome").isin("created", "updated"))
    total = F.count(F.lit(1))
    return outcomes.agg(
        total.alias("total_rows"), done.alias("valid_rows_processed"),
        (total - done).alias("invalid_rows_skipped"),
        ((done > 0) | (total == 0)).alias("success"))


def valid_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("error", import_error()).filter(F.col("error").isNull()).drop("error")


VALUE_COLUMNS = ["part_number", "authorized_price", "description", "item_type", "category",
                 "source", "first_seen_invoice", "is_active", "notes"]


def import_upsert(master: DataFrame, rows: DataFrame, as_of: str,
                  update_existing: bool = False) -> DataFrame:
    """Merged master (C4): new keys are created, known keys replaced only on request.

    Rows of one key apply in order, so the last one wins with ``update_existing`` and the
    first one without. One full join on the key.
    """
    pick = last_per_key if update_existing else first_per_key
    incoming = pick(valid_rows(rows).select("row_no", "composite_key", *VALUE_COLUMNS),
                    ["composite_key"], ["row_no"])
    now = F.lit(as_of).cast("timestamp")
    fresh = incoming.select("composite_key", F.struct(*VALUE_COLUMNS).alias("_new"))
    joined = master.withColumn("_old", F.lit(True)).join(fresh, "composite_key", "full")
    is_new = F.col("_old").isNull()
    take_new = is_new | (F.col("_new").isNotNull() if update_existing else F.lit(False))
    return joined.select(
        "composite_key",
        *[F.when(take_new, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in VALUE_COLUMNS],
        F.when(is_new, now).otherwise(F.col("created_date")).alias("created_date"),
        F.when(take_new, now).otherwise(F.col("last_updated")).alias("last_updated"),
    ).select(*master.columns)


def import_by_number(master: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """Merged master where a repeated part updates by number and keeps its old key.

    Price, description, category and notes are overwritten, blanks included.
    """
    now = F.lit(as_of).cast("timestamp")
    valid = valid_rows(rows)
    new_parts = valid.select(
        "row_no", "composite_key", *VALUE_COLUMNS, now.alias("created_date"),
        now.alias("last_updated"))
    grown = insert_if_absent(master, new_parts, ["row_no"])
    repeats = import_outcomes(rows, master, True).filter("outcome = 'updated'").select(
        "row_no", "part_number", "authorized_price", "description", "category", "notes")
    changes = last_per_key(
        resolve(repeats, grown, "part_number").drop("part_number"), ["target_key"], ["row_no"]
    ).drop("row_no")
    return update_parts(grown, changes, as_of, rekey=False, keep_on_null=False)
