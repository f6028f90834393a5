"""Bulk changes by part number: update, delete, activate, with outcomes and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.checks import too_many_decimals
from ratecheck.functions.text import parse_boolean
from ratecheck.operators.master import delete_parts, resolve, update_parts

FIELDS = ["authorized_price", "description", "category", "notes", "status"]


def _located(requests: DataFrame, master: DataFrame) -> DataFrame:
    """Requests with the part they mean and its current category and state."""
    current = master.select(
        F.col("composite_key").alias("target_key"), F.col("category").alias("old_category"),
        F.col("is_active").alias("old_active"))
    return resolve(requests, master, "part_number").join(current, "target_key", "left")


def _outside(filter_category: str | None) -> Column:
    if not filter_category:
        return F.lit(False)
    return ~F.coalesce(F.col("old_category") == filter_category, F.lit(False))


def _repeated(located: DataFrame, skipped: Column) -> tuple[DataFrame, Column]:
    """Requests with the first one that hits their part, and whether one came before."""
    firsts = located.filter(F.col("target_key").isNotNull() & ~skipped).groupBy("target_key").agg(
        F.min("row_no").alias("_first"))
    again = F.coalesce(F.col("row_no") > F.col("_first"), F.lit(False))
    return located.join(firsts, "target_key", "left"), again


def update_outcomes(changes: DataFrame, master: DataFrame,
                    filter_category: str | None = None) -> DataFrame:
    """updated / not_found / filtered_out / errors per change row (C17).

    Rows apply in order. Under a category filter, the first row that moves a part to
    another category ends the changes to it; that row is a minimum per part.
    """
    located = _located(changes, master)
    price = F.col("authorized_price")
    bad_price = (price <= 0) | too_many_decimals(F.col("price_text")) \
        if "price_text" in changes.columns else F.lit(False)
    bad_price = F.coalesce(bad_price, F.lit(False))
    if filter_category and "category" in changes.columns:
        leaves = located.filter(
            F.col("target_key").isNotNull() & ~bad_price
            & (F.col("old_category") == filter_category)
            & (F.col("category") != filter_category))
        cutoff = leaves.groupBy("target_key").agg(F.min("row_no").alias("_last_row"))
        located = located.join(cutoff, "target_key", "left")
    else:
        located = located.withColumn("_last_row", F.lit(None).cast("bigint"))
    late = F.coalesce(F.col("row_no") > F.col("_last_row"), F.lit(False))
    return located.withColumn(
        "outcome",
        F.when(F.col("target_key").isNull(), "not_found")
        .when(_outside(filter_category) | late, "filtered_out")
        .when(bad_price, "errors")
        .otherwise("updated")).drop("_last_row")


def apply_updates(outcomes: DataFrame, master: DataFrame, as_of: str) -> DataFrame:
    """Merged master (C17): the last non-empty value of each field wins on its own."""
    done = outcomes.filter("outcome = 'updated'")
    fields = [f for f in FIELDS if f in outcomes.columns]
    last = done.groupBy("target_key").agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("row_no"))).alias(f)
        for f in fields])
    if "status" in fields:
        last = last.withColumn("is_active", parse_boolean("status", extra=("active",))).drop("status")
    return update_parts(master, last, as_of, rekey=False)


def outcome_totals(outcomes: DataFrame, batch_size: int = 50) -> DataFrame:
    """Counts per outcome with the total and the number of batches it reports."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(F.col("outcome") == "not_found").alias("not_found"),
        F.count_if(F.col("outcome") == "filtered_out").alias("filtered_out"),
        F.count_if(F.col("outcome") == "errors").alias("errors"),
        F.ceil(F.count(F.lit(1)) / batch_size).alias("batches"))


def update_preview(changes: DataFrame, master: DataFrame) -> DataFrame:
    """Current and new values of every matched change."""
    current = master.select(F.col("composite_key").alias("target_key"), *[
        F.col(c).alias(f"current_{c}")
        for c in ("authorized_price", "description", "category", "is_active")])
    matched = resolve(changes, master, "part_number").join(current, "target_key")
    return matched.select(
        "row_no", "part_number",
        "current_authorized_price", F.col("authorized_price").alias("new_authorized_price"),
        "current_description", F.col("description").alias("new_description"),
        "current_category", F.col("category").alias("new_category"),
        "current_is_active",
        parse_boolean("status", extra=("active",)).alias("new_is_active"))


def delete_outcomes(requests: DataFrame, master: DataFrame, soft: bool = True,
                    filter_category: str | None = None) -> DataFrame:
    """deleted / not_found / filtered_out per request.

    A hard delete removes the part, so a later request for it, by key or by number, no longer
    finds it.
    """
    located = _located(requests, master)
    if soft:
        again = F.lit(False)
    else:
        located, again = _repeated(located, _outside(filter_category))
    out = located.withColumn(
        "outcome",
        F.when(F.col("target_key").isNull(), "not_found")
        .when(_outside(filter_category), "filtered_out")
        .when(again, "not_found")
        .otherwise("deleted"))
    return out if soft else out.drop("_first")


def apply_deletes(outcomes: DataFrame, master: DataFrame, soft: bool = True,
                  as_of: str | None = None) -> DataFrame:
    return delete_parts(master, outcomes.filter("outcome = 'deleted'"), "part_number", soft, as_of)


def delete_preview(requests: DataFrame, master: DataFrame, soft: bool = True) -> DataFrame:
    """What a delete would hit."""
    located = _located(requests, master).filter(F.col("target_key").isNotNull())
    return located.select(
        "row_no", "part_number", F.col("old_category").alias("category"),
        F.when(F.col("old_active"), "Active").otherwise("Inactive").alias("status"),
        F.lit("Deactivate" if soft else "Delete").alias("deletion_type"))


def activate_outcomes(requests: DataFrame, master: DataFrame,
                      filter_category: str | None = None) -> DataFrame:
    """activated / already_active / not_found / filtered_out per request (C20).

    A later request for the same part, by key or by number, finds it active.
    """
    located, again = _repeated(_located(requests, master), _outside(filter_category))
    return located.withColumn(
        "outcome",
        F.when(F.col("target_key").isNull(), "not_found")
        .when(_outside(filter_category), "filtered_out")
        .when(F.col("old_active") | again, "already_active")
        .otherwise("activated")).drop("_first")


def apply_activations(outcomes: DataFrame, master: DataFrame, as_of: str) -> DataFrame:
    hits = outcomes.filter("outcome = 'activated'").select("target_key").distinct()
    return update_parts(master, hits.withColumn("is_active", F.lit(True)), as_of, rekey=False)


def activate_preview(requests: DataFrame, master: DataFrame) -> DataFrame:
    """The inactive parts an activation would change (C20)."""
    return _located(requests, master).filter(~F.col("old_active")).select(
        "row_no", "part_number", F.col("old_category").alias("category"))
