"""Rules over rows and batches. A rule is ``Column -> Column`` giving a message or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecheck.session import kept_once

Rule = Callable[[str], Column]


def check(df: DataFrame, column: str, rule: Rule) -> DataFrame:
    """Add ``error``, the broken rule of one column (H1)."""
    return df.withColumn("error", rule(column))


def valid_items(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).drop("error")


def invalid_items(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNotNull())


def until_first_error(checked: DataFrame, order: str = "row_no") -> DataFrame:
    """The rows up to and including the first bad one; all rows when none is bad (H1)."""
    first = checked.filter(F.col("error").isNotNull()).agg(F.min(order)).scalar()
    return checked.filter(first.isNull() | (F.col(order) <= first))


def batch_result(checked: DataFrame, field: str = "input",
                 total: DataFrame | None = None) -> DataFrame:
    """Counts, success rate in percent, and the low-rate warning (H1).

    ``total`` is the whole input when ``checked`` stops at the first error.
    """
    counts = checked.agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("error").isNull()).alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"))
    everything = F.col("seen") if total is None else total.agg(F.count(F.lit(1))).scalar()
    counts = counts.withColumn("total_count", everything)
    rate = F.coalesce(F.col("success_count").cast("double") * 100
                      / F.nullif("total_count", F.lit(0)), F.lit(0.0))
    shown = F.round(rate.cast("decimal(20,10)"), 1).cast("decimal(5,1)").cast("string")
    warning = (
        F.when(F.col("total_count") == 0, f"No {field} items provided for validation")
        .when(rate < 50, F.concat(F.lit("Low success rate: "), shown,
                                  F.lit(f"% of {field} items validated successfully"))))
    return counts.select("total_count", "success_count", "error_count",
                         rate.alias("success_rate"), warning.alias("warning"))


def check_rows(df: DataFrame, rules: dict[str, Rule], row_no: str = "row_no") -> DataFrame:
    """Check several fields of a row at once (H2).

    A field without a column is missing in every row. Extra columns are named in
    ``warning``; the row number column is not data.
    """
    problems = []
    for field, rule in rules.items():
        if field not in df.columns:
            problems.append(F.lit(f"Missing required field: {field}"))
        else:
            problems.append(F.concat(F.lit(f"{field}: "), rule(field)))
    listed = F.array_compact(F.array(*problems))
    message = F.concat(F.lit("Row "), F.col(row_no).cast("string"),
                       F.lit(" validation failed: "), F.array_join(listed, "; "))
    extra = [c for c in df.columns if c not in rules and c != row_no]
    warning = f"Unexpected fields ignored: {', '.join(extra)}" if extra else None
    return df.withColumn("error", F.when(F.size(listed) > 0, message)).withColumn(
        "warning", F.lit(warning).cast("string"))


# Advice by kind of field.
ADVICE = {
    "part_number": [
        "Use only alphanumeric characters, underscores, hyphens, and periods",
        "Ensure part number is 2-20 characters long",
        "Example: GP0171NAVY, ITEM-123, PART_001",
    ],
    "price": [
        "Enter a positive number (e.g., 15.50, 0.25)",
        "Use maximum 4 decimal places",
        "Remove currency symbols ($) if present",
    ],
    "file": [
        "Check that the file path is correct",
        "Ensure the file exists and is accessible",
        "Use absolute paths to avoid confusion",
    ],
    "email": [
        "Use valid email format: user@domain.com",
        "Check for typos in domain name",
    ],
    "other": [
        "Check the input format and try again",
        "Refer to command help for format requirements",
    ],
}


def suggestions(field: Column, message: Column) -> Column:
    """Advice for a broken rule, by words in the field name or the message (H4)."""
    name, text = F.lower(field), F.lower(message)

    def advice(kind: str) -> Column:
        return F.array(*[F.lit(s) for s in ADVICE[kind]])

    return (
        F.when(name.contains("part_number") | text.contains("part number"), advice("part_number"))
        .when(name.contains("price") | text.contains("price"), advice("price"))
        .when(name.contains("file") | name.contains("path"), advice("file"))
        .when(name.contains("email") | text.contains("email"), advice("email"))
        .otherwise(advice("other")))


SEVERITY_TITLES = {"CRITICAL": "CRITICAL ERRORS:", "ERROR": "ERRORS:", "WARNING": "WARNINGS:"}


def error_digest(errors: DataFrame, shown: int = 10, advice_shown: int = 5) -> DataFrame:
    """A short digest of many errors as ordered text rows (H3).

    ``errors`` has ``row_no, field, message, severity``. Per severity only the first
    ``shown`` rows leave the top-k; every later step works on those few rows. The errors are
    computed once, as each part of the digest reads them.
    """
    errors = kept_once(errors.select("row_no", "field", "message", "severity"))
    counts = errors.groupBy("severity").count()
    totals = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("severity") == "CRITICAL", F.col("count"))), F.lit(0))
        .alias("critical"),
        F.coalesce(F.sum(F.when(F.col("severity") == "ERROR", F.col("count"))), F.lit(0))
        .alias("regular"))
    slots = totals.select(
        "total", F.lit(shown).cast("bigint").alias("slot_1"),
        F.greatest(F.lit(0), F.lit(shown) - F.col("critical")).alias("slot_2"),
        F.greatest(F.lit(1), F.lit(shown) - F.col("critical") - F.col("regular"))
        .alias("slot_3"))
    parts = []
    for block, severity in enumerate(SEVERITY_TITLES, start=1):
        top = errors.filter(F.col("severity") == severity).orderBy("row_no", "field").limit(shown)
        place = F.row_number().over(Window.partitionBy("severity").orderBy("row_no", "field"))
        listed = top.withColumn("seq", place).filter(
            F.col("seq") <= slots.select(f"slot_{block}").scalar())
        parts.append(listed.select(
            F.lit(block).alias("block"), "seq",
            F.concat(F.lit("  • "), F.col("field"), F.lit(": "), F.col("message")).alias("text")))
        parts.append(counts.filter(F.col("severity") == severity).select(
            F.lit(block).alias("block"), F.lit(0).alias("seq"),
            F.lit(SEVERITY_TITLES[severity]).alias("text")))
    head = slots.select(
        F.lit(0).alias("block"), F.lit(0).alias("seq"),
        F.when(F.col("total") > 0, F.concat(
            F.lit("Found "), F.col("total").cast("string"), F.lit(" validation error(s):")))
        .otherwise("No validation errors found.").alias("text"))
    # The line below the head, and the heading of the advice after a blank line.
    rule = slots.filter("total > 0").select(
        F.lit(0).alias("block"), F.lit(1).alias("seq"), F.lit("-" * 50).alias("text"))
    heading = slots.filter("total > 0").select(F.lit(9).alias("block"), F.explode(F.array(
        F.struct(F.lit(-1).alias("seq"), F.lit("").alias("text")),
        F.struct(F.lit(0).alias("seq"), F.lit("💡 SUGGESTIONS:").alias("text")))).alias("h")).select(
        "block", "h.seq", "h.text")
    more = slots.filter(F.col("total") > shown).select(
        F.lit(8).alias("block"), F.lit(0).alias("seq"),
        F.concat(F.lit("... and "), (F.col("total") - shown).cast("string"),
                 F.lit(" more errors")).alias("text"))
    first = errors.orderBy("row_no", "field").limit(shown)
    advice = first.select("row_no", "field", F.posexplode(
        suggestions(F.col("field"), F.col("message"))).alias("pos", "advice"))
    ranked = advice.groupBy("advice").agg(
        F.min(F.struct("row_no", "field", "pos")).alias("at")).orderBy("at").limit(advice_shown)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at"))
    tips = ranked.select(
        F.lit(9).alias("block"), place.alias("seq"),
        F.concat(F.lit("  • "), F.col("advice")).alias("text"))
    out = head
    for part in (rule, *parts, more, heading, tips):
        out = out.unionByName(part)
    return out
