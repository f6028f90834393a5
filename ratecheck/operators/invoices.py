"""Rules on whole invoices: totals, section order, completeness, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.keys import is_blank, strip
from ratecheck.operators.validate import verdict_counts
from ratecheck.plans.report import section_amounts


def totals_check(sections: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Does SUBTOTAL + FREIGHT + TAX equal TOTAL within the tolerance."""
    amounts = section_amounts(sections)
    expected = F.col("subtotal") + F.col("freight") + F.col("tax")
    gap = F.col("total") - expected
    limit = F.lit(tolerance).cast("decimal(18,4)")
    return amounts.select(
        "doc_id", "subtotal", "freight", "tax", "total",
        expected.alias("expected_total"), gap.alias("discrepancy"),
        F.coalesce(F.abs(gap) <= limit, F.lit(False)).alias("totals_valid"))


def section_order(sections: DataFrame) -> DataFrame:
    """Are the sections exactly SUBTOTAL, FREIGHT, TAX, TOTAL in this order."""
    def position(kind: str) -> Column:
        return F.min(F.when(F.upper("section_type") == kind, F.col("section_pos"))).alias(kind.lower())

    placed = sections.groupBy("doc_id").agg(
        position("SUBTOTAL"), position("FREIGHT"), position("TAX"), position("TOTAL"),
        F.count(F.lit(1)).alias("n_sections"))
    # Four rows with all four kinds present and positions rising is that one sequence.
    rising = ((F.col("subtotal") < F.col("freight")) & (F.col("freight") < F.col("tax"))
              & (F.col("tax") < F.col("total")))
    return placed.select(
        "doc_id", "n_sections",
        F.coalesce((F.col("n_sections") == 4) & rising, F.lit(False)).alias("sequence_valid"))


def is_valid_line() -> Column:
    """Non-zero quantity, a rate, and a description."""
    return (
        (F.coalesce("quantity", F.lit(0)) != 0)
        & F.col("rate").isNotNull()
        & (strip(F.coalesce("description", F.lit(""))) != "")
    )


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_line_items"),
        F.count_if(is_valid_line()).alias("valid_line_items"))


def _counted(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return invoices.join(line_counts(lines), "doc_id", "left").withColumns({
        "total_line_items": F.coalesce("total_line_items", zero),
        "valid_line_items": F.coalesce("valid_line_items", zero)})


def invoice_validity(invoices: DataFrame, lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Number, date, at least one line and four sections."""
    n_sections = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"))
    full = _counted(invoices, lines).join(n_sections, "doc_id", "left")
    named = strip(F.coalesce("invoice_number", F.lit(""))) != ""
    return full.select(
        "doc_id", "total_line_items", "valid_line_items",
        (named & F.col("invoice_date").isNotNull() & (F.col("total_line_items") > 0)
         & (F.coalesce("n_sections", F.lit(0)) >= 4)).alias("is_valid"))


def quality_errors() -> Column:
    """The quality rules that a counted invoice breaks."""
    number = F.coalesce("invoice_number", F.lit(""))
    return F.array_compact(F.array(
        F.when(~number.rlike(r"^\d+$"),
               F.concat(F.lit("Invalid invoice number format: "),
                        F.coalesce("invoice_number", F.lit("None")))),
        F.when(is_blank("invoice_date"), "Invoice date is missing"),
        F.when(F.col("valid_line_items") == 0, "No valid line items found"),
    ))


def quality_gate(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Broken quality rules per invoice, and a note on partly valid lines."""
    errors = quality_errors()
    partly = (F.col("valid_line_items") > 0) & (
        F.col("valid_line_items") < F.col("total_line_items"))
    note = F.concat(F.lit("Data quality: "), F.col("valid_line_items").cast("string"), F.lit("/"),
                    F.col("total_line_items").cast("string"), F.lit(" line items are valid"))
    return _counted(invoices, lines).select(
        "doc_id", errors.alias("errors"), (F.size(errors) == 0).alias("passed"),
        F.when(partly, note).alias("note"))


def quality_rejects(gate: DataFrame) -> DataFrame:
    """One row per rejected document, as ``file_outcomes`` expects."""
    return gate.filter(~F.col("passed")).select(
        "doc_id", F.array_join("errors", "; ").alias("error"))


def audited_files(invoices: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per file, as ``file_outcomes`` gives it for the rejects of the quality gate.

    Verdict counts and what the gate asks of the lines come from one aggregate per document, so the
    lines are read once and nothing is kept beside the counts. Documents with verdicts but no invoice row
    are listed without a folder and pass no gate.
    """
    zero = F.lit(0).cast("bigint")
    counts = verdicts.groupBy("doc_id").agg(
        *verdict_counts(), F.count_if(is_valid_line()).alias("valid_line_items"))
    joined = invoices.withColumn("listed", F.lit(True)).join(counts, "doc_id", "full").withColumn(
        "valid_line_items", F.coalesce("valid_line_items", zero))
    broken = F.when(F.col("listed") & (F.size(quality_errors()) > 0),
                    F.array_join(quality_errors(), "; "))
    no_lines = F.col("total_parts").isNull()
    bad = F.col("broken").isNotNull() | no_lines

    def unless_bad(value: Column) -> Column:
        return F.when(bad, F.lit(0)).otherwise(value)

    return joined.withColumn("broken", broken).select(
        "doc_id", "folder", (~bad).alias("success"),
        unless_bad(F.col("total_parts")).alias("lines"),
        unless_bad(F.col("unknown_parts")).alias("unknown_parts"),
        unless_bad(F.col("failed_parts") + F.col("unknown_parts")).alias("validation_errors"),
        F.coalesce("broken", F.when(no_lines, "No line items found")).alias("error"))
