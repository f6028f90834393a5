"""Value rules. Each returns the message of the first broken rule, or null when valid.

A rule is a function ``Column -> Column``, so a whole column is checked in one
projection; ``ratecheck.operators.rules`` combines rules over rows and tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratecheck.functions.keys import col, strip


def _first(*checks: tuple[Column, str]) -> Column:
    out = None
    for bad, message in checks:
        out = F.when(bad, message) if out is None else out.when(bad, message)
    return out


def _text(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def clean_part_number(c) -> Column:
    return F.upper(strip(c))


def part_number_error(c) -> Column:
    """2-20 characters out of letters, digits, '_', '-', '.', after upper-casing."""
    value = F.upper(strip(_text(c)))
    return _first(
        (_text(c) == "", "Part number must be a non-empty string"),
        (value == "", "Part number cannot be empty or whitespace only"),
        (F.length(value) < 2, "Part number must be at least 2 characters long"),
        (F.length(value) > 20, "Part number cannot exceed 20 characters"),
        (~value.rlike(r"^[A-Z0-9_.-]+\z"),
         "Part number can only contain letters, numbers, underscores, hyphens, and periods"),
    )


def is_plain_part_number(c) -> Column:
    """Character set only."""
    return F.coalesce(col(c).rlike(r"^[A-Za-z0-9_.-]+$"), F.lit(False))


def is_short_part_number(c) -> Column:
    """Character set and at least two characters, outer space ignored."""
    value = strip(_text(c))
    return value.rlike(r"^[A-Za-z0-9_.-]+$") & (F.length(value) >= 2)


def description_error(c) -> Column:
    value = strip(_text(c))
    return _first(
        (_text(c) == "", "Description must be a non-empty string"),
        (value == "", "Description cannot be empty or whitespace only"),
        (F.length(value) < 3, "Description must be at least 3 characters long"),
        (F.length(value) > 200, "Description cannot exceed 200 characters"),
    )


def clean_price(c, precision: str = "decimal(38,10)") -> Column:
    """Drop '$' and ',' and parse; null when the text is no number."""
    text = F.translate(strip(col(c).cast("string")), "$,", "")
    return text.try_cast(precision)


def too_many_decimals(text: Column) -> Column:
    """More than four digits after the point, trailing zeros counted."""
    return text.rlike(r"\.\d{5,}")


def price_error(c) -> Column:
    text = F.translate(strip(col(c).cast("string")), "$,", "")
    value = clean_price(c)
    return _first(
        (col(c).isNull(), "Price cannot be None"),
        (value.isNull(), "Invalid price format"),
        (value <= 0, "Price must be positive"),
        (too_many_decimals(text), "Price cannot have more than 4 decimal places"),
        (value < F.lit("0.01").cast("decimal(4,2)"), "Price must be at least $0.01"),
        (value > F.lit("999999.99").cast("decimal(8,2)"), "Price cannot exceed $999,999.99"),
    )


def email_error(c) -> Column:
    value = F.lower(strip(_text(c)))
    return _first(
        (_text(c) == "", "Email address cannot be empty"),
        (~value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
         "Invalid email address format"),
    )


# Accepted date shapes.
DATE_SHAPES = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{1,2}/\d{1,2}/\d{4})$"
INVOICE_DATE_PREFIX = r"^(\d{2}/\d{2}/\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})"


def date_error(c) -> Column:
    value = strip(_text(c))
    return _first(
        (_text(c) == "", "Date cannot be empty"),
        (~value.rlike(DATE_SHAPES), "Invalid date format"),
    )


def is_invoice_date(c) -> Column:
    return strip(_text(c)).rlike(INVOICE_DATE_PREFIX)


def is_invoice_number(c) -> Column:
    return strip(_text(c)).rlike(r"^\d{8,}$")


def integer_error(c, low: int = 1, high: int | None = None) -> Column:
    value = strip(_text(c)).try_cast("bigint")
    value = F.when(strip(_text(c)).rlike(r"^[+-]?\d+$"), value)
    checks = [
        (value.isNull(), "Invalid integer value"),
        (value < low, f"Value must be at least {low}"),
    ]
    if high is not None:
        checks.append((value > high, f"Value cannot exceed {high}"))
    return _first(*checks)


def key_name_error(c) -> Column:
    value = F.lower(strip(_text(c)))
    return _first(
        (_text(c) == "", "Configuration key cannot be empty"),
        (~value.rlike(r"^[a-z][a-z0-9_]*$"),
         "Configuration key must start with a letter and contain only "
         "lowercase letters, numbers, and underscores"),
        (F.length(value) > 50, "Configuration key cannot exceed 50 characters"),
    )


def session_id_error(c) -> Column:
    value = strip(_text(c))
    return _first(
        (_text(c) == "", "Session ID cannot be empty"),
        (~value.rlike(r"^[a-zA-Z0-9-]+$"),
         "Session ID can only contain letters, numbers, and hyphens"),
        (~F.length(value).between(8, 50), "Session ID must be between 8 and 50 characters"),
    )
