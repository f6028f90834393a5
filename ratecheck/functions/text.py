"""Display text and typed setting values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratecheck.functions.keys import col, strip

# Words read as booleans.
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")


def money_text(c, places: int = 2) -> Column:
    """'$1.50'. The value is rounded as a decimal first, so no binary rounding shows."""
    rounded = F.round(col(c).cast("decimal(28,10)"), places).cast(f"decimal(28,{places})")
    return F.concat(F.lit("$"), rounded.cast("string"))


def format_currency(c) -> Column:
    return F.coalesce(money_text(c), F.lit("N/A"))


def format_price(c) -> Column:
    return money_text(c, 4)


def format_datetime(c, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.coalesce(F.date_format(col(c), pattern), F.lit("N/A"))


def format_boolean(c) -> Column:
    return F.when(col(c).isNull(), "N/A").when(col(c), "Yes").otherwise("No")


def truncate_text(c, length: int = 50) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length - 3), F.lit("...")))


def parse_boolean(c, extra: tuple[str, ...] = ()) -> Column:
    """Import flag: true / 1 / yes, and 'active' for the bulk status field."""
    return F.lower(col(c)).isin("true", "1", "yes", *extra)


def is_json(c) -> Column:
    return F.try_parse_json(col(c)).isNotNull()


# Fixed value: decimal literals; keeps suffixed forms such as '1d' out of the cast.
NUMBER_SHAPE = r"^(?i)[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$"


def typed_number(c) -> Column:
    text = strip(c)
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def typed_boolean(c) -> Column:
    word = F.lower(col(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def typed_value(value="value", data_type="data_type") -> Column:
    """One nullable field per type, and an error for a value that does not parse."""
    v, t = col(value), col(data_type)
    error = (
        F.when(~t.isin("string", "number", "boolean", "json"), "Unknown data type")
        .when((t == "number") & typed_number(v).isNull(), "Cannot convert to number")
        .when((t == "boolean") & typed_boolean(v).isNull(), "Cannot convert to boolean")
        .when((t == "json") & ~is_json(v), "Cannot parse json")
    )
    return F.struct(
        F.when(t == "string", v).alias("string_value"),
        F.when(t == "number", typed_number(v)).alias("number_value"),
        F.when(t == "boolean", typed_boolean(v)).alias("boolean_value"),
        F.when((t == "json") & is_json(v), v).alias("json_value"),
        error.alias("error"),
    )


def setting_error(key="key", value="value", data_type="data_type") -> Column:
    """Rule of a key/value row: key present, legal type, non-empty value parses."""
    k, v, t = col(key), col(value), col(data_type)
    return (
        F.when(F.coalesce(F.trim(k), F.lit("")) == "", "Configuration key must be a non-empty string")
        .when(v.isNull(), "Configuration value must be a string")
        .when(~t.isin("string", "number", "boolean", "json"),
              "Data type must be one of: string, number, boolean, json")
        .when(v != "", typed_value(v, t)["error"])
    )


def value_text(value: Column, data_type: str) -> Column:
    """Stored text of a typed value."""
    if data_type == "number":
        return value.cast("double").cast("string")
    if data_type == "boolean":
        return F.when(value.cast("boolean"), "true").otherwise("false")
    if data_type == "json":
        return F.to_json(value)
    return value.cast("string")


def inferred_type(c) -> Column:
    """Boolean words win over numbers, then numbers, then bracketed json."""
    v = col(c)
    bracketed = v.rlike(r"(?s)^[\{\[].*[\}\]]$")
    return (
        F.when(F.lower(v).isin(*TRUE_WORDS, *FALSE_WORDS), "boolean")
        .when(typed_number(v).isNotNull(), "number")
        .when(bracketed & is_json(v), "json")
        .otherwise("string")
    )
