"""Text normalization and the composite part key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that Python's str.strip() and \s treat as white space.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# Fixed value: the same characters in full, for trimming without a pattern.
WHITE_CHARS = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Runs to collapse: two or more of them, or one that is not a plain blank.
RUN = (WHITE + r"{2,}|[\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f"
       r"\u3000]")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Drop leading and trailing white space of any kind, not only blanks."""
    return F.btrim(col(c), F.lit(WHITE_CHARS))


def strip_cell(c: Column) -> Column:
    """``strip`` for a value at hand: one that starts and ends in visible ASCII is kept as it is."""
    def visible(char: Column) -> Column:
        return F.ascii(char).between(33, 126)

    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(strip(c))


def blank_to_null(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c) -> Column:
    """True for null and the empty string."""
    return F.coalesce(col(c), F.lit("")) == ""


def normalize_component(c) -> Column:
    """Upper case, single spaces, no outer space; null becomes ''."""
    # Collapsing first leaves at most one plain space at either end.
    return F.coalesce(F.trim(F.regexp_replace(F.upper(col(c)), RUN, " ")), F.lit(""))


def composite_key(item_type="item_type", description="description",
                  part_number="part_number") -> Column:
    """TYPE|DESCRIPTION|NUMBER over normalized components."""
    return F.concat_ws("|", normalize_component(item_type), normalize_component(description),
                       normalize_component(part_number))


def part_identifier(item_type="item_type", description="description",
                    part_number="part_number") -> Column:
    """Identifier of a part given as loose components; null when all are blank."""
    key = composite_key(item_type, description, part_number)
    return F.when(key != "||", key)
