"""The master table of authorized prices: keys, lookups, merges, listings.

There are no row-at-a-time writes. A change is a DataFrame of requests, and each
operator returns the new master or one outcome per request. Keys may be heavily
repeated in the requests, so "first" and "last" are aggregates (combined before the
shuffle), never a window over one key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.checks import too_many_decimals
from ratecheck.functions.keys import composite_key, is_blank, strip
from ratecheck.schemas import LEGAL_SOURCES

PART_COLUMNS = [
    "composite_key", "part_number", "authorized_price", "description", "item_type", "category",
    "source", "first_seen_invoice", "created_date", "last_updated", "is_active", "notes",
]


def _pick(df: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(choose(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first in ``order``; ties fall to the other columns."""
    return _pick(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, F.max)


# ---- rules ------------------------------------------------------------------------


def part_errors(price_text: str | None = None) -> Column:
    """All broken rules of a part row, as an array of messages.

    ``price_text`` names the column with the price as written, where one exists: digits
    beyond the fourth decimal are lost once the price is a decimal(18,4).
    """
    price = F.col("authorized_price")
    decimals = too_many_decimals(F.col(price_text)) if price_text else F.lit(False)
    number = F.coalesce(F.col("part_number"), F.lit(""))
    nothing = is_blank("part_number") & is_blank("description") & is_blank("item_type")
    checks = [
        (nothing, "At least one of part_number, description, or item_type must be provided"),
        ((number != "") & (strip(number) == ""),
         "Part number cannot be empty or whitespace only"),
        ((strip(number) != "") & ~number.rlike(r"^[A-Za-z0-9_\-\.\s@]+$"),
         "Part number can only contain letters, numbers, underscores, hyphens, periods, "
         "spaces, and @ symbols"),
        (price.isNull(), "Authorized price must be a number"),
        (price <= 0, "Authorized price must be positive"),
        (decimals, "Authorized price cannot have more than 4 decimal places"),
        (~F.coalesce(F.col("source"), F.lit("")).isin(*LEGAL_SOURCES),
         "Source must be one of: manual, discovered, imported"),
        (~nothing & (composite_key() == "||"),
         "Composite key cannot be empty - at least one component must have a value"),
    ]
    return F.array_compact(F.array(*[F.when(bad, message) for bad, message in checks]))


# ---- merges -----------------------------------------------------------------------


def insert_if_absent(master: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Master plus the first row of every new key."""
    fresh = first_per_key(new, ["composite_key"], order).join(
        master.select("composite_key"), "composite_key", "left_anti")
    return master.unionByName(fresh.select(*master.columns))


def rejected_inserts(master: DataFrame, new: DataFrame, order_col: str) -> DataFrame:
    """Rows of ``new`` that ``insert_if_absent`` refuses, with the reason."""
    firsts = new.groupBy("composite_key").agg(F.min(order_col).alias("_first"))
    known = master.select("composite_key", F.lit(True).alias("_known"))
    marks = firsts.join(known, "composite_key", "left")
    marked = new.join(marks, "composite_key")
    return marked.filter(F.col("_known") | (F.col(order_col) > F.col("_first"))).select(
        *new.columns,
        F.when(F.col("_known"), "exists in master").otherwise("repeated in input")
        .alias("reason"))


def by_number(master: DataFrame) -> DataFrame:
    """One row per part number: the part with the smallest key."""
    return master.filter(F.col("part_number").isNotNull()).groupBy(
        F.col("part_number").alias("lookup")).agg(
        F.min("composite_key").alias("number_match"))


def resolve(requests: DataFrame, master: DataFrame, column: str) -> DataFrame:
    """Add ``target_key``: the part a request means, by key first and number second.

    Two equi-joins on sides unique in the join key, in place of a join with OR.
    """
    keys = master.select(F.col("composite_key").alias("key_match"))
    numbers = by_number(master)
    return (
        requests
        .join(keys, F.col(column) == F.col("key_match"), "left")
        .join(numbers, F.col(column) == F.col("lookup"), "left")
        .withColumn("target_key", F.coalesce("key_match", "number_match"))
        .drop("key_match", "lookup", "number_match")
    )


def find_by_key(requests: DataFrame, master: DataFrame, column: str = "composite_key") -> DataFrame:
    """Requests with the matching part's columns, null when absent."""
    parts = master.select(F.col("composite_key").alias("_key"),
                          F.struct(*[c for c in PART_COLUMNS]).alias("part"))
    return requests.join(parts, F.col(column) == F.col("_key"), "left").drop("_key")


def find_by_components(requests: DataFrame, master: DataFrame, item_type="item_type",
                       description="description", part_number="part_number") -> DataFrame:
    keyed = requests.withColumn("request_key", composite_key(item_type, description, part_number))
    return find_by_key(keyed, master, "request_key")


def update_parts(master: DataFrame, changes: DataFrame, as_of: str, rekey: bool,
                 keep_on_null: bool = True) -> DataFrame:
    """Overwrite fields from a change table unique in ``target_key``.

    A null field in ``changes`` keeps the old value, unless ``keep_on_null`` is off.
    ``rekey`` regenerates the key from the new components; without it the old key stays.
    """
    fields = [c for c in changes.columns if c != "target_key"]
    renamed = changes.select(
        F.col("target_key").alias("composite_key"), F.lit(True).alias("_hit"),
        *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = master.join(renamed, "composite_key", "left")
    hit = F.coalesce("_hit", F.lit(False))

    def new_value(c: str) -> Column:
        if keep_on_null:
            return F.coalesce(f"_new_{c}", c).alias(c)
        return F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    out = joined.select("composite_key", "_hit", *[
        new_value(c) if c in fields else F.col(c)
        for c in master.columns if c != "composite_key"])
    out = out.withColumn("last_updated", F.when(hit, F.lit(as_of).cast("timestamp"))
                         .otherwise(F.col("last_updated")))
    if rekey and {"item_type", "description", "part_number"} & set(fields):
        out = out.withColumn("composite_key", F.when(hit, composite_key())
                             .otherwise(F.col("composite_key")))
    return out.select(*master.columns)


def delete_parts(master: DataFrame, ids: DataFrame, column: str, soft: bool = True,
                 as_of: str | None = None) -> DataFrame:
    """Remove or deactivate every row whose key or number is requested.

    A deactivated row is updated at ``as_of``.
    """
    wanted = ids.select(F.col(column).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    by_key = F.col("composite_key") == F.col("_id")
    by_num = F.col("part_number") == F.col("_id")
    if not soft:
        return master.join(wanted, by_key, "left_anti").join(wanted, by_num, "left_anti")
    key_hits = wanted.select("_id", F.lit(True).alias("_key_hit"))
    num_hits = wanted.select(F.col("_id").alias("_num"), F.lit(True).alias("_num_hit"))
    marked = master.join(key_hits, by_key, "left").join(
        num_hits, F.col("part_number") == F.col("_num"), "left")
    hit = F.coalesce("_key_hit", "_num_hit", F.lit(False))
    updated = F.when(hit & F.lit(as_of is not None), F.lit(as_of).cast("timestamp")).otherwise(
        F.col("last_updated"))
    return marked.withColumns({"is_active": F.col("is_active") & ~hit, "last_updated": updated}
                              ).select(*master.columns)


def set_category(master: DataFrame, ids: DataFrame, column: str, category: str,
                 as_of: str) -> DataFrame:
    """New category for the listed parts."""
    targets = resolve(ids.select(column).distinct(), master, column).filter(
        F.col("target_key").isNotNull()).select("target_key").distinct()
    return update_parts(master, targets.withColumn("category", F.lit(category)), as_of, False)


def missing_parts(master: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """One error row per requested part that does not exist."""
    return resolve(ids, master, column).filter(F.col("target_key").isNull()).select(
        *ids.columns, F.concat(F.lit("Part "), F.coalesce(column, F.lit("")),
                               F.lit(" not found")).alias("error"))


# ---- listings ---------------------------------------------------------------------


def list_parts(master: DataFrame, active_only: bool = True, category: str | None = None,
               limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Parts in key order; ``offset`` counts only together with ``limit`` (C11)."""
    out = master
    if active_only:
        out = out.filter("is_active")
    if category:
        out = out.filter(F.col("category") == category)
    out = out.orderBy("composite_key")
    if limit:
        if offset:
            out = out.offset(offset)
        out = out.limit(limit)
    return out


SORT_COLUMNS = {"part_number": "part_number", "price": "authorized_price",
                "created": "created_date"}


def sorted_page(page: DataFrame, sort_by: str = "part_number", descending: bool = False) -> DataFrame:
    """A listed page in another order; key order breaks ties."""
    column = F.col(SORT_COLUMNS[sort_by])
    return page.orderBy(column.desc() if descending else column.asc(), "composite_key")


def search_parts(master: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring of number, description or category."""
    wanted = term.lower()
    hits = [F.lower(F.coalesce(c, F.lit(""))).contains(wanted)
            for c in ("part_number", "description", "category")]
    return master.filter(hits[0] | hits[1] | hits[2])


def price_range(master: DataFrame, low=None, high=None, active_only: bool = True) -> DataFrame:
    """Parts priced within the closed range; a missing bound is open (C14)."""
    out = master.filter("is_active") if active_only else master
    if low is not None:
        out = out.filter(F.col("authorized_price") >= F.lit(str(low)).cast("decimal(18,4)"))
    if high is not None:
        out = out.filter(F.col("authorized_price") <= F.lit(str(high)).cast("decimal(18,4)"))
    return out


def active_parts(master: DataFrame) -> DataFrame:
    return master.filter("is_active").drop("is_active")
