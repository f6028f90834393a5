"""Sharding by sampled splitters: equal bytes per shard, equal texts together.

Records have a total order: a hash of the text, then a hash of the id. Splitters drawn from a
size-weighted sample cut that order into many ranges; measured ranges that are overfull are cut
again until they fit. Exact sums over ranges, then inside each range, give every record its
place in the order and from it its shard, so the sample decides how the work is dealt, not
where a record ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecheck.llm.common import digest_number, stage

SHARDS = 16
RANGES_PER_SHARD = 64
DRAWS_PER_RANGE = 12
CELL_BITS = 50
OVERFULL = 3
DIGITS = 1 << 30


def measure(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One narrow row per record: size, checksum, and the two keys of the order."""
    text = F.col(text_column).cast("string")
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        digest_number(text).alias("group"), digest_number(F.col(id_column)).alias("turn"))


def splitters(records: DataFrame, total: int, ranges: int, draws: int) -> DataFrame:
    """``low, high, range``: cuts of the text order, from a sample weighted by size.

    A record is drawn with a probability in proportion to its size, by a hash, so a rerun draws
    the same. About ``draws`` rows are drawn whatever the table holds; the cuts are the
    quantiles of their weights.
    """
    chance = F.col("size") * F.lit(draws / max(total, 1))
    lot = F.pmod(F.xxhash64("group", "turn", F.lit("draw")), F.lit(1 << 40)) / F.lit(1 << 40)
    drawn = records.filter(lot < chance).select(
        "group", F.greatest(F.col("size").cast("double"), F.lit(total / draws)).alias("weight"))
    order = Window.orderBy("group", "weight")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    step = max(total, 1) / ranges
    cuts = drawn.select("group", F.floor(upto / step).alias("after"),
                        F.floor((upto - F.col("weight")) / step).alias("before"))
    cuts = cuts.filter("after > before").select("group").distinct()
    edges = cuts.union(records.sparkSession.range(1).select(F.lit(-1).alias("group"))).distinct()
    following = F.lead("group").over(Window.orderBy("group"))
    return edges.select(
        F.col("group").alias("low"), F.coalesce(following, F.lit((1 << 63) - 1)).alias("high"),
        F.row_number().over(Window.orderBy("group")).alias("range"))


def into_ranges(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """Give each record the range that holds it: an equi-join on cells of the key space."""
    top = F.lit(((1 << 60) - 1) >> CELL_BITS)
    spread = cuts.withColumn("cell", F.explode(F.sequence(
        F.shiftright("low", CELL_BITS), F.least(F.shiftright(F.col("high") - 1, CELL_BITS), top))))
    # At most one row per cut and per cell: bounded by the parameters, not by the data.
    return records.withColumn("cell", F.shiftright("group", CELL_BITS)).join(
        F.broadcast(spread), "cell").filter("low <= group and group < high").select(
        *records.columns, F.array(F.col("range").cast("long")).alias("path"))


def subdivide(records: DataFrame, most: float) -> DataFrame:
    """Cut overfull ranges until each fits or is one text of one id.

    A range of several texts is cut evenly over its text hashes, one of a single text over its
    id hashes, so the order holds; ``path`` grows by one digit a round. Cutting by a factor of
    the excess ends after a few rounds, as hashes lie evenly.
    """
    while True:
        ranges = stage(records.groupBy("path").agg(
            F.sum("size").alias("bytes"), F.min("group").alias("g0"), F.max("group").alias("g1"),
            F.min("turn").alias("t0"), F.max("turn").alias("t1")), "ranges")
        overfull = ranges.filter((F.col("bytes") > most * OVERFULL)
                                 & ((F.col("g0") < F.col("g1")) | (F.col("t0") < F.col("t1"))))
        # Each of these holds more than a set share of all bytes, so they are few.
        overfull = overfull.select(
            "path", "g0", "g1", "t0", "t1", F.ceil(F.col("bytes") / most).alias("n"))
        if overfull.isEmpty():
            return records

        def digit(value: str, low: str, high: str) -> Column:
            share = ((F.col(value) - F.col(low)).cast("double")
                     / (F.col(high) - F.col(low) + 1).cast("double"))
            return F.floor(share * F.col("n"))

        cut = F.when(F.col("g0") < F.col("g1"), digit("group", "g0", "g1")).otherwise(
            digit("turn", "t0", "t1"))
        records = stage(records.join(F.broadcast(overfull), "path", "left").select(
            *[c for c in records.columns if c != "path"],
            F.concat("path", F.array(F.coalesce(cut, F.lit(0)))).alias("path")), "cut")


def shard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Deal a table into shards of nearly equal bytes.

    Returns ``doc_id, size, text_crc32, shard, slot``; ``slot`` counts from 0 in each shard, in
    the order of the hashes. Sizes are UTF-8 bytes plus one; a null text has no bytes, its own
    group, and the checksum of no bytes. Equal texts go to one shard, the one that holds the
    middle of their bytes, unless they hold more than one range's share of all bytes: such a
    group is dealt row by row. Null ids and repeated rows are rows like any other; rows equal in
    both columns may change places. An empty table gives no rows. Other columns are not read.
    """
    records = stage(measure(docs, id_column, text_column), "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    share = max(total, 1) / ranges
    cuts = stage(splitters(records, total, ranges, ranges * DRAWS_PER_RANGE), "cuts")
    dealt = subdivide(stage(into_ranges(records, cuts), "dealt"), share)
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("path").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "path", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("row0"))
    # One row per range: bounded by the parameters.
    placed = dealt.join(F.broadcast(starts), "path")
    inside = Window.partitionBy("path").orderBy("group", "turn", "doc_id", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select(
        "path", "doc_id", "size", "text_crc32", "group",
        (F.col("byte0") + F.sum("size").over(upto) - F.col("size")).alias("byte"),
        (F.col("row0") + F.row_number().over(inside) - 1).alias("place"))
    same = Window.partitionBy("path", "group")
    together = F.sum("size").over(same)
    middle = F.when(together <= share, F.min("byte").over(same) * 2 + together).otherwise(
        F.col("byte") * 2 + F.col("size"))
    placed = stage(placed.select(
        "doc_id", "size", "text_crc32", "place",
        F.least(F.floor(middle * F.lit(shards) / F.lit(2 * max(total, 1))),
                F.lit(shards - 1)).cast("int").alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"))
