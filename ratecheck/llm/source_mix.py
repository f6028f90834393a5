"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The shuffled texts of a source form one stream of words, read again from the start once it
ends. The stream is cut into blocks of equal size. Slot ``n`` of the mix takes the point
``n * step mod slots`` of a golden-ratio lattice; the source whose part of the cumulative
weights holds that point fills the slot with its next block. ``step`` and ``slots`` have no
common divisor, so every lattice point comes up once and each source gets exactly the number of
slots that its target needs, spread evenly over the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecheck.llm.common import digest_number, running, stage, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
BLOCK_WORDS = 1024
BUCKET_ROWS = 10_000
SLOT_CHUNK = 65_536
CELLS = 1024
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def measure(docs: DataFrame, id_column: str, text_column: str, source_column: str,
            seed: str) -> DataFrame:
    """One narrow row per document: its size and its place in the shuffle."""
    text = F.col(text_column).cast("string")
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"),
        word_count(text).alias("size"), digest_number(key).alias("place"),
        F.xxhash64(text).alias("tie"))


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which ``min(weight * level, cap)`` over all sources adds up to ``total``.

    Each round sums what is capped at the level so far and shares the rest by weight among the
    others, as the rule states it. One row comes back per round; a round caps at least
    one more source or is the last.
    """
    level = 0.0
    while True:
        over = F.col("cap") < F.col("weight") * level
        capped, weight = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if not weight:
            return level
        raised = (total - capped) / weight
        if raised <= level:
            return level
        level = raised


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most_repeats: float = MOST_REPEATS) -> DataFrame:
    """One row per source: number in code-point order, null last, size, rows, target."""
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    sources = running(sources, [F.col("source").asc_nulls_last()], {"number": F.lit(1)})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.select(
        "source", "source_size", "source_rows", F.col("number").cast("long").alias("number"),
        F.get(turn, (F.col("number") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(most_repeats))).alias("cap"))
    sources = stage(sources, "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * share)
    target = F.least("cap", F.col("weight") * F.lit(level))
    return sources.select(
        "source", "number", "source_size", "source_rows", target.alias("target"),
        F.floor(target + 0.5).alias("goal"))


def streams(sizes: DataFrame, sources: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Lay out each source's shuffled documents: ``offset`` is a document's first word.

    A source is cut into buckets of about ``bucket_rows`` rows by the shuffle key; sums run
    over buckets first and inside a bucket then, so no task holds a source.
    """
    docs = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).select(
        "number", sizes.source, "doc_id", "size", "place", "tie", "source_size", "target", "goal",
        (F.shiftright("place", HASH_BITS - 30) * F.ceil(F.col("source_rows") / bucket_rows)
         ).alias("_scaled"))
    docs = docs.withColumn("bucket", F.shiftright("_scaled", 30)).drop("_scaled")
    before = (Window.partitionBy("number").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    buckets = docs.groupBy("number", "bucket").agg(F.sum("size").alias("_size")).select(
        "number", "bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("number", "bucket").orderBy("place", "doc_id", "tie", "size")
    return docs.join(buckets, ["number", "bucket"]).select(
        "number", "bucket", F.row_number().over(inside).alias("row"), "source", "doc_id", "tie",
        "size", "source_size", "target", "goal",
        (F.col("_before") + F.sum("size").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"))


def pieces(laid: DataFrame, most_repeats: float = MOST_REPEATS, block: int = BLOCK_WORDS
           ) -> DataFrame:
    """Cut the streams, up to each source's goal, into blocks of ``block`` words."""
    rounds = laid.filter("size > 0").withColumn(
        "round", F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(most_repeats)) - 1))))
    start = F.col("offset") + F.col("round") * F.col("source_size")
    rounds = rounds.withColumn("_start", start).withColumn(
        "_end", F.least(start + F.col("size"), "goal")).filter("_start < _end")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block)
    cut = rounds.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("_start", F.col("block") * block)
    end = F.least("_end", (F.col("block") + 1) * block)
    return cut.select("number", "block", "bucket", "row", "doc_id", "round",
                      (begin - F.col("_start")).alias("first_word"),
                      (end - begin).alias("n_words"))


def golden_step(slots: int) -> int:
    """The number closest to slots / golden ratio that has no common divisor with slots."""
    near = round(slots * (math.sqrt(5) - 1) / 2)
    for far in range(slots + 1):
        for step in (near + far, near - far):
            if 0 < step and math.gcd(step, slots) == 1:
                return step
    return 1


def times_mod(n: Column, factor: int, modulus: int) -> Column:
    """n * factor mod modulus without leaving 63 bits, for moduli below 2**41."""
    high, low = F.shiftright(n, 21), n.bitwiseAND(F.lit((1 << 21) - 1))
    top = (high * F.lit(factor)) % F.lit(modulus)
    return ((top * F.lit(1 << 21)) % F.lit(modulus) + low * F.lit(factor)) % F.lit(modulus)


def slots(sources: DataFrame, block: int = BLOCK_WORDS, chunk: int = SLOT_CHUNK,
          cells: int = CELLS) -> DataFrame:
    """``slot, number, rank``: which source fills each slot, and with which of its blocks."""
    spark = sources.sparkSession
    needs = running(
        sources.select("number", F.ceil(F.col("goal") / block).alias("need")).filter("need > 0"),
        [F.col("number")], {"low": F.col("need")})
    needs = stage(needs.withColumn("high", F.col("low") + F.col("need")), "needs")
    count = needs.agg(F.sum("need")).first()[0] or 0
    if count == 0:
        return spark.createDataFrame([], "slot long, number long, rank long")
    if count >= 1 << 41:
        raise ValueError("too many slots for the lattice: use larger blocks")
    cell = F.floor(F.col("point") / F.lit(count) * cells)
    bounds = needs.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / F.lit(count) * cells),
        F.floor((F.col("high") - 1) / F.lit(count) * cells))))
    points = spark.range(count).select(
        F.col("id").alias("slot"), times_mod(F.col("id"), golden_step(count), count).alias("point"))
    drawn = points.withColumn("cell", cell).join(
        bounds.select("cell", "low", "high", "number"), "cell"
    ).filter("low <= point and point < high").select(
        "slot", "number", F.floor(F.col("slot") / chunk).alias("chunk"))
    before = (Window.partitionBy("number").orderBy("chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    chunks = drawn.groupBy("number", "chunk").count().select(
        "number", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("number", "chunk").orderBy("slot")
    return drawn.join(chunks, ["number", "chunk"]).select(
        "slot", "number", (F.col("_before") + F.row_number().over(inside) - 1).alias("rank"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE, most_repeats: float = MOST_REPEATS, block: int = BLOCK_WORDS,
        seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Mix a table; returns its laid-out documents and the schedule.

    The schedule has one row per piece: ``slot, number, bucket, row, doc_id, round,
    first_word, n_words``; ``(number, bucket, row)`` names a row of the laid-out documents,
    whose columns are ``number, bucket, row, source, doc_id, tie, size, source_size, target,
    goal, offset``; ``tie`` is a checksum of the text. ``round`` counts the readings of the
    source so far.

    Sizes are words; a null or empty text has none, is laid out and never scheduled. A null
    source is a source of its own, after all others. Null ids and repeated rows are rows like
    any other; rows equal in every column may change places. The order depends on ids, texts
    and the seed alone. No rows give no schedule. Other columns are not read.
    """
    sizes = stage(measure(docs, id_column, text_column, source_column, seed), "sizes")
    sources = stage(targets(sizes, weights, share, most_repeats), "targets")
    laid = stage(streams(sizes, sources), "streams")
    filled = slots(sources, block).withColumnRenamed("rank", "block")
    schedule = filled.join(pieces(laid, most_repeats, block), ["number", "block"]).drop("block")
    return laid, schedule


def taken_words(laid: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per document: how many of its words the mix takes, repeats counted."""
    key = ["number", "bucket", "row"]
    taken = schedule.groupBy(*key).agg(F.sum("n_words").alias("taken"))
    return laid.join(taken, key, "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
