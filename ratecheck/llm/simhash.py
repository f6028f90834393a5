"""SimHash near-duplicates: pigeonhole blocks over fingerprints, verified by Hamming distance.

A fingerprint has four blocks of 16 bits. Two that differ in at most two bits agree in at least
two whole blocks, so every such pair meets under one of the six pairs of blocks. Small blocks
are joined and each pair is verified. In a crowded block pairs are never formed: two members
are within two bits exactly if some point is within one bit of both, so each member names the
points around it and all who name a point are linked to its smallest member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ratecheck.llm.common import stage
from ratecheck.llm.components import connect

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 2
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
CROWDED = 16
CHUNK = 1 << 16


def shingles(text: str | None, size: int) -> list[bytes]:
    """All runs of ``size`` words joined by spaces; the whole sequence if it is shorter."""
    found = (text or "").encode().lower().split()
    if len(found) <= size:
        return [b" ".join(found)] if found else []
    line = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    return [line[a:b - 1] for a, b in zip(starts, ends[size - 1:])]


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """A signed 64-bit SimHash: a bit is 1 if set in over half of the shingle hashes."""
    grams = shingles(text, size)
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), CHUNK):
        hashes = np.array([digest(g, SEED) for g in grams[at:at + CHUNK]], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(grams), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, size) for t in batch], dtype="int64")

    return compute(text.cast("string"))


def block_keys(value: Column) -> Column:
    """An array of (pair of blocks, their bits, the other bits) for a fingerprint."""
    ones = (1 << BLOCK_BITS) - 1
    blocks = [F.shiftrightunsigned(value, BLOCK_BITS * i).bitwiseAND(F.lit(ones))
              for i in range(BLOCKS)]

    def joined(chosen: tuple[int, ...]) -> Column:
        return F.shiftleft(blocks[chosen[0]], BLOCK_BITS).bitwiseOR(blocks[chosen[1]])

    return F.array(*[
        F.struct(F.lit(number).alias("pair"), joined(chosen).alias("key"),
                 joined(tuple(i for i in range(BLOCKS) if i not in chosen)).alias("rest"))
        for number, chosen in enumerate(combinations(range(BLOCKS), 2))])


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges (``a``, ``b``) that connect all fingerprints within two bits of each other.

    ``prints`` has distinct values in ``print``. Every edge is verified; fingerprints that are
    within two bits are joined by an edge or, in a crowded block, by a path of edges.
    """
    members = stage(prints.select("print", F.explode(block_keys(F.col("print"))).alias("k"))
                    .select("print", "k.pair", "k.key", "k.rest"), "blocks")
    sizes = members.groupBy("pair", "key").count().filter("count > 1")
    sized = stage(members.join(sizes, ["pair", "key"]), "shared-blocks")
    few = sized.filter(F.col("count") <= crowded).select("pair", "key", "print")
    pairs = few.withColumnRenamed("print", "a").join(
        few.withColumnRenamed("print", "b"), ["pair", "key"]).filter("a < b").filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")
    flips = F.concat(F.array(F.lit(0).cast("long")),
                     F.transform(F.sequence(F.lit(0), F.lit(2 * BLOCK_BITS - 1)),
                                 lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    many = sized.filter(F.col("count") > crowded).select(
        "pair", "key", "print", "rest", F.explode(flips).alias("flip")).select(
        "pair", "key", F.col("rest").bitwiseXOR(F.col("flip")).alias("point"), "print")
    hubs = many.groupBy("pair", "key", "point").agg(
        F.min("print").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = many.join(hubs, ["pair", "key", "point"]).filter("print <> b").select(
        F.col("print").alias("a"), "b")
    return pairs.union(starred).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """``print, label``: the smallest fingerprint reachable over links, for every fingerprint."""
    labels = connect(links(prints))
    return prints.select("print").join(labels, prints["print"] == labels["node"], "left").select(
        "print", F.coalesce("label", "print").alias("label"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Fingerprint a table and group it; returns (documents, fingerprints).

    Documents are ``doc_id, print``, one per input row. Fingerprints are ``print, label,
    component_id``: ``label`` names the group, ``component_id`` is the smallest id in it, null if
    all its ids are. Texts that are null or have no words have the fingerprint zero, linked
    like any other; texts of fewer words than a shingle hash their whole sequence. Equal texts
    share a fingerprint and are one node of the graph, however many they are. Repeated rows
    stay; an empty table gives two empty tables; other columns are not read.
    """
    printed = stage(docs.select(
        F.col(id_column).alias("doc_id"),
        fingerprint_column(F.col(text_column), size).alias("print")), "prints")
    prints = stage(printed.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    labelled = prints.join(classes(prints), "print")
    named = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return printed, stage(labelled.join(named, "label").select("print", "label", "component_id"),
                          "labels")


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
