"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratecheck.llm.common import stage


def connect(edges: DataFrame) -> DataFrame:
    """Label the nodes of an edge table (``a``, ``b``) with the smallest node they reach.

    Returns ``node, label`` for nodes that have an edge. Alternates two rewritings until
    nothing changes: every node hangs its larger neighbours, then its smaller ones, on the
    smallest node it knows. Rounds grow with the logarithm of the longest chain. A node of high
    degree meets its minimum by a join, whose larger side Spark splits, and no neighbour list is
    ever collected. Each round starts from a written table; one row of sums comes back.
    """

    def star(links: DataFrame) -> DataFrame:
        least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        return links.join(least, "a")

    def mirrored(links: DataFrame) -> DataFrame:
        return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    links = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            ).groupBy("node").agg(F.min("label").alias("label"))
        before = state
        large = star(mirrored(links)).filter("b > a").select(
            F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        small = star(large)
        small = small.select("b", "least").union(small.select("a", "least")).toDF("a", "b")
        links = stage(small.filter("a <> b").distinct(), "edges")
