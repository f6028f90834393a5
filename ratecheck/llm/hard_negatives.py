"""Hard negatives by threshold joins over an inverted index that leaves out what cannot matter.

Rows are packed into blocks of ``BLOCK_ROWS``; their dimensions are taken by falling energy, a ``STEP`` at a
time. Within a block a row is posted under a step only while the norm of its rest, times the
norm of the same rest of some anchor, can still reach that anchor's threshold. Posted
values are accumulated into partial scores; after each step a pair goes whose partial score and remaining norms
stay below the threshold, and what is left is scored in full. All rows at or above the threshold are
found. Anchors whose windows are not full come back with a lower one, down to the bound of the windows.

Anchors are a stated set, taken ``PASS_ANCHORS`` at a time; only these are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecheck.llm.common import stage

BLOCK_ROWS = 1024
PASS_ANCHORS = 4096
STEP = 16
# Once fewer pairs are alive they are scored one by one, so many at a time.
SPARSE = 0.05
PAIRS = 1 << 15
POSITIVES, NEGATIVES = 5, 10
# A negative scores 30 to 90 percent of its positive.
LOW, HIGH = 30, 90
# Thresholds for positives are shares of the product of norms, for negatives of the least positive.
POSITIVE_SHARES = (0.6, 0.42, 0.3, 0.2, 0.0)
NEGATIVE_SHARES = (0.8, 0.65, 0.5, LOW / 100)
LAST_ID = (1 << 63) - 1
SLACK = 1e-6

FOUND = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("other", pa.int64()),
                   ("score", pa.int64())])
FOUND_SQL = "key long, slot int, other long, score long"


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; missing places are zero."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes),
        np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
            lists.flatten().to_numpy(zero_copy_only=False))
    return out


def rests(rows: np.ndarray) -> np.ndarray:
    """The norm of what is left of each row before every step, and zero after the last."""
    squares = np.add.reduceat(rows * rows, np.arange(0, rows.shape[1], STEP), axis=1)
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(rows), 1))], axis=1)).T


class Index:
    """The rows of a block, posted by step, those that are posted longest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray,
                 anchors: np.ndarray, least: np.ndarray):
        left, mine = rests(rows), rests(anchors)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(mine > 0, (least - SLACK) / mine, np.where(least <= SLACK, 0, np.inf))
        # A row leaves the index at the first step where no anchor can be reached any more.
        within = left[:-1] >= need.min(axis=1)[:-1, None]
        posted = np.cumprod(within, axis=0).sum(axis=0)
        order = np.argsort(-posted, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.posted, self.left, self.mine = posted[order], left[:, order], mine
        self.steps = len(within)

    def matches(self, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchor and row and the score of every allowed pair at its threshold or above.

        ``allowed`` marks pairs in the order of the rows here.
        """
        n = int((self.posted > 0).sum())
        partial = np.where(allowed[:, :n], 0.0, -np.inf)
        done = 0
        for step in range(self.steps):
            n = int((self.posted > step).sum())
            if not n:
                break
            at = slice(step * STEP, (step + 1) * STEP)
            part = partial[:, :n]
            part += anchors[:, at] @ self.rows[:n, at].T
            done = step + 1
            alive = part + np.outer(self.mine[done], self.left[done, :n]) >= least[:, None] - SLACK
            part[~alive] = -np.inf
            if alive.mean() < SPARSE:
                break
        a, r = np.nonzero(partial > -np.inf)
        taken = np.minimum(self.posted[r], done)
        score = partial[a, r]
        fit = score + self.mine[taken, a] * self.left[taken, r] >= least[a] - SLACK
        a, r, score, taken = a[fit], r[fit], score[fit], taken[fit]
        open_ = np.flatnonzero(taken < self.steps)
        for i in range(0, len(open_), PAIRS):
            some = open_[i:i + PAIRS]
            score[some] = np.einsum("ij,ij->i", anchors[a[some]], self.rows[r[some]])
        fit = score >= least[a] - SLACK
        return a[fit], r[fit], score[fit]


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, size = np.frombuffer(data, "<i8", 3)
    ids, labels = np.frombuffer(data, "<i8", 2 * n, 24).reshape(2, n)
    rows = np.frombuffer(data, f"<f{size}", n * width, 24 + 16 * n).reshape(n, width)
    return ids, labels, rows.astype(np.float64)


def pack(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> bytes:
    # Whole numbers of that size are exact in four bytes.
    size = 4 if np.abs(rows).max(initial=0) <= 1 << 24 else 8
    return (np.array([*rows.shape, size], "<i8").tobytes() + ids.astype("<i8").tobytes()
            + labels.astype("<i8").tobytes() + rows.astype(f"<f{size}").tobytes())


def blocks(rows: DataFrame, order: list[int]) -> DataFrame:
    """Rows packed with their dimensions in the given order: ``every`` (0), ``block``."""
    width = len(order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").fill_null(LAST_ID).to_numpy()
            labels = batch.column("label").to_numpy()
            values = matrix(batch.column("vector"), width)[:, order]
            for at in range(0, len(ids), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int32()),
                     pa.array([pack(ids[part], labels[part], values[part])], pa.binary())],
                    names=["every", "block"])

    return rows.mapInArrow(gather, "every int, block binary")


def energies(rows: DataFrame) -> tuple[list[int], float]:
    """The dimensions by falling sum of squares, and the largest norm: numbers per dimension only."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(0), 0.0
        for batch in batches:
            lists = batch.column("vector")
            width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
            squares = matrix(lists, width) ** 2
            total = np.pad(total, (0, max(0, width - len(total))))
            total[:width] += squares.sum(axis=0)
            most = max(most, squares.sum(axis=1).max(initial=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(total)), pa.int32()), pa.array([most, *total], pa.float64())],
            names=["dim", "value"])

    found = rows.select("vector").mapInArrow(sums, "dim int, value double").groupBy("dim").agg(
        F.sum("value").alias("sum"), F.max("value").alias("max")).collect()
    by = {r.dim: r for r in found}
    dims = sorted((d for d in by if d >= 0), key=lambda d: (-by[d].sum, d))
    return dims, float(np.sqrt(by[-1].max)) if -1 in by else 0.0


def threshold_join(packed: DataFrame, wanted: DataFrame, order: list[int], same_label: bool
                   ) -> DataFrame:
    """``key, slot, other, score``: the best matches of each block for every window of an anchor.

    ``wanted`` has ``every, key, id, label, vector, least`` and ``tops``, the scores of the anchor's
    positives. With ``same_label`` there is one window without bounds, slot 0; else one per positive.
    """
    width = len(order)
    asked = wanted.groupBy("every").agg(F.collect_list(F.struct(
        "key", "id", "label", "vector", "least", "tops")).alias("anchors"))

    def windows(scores: np.ndarray, tops: list[int]) -> Iterator[tuple[int, slice]]:
        if same_label:
            yield 0, slice(0, min(POSITIVES, len(scores)))
            return
        falling = -100 * scores
        for slot, top in enumerate(tops):
            first = int(np.searchsorted(falling, -HIGH * top, "left"))
            last = int(np.searchsorted(falling, -LOW * top, "right"))
            yield slot, slice(first, min(last, first + NEGATIVES))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels, rows = unpack(batch.column("block")[at].as_py())
                asked_ = batch.column("anchors")[at].values
                own = asked_.field("id").fill_null(LAST_ID).to_numpy()
                vectors = matrix(asked_.field("vector"), width)[:, order]
                least = asked_.field("least").to_numpy()
                keys, tops = asked_.field("key").to_numpy(), asked_.field("tops").to_pylist()
                index = Index(ids, labels, rows, vectors, least)
                alike = asked_.field("label").to_numpy()[:, None] == index.labels[None, :]
                allowed = (alike == same_label) & (own[:, None] != index.ids[None, :])
                a, r, score = index.matches(vectors, least, allowed)
                score, other = np.rint(score).astype(np.int64), index.ids[r]
                ranked = np.lexsort((other, -score, a))
                a, score, other = a[ranked], score[ranked], other[ranked]
                out = []
                edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()) if len(a) else ():
                    for slot, part in windows(score[i:j], tops[a[i]]):
                        some = slice(i + part.start, i + part.stop)
                        out += [(int(keys[a[i]]), slot, o, s)
                                for o, s in zip(other[some].tolist(), score[some].tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)

    return packed.join(F.broadcast(asked), "every").select("block", "anchors").mapInArrow(
        search, FOUND_SQL)


def best(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` matches of each window, by falling score, then by id, with their ``rank``."""
    place = F.row_number().over(
        Window.partitionBy("key", "slot").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", place).filter(F.col("rank") <= most)


def lowered(packed: DataFrame, anchors: DataFrame, order: list[int], thresholds: list[Column],
            complete: Column, same_label: bool) -> DataFrame:
    """Matches of all anchors, by joins with falling thresholds; anchors leave once settled.

    ``complete`` tells of the counts per slot (``counts``, a map) and ``least`` whether an anchor's windows are
    full. With the last threshold every anchor is settled.
    """
    settled, todo = [], anchors
    for number, share in enumerate(thresholds):
        asked = todo.withColumn("least", share)
        found = stage(best(threshold_join(packed, asked, order, same_label),
                           POSITIVES if same_label else NEGATIVES), "matches")
        if number == len(thresholds) - 1:
            settled.append(found)
            break
        counts = found.groupBy("key", "slot").count().groupBy("key").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "count"))).alias("counts"))
        full = asked.join(counts, "key").filter(complete).select("key")
        settled.append(found.join(full, "key", "left_semi"))
        todo = stage(todo.join(full, "key", "left_anti"), "open-anchors")
        if todo.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``id, label`` (long) and ``vector`` (array of whole numbers as doubles). The positives of an anchor are
    its first ``POSITIVES`` other rows of its label, its negatives the first ``NEGATIVES`` rows of other labels that score
    ``LOW`` to ``HIGH`` percent of the positive; a positive below zero has none. Rows with a null label or
    vector, or a null or non-finite component, take no part. Equal rows count once, rows of one id are not partners, null
    ids come last and are no anchors. Short vectors end in zeros. Scores are exact below 2**53. An empty
    table, or no anchor, gives no rows; other columns are not read.
    """
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.select("id", F.col("label").cast("long").alias("label"), "vector").filter(
        F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(~odd)
    usable = stage(usable.distinct(), "vectors")
    order, longest = energies(usable)
    packed = stage(blocks(usable, order), "vector-blocks")
    chosen = usable.filter(is_anchor & F.col("id").isNotNull())
    passes = max(1, -(-chosen.count() // PASS_ANCHORS))
    chosen = stage(chosen.withColumns({
        "key": F.monotonically_increasing_id(), "every": F.lit(0),
        "pass": F.pmod(F.xxhash64("id"), F.lit(passes)),
        "norm": F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))}), "anchors")
    none = F.array().cast("array<bigint>")
    asked = ["every", "key", "id", "label", "vector", "norm", "tops"]
    results = []
    for number in range(passes):
        anchors = chosen.filter(F.col("pass") == number).withColumn("tops", none).select(asked)
        positives = stage(lowered(
            packed, anchors, order, [F.col("norm") * (share * longest) for share in POSITIVE_SHARES],
            F.coalesce(F.col("counts")[F.lit(0)], F.lit(0)) >= POSITIVES, True), "positives")
        tops = positives.groupBy("key").agg(F.sort_array(F.collect_list(
            F.struct("rank", "score"))).alias("ranked")).select(
            "key", F.col("ranked.score").alias("tops"))
        with_tops = stage(anchors.drop("tops").join(tops, "key").select(asked), "anchors-with-positives")
        lowest = F.element_at("tops", -1).cast("double")
        full = F.forall(F.sequence(F.lit(0), F.size("tops") - 1), lambda slot: (
            (F.coalesce(F.col("counts")[slot], F.lit(0)) >= NEGATIVES)
            | (F.col("least") * 100 <= F.get("tops", slot) * LOW)))
        negatives = lowered(packed, with_tops, order,
                            [lowest * share for share in NEGATIVE_SHARES], full, False)
        results.append(
            negatives.select("key", (F.col("slot") + 1).alias("place"), "rank",
                             F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positives.select("key", F.col("rank").alias("place"), F.col("other").alias("positive_id"),
                                   F.col("score").alias("positive_score")), ["key", "place"])
            .join(anchors.select("key", F.col("id").alias("anchor_id")), "key"))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    known = [F.nullif(c, F.lit(LAST_ID)).alias(c) for c in ("positive_id", "negative_id")]
    return out.select("anchor_id", known[0], "rank", known[1], "positive_score", "negative_score")


def quantised(rows: DataFrame) -> DataFrame:
    """``id, label, vector`` of an embedding table: steps of 1/256, every seventh label moved on by one."""
    return rows.select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        .cast("long").alias("label"),
        F.transform("embedding", lambda x: F.when(F.isnan(x), x.cast("double")).otherwise(
            F.floor(x.cast("double") * 256).cast("double"))).alias("vector"))
