"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic steps.

Every text gives a row of document statistics. A fixed set of random cosines of the scaled
statistics approximates a Gaussian kernel. The normal equations of the ridge are sums over rows,
so each partition adds up its own and a small matrix per partition is all that moves. Calibration
turns ridge scores into rates of label 1 by the pool-adjacent-violators rule over score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratecheck.llm.common import stage

FEATURES = 256
GAMMA = 0.08
RIDGE = 1e-3
BINS = 2048
SEED = 7
THRESHOLD = 0.7
ROWS = 4096

SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+{}[]\\", np.uint8)
ENDS = np.frombuffer(b".!?:;,", np.uint8)
STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "ends", "shouts", "non_ascii",
    "distinct", "line_repeats", "pair_repeats", "long_words", "short_words", "words_per_line",
    "same_as_before", "ended_lines",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, each of a bounded range; zeros if it has no words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, n)
    total = int(sizes.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[128:].sum())
    same = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        min(np.log1p(n) / 10, 2.0), min(total / n / 10, 3.0), upper / max(letters, 1),
        int(counts[48:58].sum()) / total, int(counts[SYMBOLS].sum()) / total,
        int(counts[ENDS].sum()) / n if n else 0.0, data.count(b"!!") / n,
        int(counts[128:].sum()) / total, len(set(words)) / n,
        1 - len(set(lines)) / len(lines), 1 - pairs / max(n - 1, 1) if n > 1 else 0.0,
        float((sizes > 15).mean()), float((sizes < 3).mean()),
        min(np.log1p(n / len(lines)) / 10, 2.0), same / n,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    return compute(text.cast("string"))


@dataclass
class Model:
    """Scaling, cosines, weights and calibration steps: all of a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    rates: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.scale, -8, 8)
        cosines = np.cos(scaled @ self.waves + self.shift) * np.sqrt(2 / self.waves.shape[1])
        return np.hstack([cosines, np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = self.features(rows) @ self.weights
        return np.clip(np.interp(raw, self.edges, self.rates), 0.0, 1.0)


def partial_sums(model: Model, labelled: DataFrame, kind: str) -> list[np.ndarray]:
    """Sums over all rows, one partial row per partition, added up in Spark by position."""
    width = model.waves.shape[1] + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kind == "normal":
            total = np.zeros((width, width + 1))
        else:
            total = np.zeros((BINS, 3))
        for batch in batches:
            stats = np.array(batch.column("stats").to_pylist(), float).reshape(
                -1, len(STATISTICS))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            for at in range(0, len(stats), ROWS):
                x, y = model.features(stats[at:at + ROWS]), label[at:at + ROWS]
                if kind == "normal":
                    total += np.hstack([x.T @ x, (x.T @ y)[:, None]])
                else:
                    raw = x @ model.weights
                    place = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                    np.add.at(total, place, np.stack([np.ones_like(y), y, raw], axis=1))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    summed = labelled.mapInArrow(add, "at int, v double").groupBy("at").agg(
        F.sum("v").alias("v")).orderBy("at").toPandas()
    return summed["v"].to_numpy()


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Non-decreasing rates that fit weighted bins best: pool adjacent violators."""
    pools: list[list[float]] = []
    for n, p in zip(counts, positives):
        pools.append([n, p, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]:
            n2, p2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + p2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in pools])


def fit(labelled: DataFrame, features: int = FEATURES, gamma: float = GAMMA,
        ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on a table of ``stats`` and ``label`` (0 or 1), all of its rows.

    Only sums of a fixed size come to the driver. Without rows of both labels the model gives
    every text the rate of label 1, or one half without any rows.
    """
    labelled = labelled.filter("label is not null and stats is not null")
    sums = labelled.select([F.struct(
        F.count("*").alias("n"), F.sum("label").alias("ones"),
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(len(STATISTICS))],
        *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(len(STATISTICS))]
    ).alias("x")]).first()["x"]
    rng = np.random.default_rng(seed)
    n, ones = sums["n"], float(sums["ones"] or 0)
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(len(STATISTICS))])
    scale = np.array([max(sums[f"s{i}"] or 0.0, 1e-3) for i in range(len(STATISTICS))])
    waves = rng.normal(0, np.sqrt(2 * gamma), (len(STATISTICS), features))
    shift = rng.uniform(0, 2 * np.pi, features)
    model = Model(mean, scale, waves, shift, np.zeros(features + 1), np.array([0.0, 1.0]),
                  np.array([ones / n if n else 0.5] * 2))
    if ones in (0, n):
        return model
    width = features + 1
    table = partial_sums(model, labelled, "normal").reshape(width, width + 1)
    penalty = ridge * n * np.eye(width) / features
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(table[:, :-1] + penalty, table[:, -1])
    bins = partial_sums(model, labelled, "bins").reshape(BINS, 3)
    bins = bins[bins[:, 0] > 0]
    model.edges, model.rates = bins[:, 2] / bins[:, 0], isotonic(bins[:, 0], bins[:, 1])
    return model


def score_column(model: Model, stats: Column) -> Column:
    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array(batch.tolist(), float).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(rows))

    return compute(stats)


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows that are kept from learning: the checksum of the id as text picks the fold."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "quality") -> tuple[Model, DataFrame]:
    """Measure a table, and fit on its labelled rows that are not held out.

    Returns the model and the measured rows ``doc_id, stats``. Labels other than 0 and 1,
    null ids and null labels teach nothing; of several labels of one id the larger counts.
    """
    measured = stage(docs.select(
        F.col(id_column).alias("doc_id"), statistics_column(F.col(text_column)).alias("stats")),
        "statistics")
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("label").alias("label"))
    return fit(measured.join(known, "doc_id").select("stats", "label")), measured


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
             text_column: str = "text", label_column: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """Score every text of a table: ``doc_id, held_out, score, predicted``, one row per row.

    A null or empty text has zero statistics and is scored on them. Null ids are held out only
    if the checksum of the empty text says so; repeated rows score alike; an empty table gives
    no rows. Other columns are never inputs.
    """
    model, measured = train(docs, labels, id_column, text_column, label_column)
    scored = measured.select("doc_id", score_column(model, F.col("stats")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
