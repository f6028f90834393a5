"""Hard negatives against all scores ranked one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecheck.llm import hard_negatives


def brute(rows):
    """Rows (id, label, vector) to the expected output, anchors being ids divisible by 100."""
    usable = sorted({(i, l, tuple(v)) for i, l, v in rows if l is not None and v is not None
                     and all(x is not None and np.isfinite(x) for x in v)}, key=repr)

    def score(a, b):
        return int(sum(x * y for x, y in zip(a, b)))

    def order(pair):
        return (-pair[0], pair[1] is None, pair[1] or 0)

    out = []
    for i, label, v in usable:
        if i is None or i % 100:
            continue
        others = [(score(v, w), j, m) for j, m, w in usable if j != i]
        ranked = [sorted(((s, j) for s, j, m in others if (m == label) == same), key=order)
                  for same in (True, False)]
        for top, positive in ranked[0][:5]:
            fit = [(s, j) for s, j in ranked[1] if 30 * top <= 100 * s <= 90 * top][:10]
            out += [(i, positive, k + 1, j, top, s) for k, (s, j) in enumerate(fit)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, l, v, "x", 1) for i, l, v in rows],
        "id long, label long, vector array<double>, key string, rank int")


def got(spark, rows):
    found = hard_negatives.hard_negatives(frame(spark, rows).repartition(3), F.col("id") % 100 == 0)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id",
                                        "positive_score", "negative_score")) for r in found.collect()), key=repr)


@pytest.mark.parametrize("width, spread", [(3, 4), (40, 30)])
def test_all_windows_are_found(spark, width, spread):
    draw = random.Random(width)
    rows = [(i, draw.randrange(3), [float(draw.randint(-spread, spread)) for _ in range(width)])
            for i in range(2400)]
    rows += [(2400 + i, draw.randrange(3), rows[0][2]) for i in range(300)]
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [4.0, 0.0]), (0, 1, [4.0, 0.0]), (1, 1, [5.0, 1.0]), (1, 1, [5.0, 1.0]), (2, 2, [3.0, 0.0]),
        (3, 2, [4.0]), (4, 2, []), (5, None, [9.0, 9.0]), (6, 2, None), (7, 2, [nan, 1.0]), (8, 2, [1.0, inf]),
        (9, 2, [1.0, None]), (None, 2, [3.0, 0.0]), (None, 1, [4.0, 2.0]), (10, 1, [0.0, 1.0]), (11, 2, [0.0, -1.0]),
        (12, 2, [-3.0, 0.0]), (100, 7, [1.0, 1.0]), (200, 1, [-9.0, 0.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:0]) == [] and got(spark, rows[3:8]) == []


def test_passes_and_pruning(spark, monkeypatch):
    """Several passes over the blocks, and rows that the index leaves out."""
    monkeypatch.setattr(hard_negatives, "PASS_ANCHORS", 4)
    draw = random.Random(2)
    rows = []
    for i in range(1500):
        v = [0.0] * 64
        for d in range(i % 4 * 16, i % 4 * 16 + 16):
            v[d] = float(draw.randint(-100, 100))
        rows.append((i, draw.randrange(2), v))
    assert got(spark, rows) == brute(rows)


def test_index_drops_what_cannot_reach():
    draw = np.random.default_rng(3)
    rows = draw.normal(0, 1, (500, 64)) * np.where(np.arange(64) < 16, 10, 0.1)
    anchors = rows[:5]
    least = np.full(5, 0.6 * np.linalg.norm(anchors, axis=1).min() * np.linalg.norm(rows, axis=1).max())
    index = hard_negatives.Index(np.arange(500), np.zeros(500), rows, anchors, least)
    assert index.posted.max() < 4 and (index.posted == 0).any()
    a, r, score = index.matches(anchors, least, np.ones((5, 500), bool))
    full = anchors @ index.rows.T
    assert set(zip(a, r)) == set(zip(*np.nonzero(full >= least[:, None])))
    assert np.allclose(score, full[a, r])
