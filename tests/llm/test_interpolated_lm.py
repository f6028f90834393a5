"""The interpolated model against counts and expectation-maximisation written out word by word."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratecheck.llm import interpolated_lm as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, lends):
    """Rows (id, text) in order, and whether each lends, to the expected columns."""
    def tokens(text):
        return ["<", *[w for w in (text or "").translate(LOWER).encode().split()], ">"]

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    lists = [tokens(t) for _, t in rows]

    def count(keep):
        words, pairs = Counter(), Counter()
        for tokens_, k in zip(lists, keep):
            if k:
                words.update(tokens_)
                pairs.update(zip(tokens_, tokens_[1:]))
        return words, pairs, sum(n for w, n in words.items() if w != "<")

    words, pairs, total = count([not h for h in held])
    rest_words, rest_pairs, rest = count([not h and not l for h, l in zip(held, lends)])
    known = len(set(words) - {"<"})
    bucket = lambda n: min(n.bit_length(), lm.BUCKETS - 1)

    def parts(a, b, w, p, n):
        return (p[a, b] / w[a] if w[a] else 0.0, w[b] / max(n, 1), 1 / (known + 1))

    lent = [(bucket(rest_words[a]), parts(a, b, rest_words, rest_pairs, rest))
            for t, h, l in zip(lists, held, lends) if l and not h for a, b in zip(t, t[1:])]
    weights = [[1 / 3] * 3 for _ in range(lm.BUCKETS)]
    for _ in range(lm.ROUNDS if lent else 0):
        sums = [[0.0] * 3 for _ in weights]
        for k, p in lent:
            whole = sum(x * y for x, y in zip(weights[k], p))
            for j in range(3):
                sums[k][j] += weights[k][j] * p[j] / whole
        together = [sum(s[j] for s in sums) for j in range(3)]
        for k, s in enumerate(sums):
            s = s if sum(s) else together
            s = [max(x / sum(s), lm.FLOOR) for x in s]
            s[0] = s[0] if k else 0.0
            weights[k] = [x / sum(s) for x in s]
    if not rest:
        weights = [[0.0, 0.0, 1.0]] * lm.BUCKETS
    out = []
    for (i, _), t, h in zip(rows, lists, held):
        base = sum(math.log10((words[w] + .5) / (total + .5 * (known + 1))) for w in t[1:])
        score = sum(math.log10(sum(x * y for x, y in zip(
            weights[bucket(words[a])], parts(a, b, words, pairs, total)))) for a, b in zip(t, t[1:]))
        out.append((i, h, len(t) - 1, sum(words[w] > 0 for w in t[1:]), total, base, score))
    return out


def check(spark, docs):
    body = F.coalesce("text", F.lit(""))
    rows = [(r.doc_id, r.text, r.lends) for r in docs.select(
        "doc_id", "text", (F.pmod(F.xxhash64(body), F.lit(lm.PARTS)) == 0).alias("lends")).collect()]
    want = sorted(brute([r[:2] for r in rows], [r[2] for r in rows]), key=lambda r: (str(r[0]), r[2], r[5]))
    got = sorted((tuple(r) for r in lm.score(docs).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return got


def test_model_equals_brute_force(spark, documents, prose, edge_rows, monkeypatch):
    rows = edge_rows + [(100 + i, prose(i, 30 + i % 50, 60 + i % 7 * 40).title(), "s") for i in range(300)]
    rows += [(1000 + i, "The same text, told again and again.", "hot") for i in range(150)]
    docs = documents(rows).withColumn("id", F.lit("x")).withColumn("held", F.lit(1)).repartition(5)
    got = check(spark, docs)
    assert {r[1] for r in got} == {True, False}
    # Small pieces and many of them give the same.
    monkeypatch.setattr(lm, "PIECE_BYTES", 1 << 12)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1 << 12)
    again = sorted((tuple(r) for r in lm.score(docs).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in again] == [r[:5] for r in got]
    assert [r[6] for r in again] == pytest.approx([r[6] for r in got])


def test_contexts_help_on_held_out_rows(spark, documents):
    """Texts of a fixed order of words: the pair says more than the word alone."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(40)), "s") for i in range(200)]
    got = [r for r in lm.score(documents(rows)).collect() if r.held_out]
    assert got and all(r.score > r.base_score + 20 for r in got)


def test_little_to_learn_from(spark, documents):
    empty = documents([(1, "a b", "s")]).limit(0)
    assert lm.score(empty).count() == 0
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = lm.score(documents([(i, "all held out", "s") for i in only])).collect()
    assert [(r.base_score, r.score, r.train_tokens, r.n_known) for r in got] == [(0, 0, 0, 0)] * 3
    check(spark, documents([(i, t, "s") for i, t in enumerate(["a b a", "b", None, ""])]))
