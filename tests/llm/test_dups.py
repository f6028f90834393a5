"""SimHash groups, substring removal and phrase matches against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ratecheck.llm import phrase_index, simhash, window_dedup
from ratecheck.llm.components import connect


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits=2):
    """value -> smallest value reachable, all pairs compared."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprints_and_groups(spark, documents, edge_rows, prose):
    base = prose(50, 400).split()
    near = [(100 + i, " ".join(base[:i] + ["x"] + base[i + 1:]), "a") for i in range(0, 400, 9)]
    rows = edge_rows + near + [(900 + i, "Same Text of five words", "b") for i in range(30)]
    printed, named = simhash.groups(documents(rows).withColumn("print", F.lit(1)))
    got = printed.join(named, "print").collect()
    assert len(got) == len(rows)
    value = {t: brute_print(t) for _, t, _ in rows}
    reach = brute_components(set(value.values()))
    first = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            first[reach[value[t]]].append(i)
    want = sorted(map(repr, ((i, value[t], min(first[reach[value[t]]], default=None))
                             for i, t, _ in rows)))
    assert sorted(repr((r.doc_id, r.print % 2 ** 64, r.component_id)) for r in got) == want
    assert len({reach[value[t]] for _, t, _ in near}) < len(near)


@pytest.mark.parametrize("crowded", [0, 3, 16])
def test_links_connect_all_close_pairs(spark, crowded):
    """Chains, stars and crowds around one value; small and crowded blocks agree."""
    base = 0x0123456789ABCDEF
    values = {base} | {base ^ (1 << i) for i in range(40)} | {
        base ^ (1 << i) ^ (1 << j) ^ (1 << 63) for i in range(0, 30, 3) for j in (40, 50)}
    chain = 0x7F00FF00FF00FF00
    for i in range(0, 20, 2):
        chain ^= 3 << i
        values.add(chain)
    values |= {(xxhash.xxh64_intdigest(str(i)) >> 1) for i in range(200)}
    signed = [v - 2 ** 64 if v >= 2 ** 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    edges = simhash.links(prints, crowded)
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= 2 for r in edges.collect())
    got = {r.node: r.label for r in connect(edges).collect()}
    want = brute_components(signed)
    assert all(got.get(v, v) == want[v] for v in signed)


def test_long_chains_and_stars_connect(spark):
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5, i) for i in range(10, 400)] + [(7, 7)]
    got = {r.node: r.label for r in connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1000, 1301)} == {1000} and {got[i] for i in range(10, 400)} == {5}
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_nothing(spark, documents):
    printed, named = simhash.groups(documents([(1, "a", "s")]).limit(0))
    assert printed.count() == 0 and named.count() == 0


def brute_removed(rows, window):
    first = {}
    rank = [(i if i is not None else float("inf"), (t or "").split()) for i, t, _ in rows]
    for i, w in rank:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    for (i, w), (doc, _, _) in zip(rank, rows):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        yield doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("window", [4, 13])
def test_repeated_windows_go(spark, documents, edge_rows, prose, window):
    passage = prose(77, 60)
    rows = edge_rows + [(200 + i, f"{prose(300 + i, i)} {passage} {prose(400 + i, 20)}", "p")
                        for i in range(40)]
    rows += [(300 + i, "a b " * (10 + i), "p") for i in range(8)]
    rows += [(400, passage + " " + passage, "p"), (150, " ".join(passage.split()[5:40]), "p")]
    docs = documents(rows).withColumn("start", F.lit("x")).repartition(4)
    got = window_dedup.remove_repeats(docs, window=window).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_removed(rows, window)))
    assert any(r.n_removed for r in got)


def test_flushing_early_changes_nothing(spark, documents, prose, monkeypatch):
    rows = [(i, prose(i % 6, 80) + " " + prose(50 + i, 30), "p") for i in range(40)]
    monkeypatch.setattr(window_dedup, "FLUSH_BYTES", 1)
    got = window_dedup.remove_repeats(documents(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_removed(rows, 13)))


def test_hot_word_pairs_are_split(spark, documents, prose, monkeypatch):
    """A third of the texts hold one word pair among different neighbours, some a whole passage."""
    monkeypatch.setattr(window_dedup, "HOT_BYTES", 20_000)
    monkeypatch.setattr(window_dedup, "SAMPLE_SHARE", 1)
    def mer(words):
        sizes = np.array([len(w) for w in words])
        return int(window_dedup.minimisers(window_dedup.word_hashes(b" ".join(words), sizes), sizes, 2)[0])

    pair = min((f"neighbour{i} nevertheless" for i in range(60)), key=lambda p: mer(p.encode().split()))
    shared = prose(1, 15) + f" {pair} " + prose(2, 15)
    rows = [(i, prose(1000 + i, 40, 10**6) + (f" {pair} " if i % 3 == 0 else " ")
             + prose(2000 + i, 40, 10**6) + (" " + shared if i % 30 == 0 else ""), "p")
            for i in range(600)]
    rows += [(None, shared, "p"), (700, f"{pair} " * 60, "p"), (701, f"{pair} " * 40, "p")]
    docs = documents(rows).repartition(3)
    spoken = docs.selectExpr("coalesce(doc_id, 9) id", "crc32(cast(text as binary)) tag", "text")
    hot = window_dedup.hot_minimisers(spoken, 10**6, 13)
    got = window_dedup.remove_repeats(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_removed(rows, 13)))
    assert 1 <= len(hot) <= 3 and sum(r.n_removed > 0 for r in got) >= 20
    most = []
    for known in (hot, hot[:0]):
        packer = window_dedup.Packer(13, 64, known)
        for i, text, _ in rows[:600:3]:
            packer.add(i, 0, text.encode())
        most.append(max(Counter(entry[4] for entry in packer.strings.values()).values()))
    # Only the twenty openings of the shared passage still meet, far below the bound.
    assert most[0] <= 20 and most[1] >= 150


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    strings = [b"a b c", b"a b d", b"a b c"]
    monkeypatch.setattr(window_dedup.xxhash, "xxh64_intdigest", lambda data: 7)
    got = list(window_dedup.later(strings, np.array([1, 2, 3]), np.array([0, 1, 2]), 3))
    assert got == [(2, 0)]


def test_no_rows_no_windows(spark, documents):
    assert window_dedup.remove_repeats(documents([(1, "a", "s")]).limit(0)).count() == 0


def phrase_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(rows, items, length):
    cut = []
    for item, t in items:
        w = phrase_words(t)
        n = min(length, len(w))
        cut += [(str(item) if item is not None else "null", w[i:i + n]) for i in range(len(w) - n + 1) if n]
    for i, t, _ in rows:
        w, hit, found = phrase_words(t), set(), set()
        for item, p in cut:
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(item)
        yield i, len(w), len(hit), len(found), sorted(found)


ITEMS = "item_id long, text string, doc_id string"


@pytest.mark.parametrize("length", [3, 10])
def test_phrases_are_found_exactly(spark, documents, edge_rows, prose, length):
    passage = "The quick-brown FOX, jumps over the lazy dog; again and again and again and again."
    items = [(1, passage), (2, "one"), (3, None), (4, "... --"), (None, prose(5, 12)), (6, passage),
             (6, "été Straße"), (7, "never seen words at all in here"), (8, prose(9, 15))]
    rows = edge_rows + [
        (20, "Before. the QUICK brown fox jumps over the lazy dog again and again and again and again!", "a"),
        (21, prose(9, 15) + " " + prose(9, 15), "a"), (22, "été strasse", "a"),
        (23, "again and again and again and again and again", "b")]
    docs = documents(rows).withColumn("item_id", F.lit(0)).withColumn("tag", F.lit(0))
    frame = spark.createDataFrame([(*x, "q") for x in items], ITEMS)
    got = phrase_index.phrase_matches(docs, frame, length).collect()
    want = sorted(map(repr, brute_hits(rows, items, length)))
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]))) for r in got) == want
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got)
    assert any(r.n_hit for r in got)


def test_near_phrases(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", "q")], ITEMS)
    rows = [(1, "x alpha beta gamma delta epsilon y", "a"), (2, "alpha beta or gamma delta then epsilon", "a"),
            (3, "alpha " + "x " * 30 + "beta gamma delta epsilon", "a"), (4, "beta alpha gamma epsilon delta", "a"),
            (5, None, "a")]
    got = phrase_index.near_matches(documents(rows), items, slack=2, length=5)
    assert {r.doc_id for r in got.collect()} == {1, 2, 4}


def test_phrases_of_nothing(spark, documents):
    docs = documents([(1, "some words", "a")])
    none = spark.createDataFrame([], ITEMS)
    assert [(r.n_words, r.n_hit) for r in phrase_index.phrase_matches(docs, none).collect()] == [(2, 0)]
    some = spark.createDataFrame([(1, "some words", "q")], ITEMS)
    assert phrase_index.phrase_matches(docs.limit(0), some).count() == 0


def test_repeated_rows_hold_their_phrases(spark, documents, prose):
    phrase = prose(9, 12)
    held = prose(60, 20) + " " + phrase + " " + prose(61, 20)
    rows = [(1, held, "a"), (1, held, "a"), (1, held, "b"), (None, held, "a"), (None, held, "a"),
            (2, held, "a"), (3, prose(62, 30), "a"), (3, prose(62, 30), "a")]
    items = [(1, phrase)]
    frame = spark.createDataFrame([(*x, "q") for x in items], ITEMS)
    got = phrase_index.phrase_matches(documents(rows), frame).collect()
    want = sorted(map(repr, brute_hits(rows, items, 10)))
    assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]))) for r in got) == want
