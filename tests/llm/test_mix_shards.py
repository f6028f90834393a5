"""Source mixing and sharding on small tables."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ratecheck.llm import shards, source_mix
from ratecheck.llm.common import running


def filled(sizes, weights=(5, 2, 1), share=1.5, repeats=2.0):
    """Targets by the stated rule: cap, reshare the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while free and left > 1e-9:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        left = 0.0
        for s in list(free):
            target[s] += part[s]
        for s in list(free):
            if target[s] > repeats * sizes[s]:
                left += target[s] - repeats * sizes[s]
                target[s] = repeats * sizes[s]
                free.discard(s)
    return target


@pytest.fixture(scope="module")
def mixed_rows(prose):
    rows = [(i, prose(i, 5 + i % 90), f"s{i % 7}" if i % 11 else None) for i in range(300)]
    return rows + [(1000 + i, prose(i, 60), "s1") for i in range(400)]


def test_targets_and_taken_words(spark, documents, mixed_rows):
    laid, schedule = source_mix.mix(documents(mixed_rows), block=32)
    got = source_mix.taken_words(laid, schedule).collect()
    source = {i: s for i, _, s in mixed_rows}
    sizes = Counter()
    for i, t, s in mixed_rows:
        sizes[s] += len(t.split())
    target, taken = filled(sizes), Counter()
    assert len(got) == len(mixed_rows)
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    again = source_mix.taken_words(*source_mix.mix(documents(mixed_rows).repartition(5), block=32))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_slots_follow_the_weights_everywhere(spark, documents, mixed_rows):
    """Every stretch of the mix holds each source in proportion, and blocks are full."""
    laid, schedule = source_mix.mix(documents(mixed_rows), block=32)
    slots = schedule.groupBy("slot", "number").agg(F.sum("n_words").alias("n")).collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    share = Counter(r.number for r in slots)
    assert all(share[k] == math.ceil(g / 32) for k, g in {
        r.number: r.goal for r in laid.select("number", "goal").distinct().collect()}.items() if g)
    order = [r.number for r in sorted(slots, key=lambda r: r.slot)]
    for number, count in share.items():
        seen = 0
        for i, k in enumerate(order, 1):
            seen += k == number
            assert abs(seen - i * count / len(order)) < math.log2(len(order))
    assert sum(r.n != 32 for r in slots) <= len(share)
    pieces = defaultdict(list)
    for r in schedule.collect():
        pieces[r.number, r.bucket, r.row, r.round].append((r.first_word, r.n_words))
    for parts in pieces.values():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n


def test_mix_edges(spark, documents, edge_rows):
    laid, schedule = source_mix.mix(documents(edge_rows).withColumn("size", F.lit("x")))
    got = source_mix.taken_words(laid, schedule).collect()
    assert len(got) == len(edge_rows)
    assert sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _ in edge_rows)
    none = documents(edge_rows).limit(0)
    assert source_mix.taken_words(*source_mix.mix(none)).count() == 0
    empty = documents([(1, None, "a"), (2, "", None)])
    assert [r.taken for r in source_mix.taken_words(*source_mix.mix(empty)).collect()] == [0, 0]


def test_lattice_arithmetic(spark):
    for modulus in (7, 1000, (1 << 40) + 7):
        factor = source_mix.golden_step(modulus)
        assert math.gcd(factor, modulus) == 1
        for n in (0, 1, 12345, modulus - 1):
            row = spark.range(1).select(source_mix.times_mod(F.lit(n).cast("long"), factor, modulus)
                                        .alias("x")).first()
            assert row.x == n * factor % modulus
    assert source_mix.golden_step(1) == 1


def test_running_totals(spark):
    frame = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), F.lit(2).alias("v"))
    got = running(frame, [F.col("k")], {"before": F.col("v"), "rank": F.lit(1)}, parts=7)
    assert all(r.before == 2 * r.k and r.rank == r.k for r in got.collect())


@pytest.mark.parametrize("hot", [0, 600])
def test_shards_are_even_and_whole(spark, documents, prose, hot):
    rows = [(i, prose(i // 2, 3 + i % 50), "s") for i in range(900)]
    rows += [(5000 + i, "hot text " * 20, "s") for i in range(hot)]
    got = shards.shard(documents(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    text = {i: t for i, t, _ in rows}
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[text[r.doc_id]].add(r.shard)
    mean = sum(load.values()) / 16
    assert len(load) == 16 and all(abs(v - mean) < 700 for v in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith("hot"))
    again = shards.shard(documents(rows).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_shard_edges(spark, documents, edge_rows):
    got = shards.shard(documents(edge_rows).withColumn("shard", F.lit("x")), shards=4).collect()
    assert len(got) == len(edge_rows)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t, _ in edge_rows)
    assert shards.shard(documents(edge_rows).limit(0)).count() == 0
    alone = shards.shard(documents([(None, None, None)])).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.slot) for r in alone] == [(None, 1, 0, 0)]
