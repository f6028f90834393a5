"""Line rules, the two classifiers and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratecheck.llm import line_rules, near_copies, quality_model, stages, toxicity
from test_near_copies import brute_groups


def test_lines_are_judged_first(spark, documents, edge_rows, prose):
    good = "\n".join(prose(i, 12) + "." for i in range(4))
    rows = edge_rows + [
        (20, good, "a"), (21, good + "\nHome | About | News | Contact", "a"),
        (22, "a | b | c | d | e | f | g | h | i | j | k\n" + prose(8, 5) + ".", "a"),
        (23, good + "\nWe use cookies on this site.", "a"), (24, "Go# now$ to% the& place* " * 4, "a"),
        (25, "WIN!! BIG!! CASH!! NOW!! FREE!! GIFT!! FOR!! YOU!! ALL!! DAY!!", "a")]
    docs = documents(rows).withColumn("kept", F.lit("x")).withColumn("_text", F.lit("y"))
    got = line_rules.clean_lines(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[20].kept and by[20].clean_text == good
    assert by[21].kept and by[21].clean_text == good and by[21].failed_lines == 1
    assert by[23].kept and by[23].clean_text == good
    assert not by[22].kept and not by[24].kept and not by[25].kept
    assert by[2].base_failed and by[2].n_words == 0 and by[2].clean_text == ""
    assert line_rules.clean_lines(docs.limit(0)).count() == 0


def test_repeated_windows_are_counted(spark, prose):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in range(40)] + [prose(1, 3000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def brute(t):
        w = t.split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})

    for r in line_rules.clean_lines(frame).collect():
        assert r.n_repeat_words == (0 if r.doc_id == 40 else brute(texts[r.doc_id]))


def test_isotonic_is_the_best_monotone_fit():
    rates = quality_model.isotonic(np.array([1., 1, 2, 1, 1]), np.array([0., 1, 1, 0, 1]))
    assert list(rates) == [0, 0.5, 0.5, 0.5, 1]
    draw = np.random.default_rng(1)
    n, p = draw.integers(1, 9, 50).astype(float), draw.random(50)
    got = quality_model.isotonic(n, n * p)
    assert (np.diff(got) >= 0).all()
    # Minimax formula of isotonic regression.
    for i in range(50):
        best = max(min((n * p)[a:b].sum() / n[a:b].sum() for b in range(i + 1, 51))
                   for a in range(i + 1))
        assert got[i] == pytest.approx(best)


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 1
        text = prose(i, 60)
        if toxic:
            words = text.split()
            for k in (i % 20, 25 + i % 30):
                words[k] = "vile" + "abc"[k % 3]
            text = " ".join(words)
        rows.append((i, " | ".join(text.split()) if bad else text + ".", "en", "s", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ridge_equals_direct_solution(spark, labelled):
    docs, labels = labelled
    model, measured = quality_model.train(docs, labels)
    rows = measured.join(labels, "doc_id").filter(~quality_model.held_out(F.col("doc_id"))).collect()
    x = model.features(np.array([r.stats for r in rows]))
    y = np.array([r.quality for r in rows], float)
    penalty = quality_model.RIDGE * len(y) * np.eye(x.shape[1]) / quality_model.FEATURES
    penalty[-1, -1] = 0
    direct = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    assert np.abs(x @ direct - x @ model.weights).max() < 1e-6


def test_quality_on_held_out_rows(spark, labelled, edge_rows, documents):
    docs, labels = labelled
    got = quality_model.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert got and np.mean([r.predicted == r.quality for r in got]) > 0.95
    edge = documents(edge_rows).withColumn("score", F.lit("x")).withColumn("stats", F.lit("y"))
    scores = quality_model.classify(edge, labels.limit(0)).collect()
    assert [r.score for r in scores] == [0.5] * len(edge_rows)
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark, labelled):
    docs, labels = labelled
    out = quality_model.held_out(F.col("doc_id"))
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.train(docs, x)[0] for x in (labels, other))
    assert np.allclose(a.weights, b.weights)


def test_gradient_of_the_network():
    net = toxicity.Network(2, [b"alpha", b"gamma"])
    rng = np.random.default_rng(5)
    net.p = {k: rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    words = [b"alpha", b"be", b"gamma,", b"d", b"epsilon"]
    at = np.array([[0, 1, 2, 3, 4, 1], [4, 3, 0, -1, -1, -1]])
    target = np.array([1.0, 0.0])

    def loss():
        x, _ = net.inputs(words)
        logit = net.forward(net.gates(x), at)
        return float((np.log1p(np.exp(logit)) - target * logit).sum())

    x, slots = net.inputs(words)
    logit, kept = net.forward(net.gates(x), at, keep=True)
    g = net.spread(net.gradient(at, kept, 1 / (1 + np.exp(-logit)) - target, len(words)), x, slots)
    for k, v in net.p.items():
        flat = np.flatnonzero(np.abs(g[k]).ravel() > 1e-3)
        for j in flat[:: max(1, len(flat) // 4)][:4]:
            old, step = v.ravel()[j], 1e-2
            v.ravel()[j] = old + step
            up = loss()
            v.ravel()[j] = old - step
            down = loss()
            v.ravel()[j] = old
            assert (up - down) / (2 * step) == pytest.approx(g[k].ravel()[j], rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    for n in (1, 63, 64, 65, 112, 500):
        rows = toxicity.windows_of(np.arange(n))
        assert set(rows.ravel()) - {-1} == set(range(n)) and rows.shape[1] == 64
        assert all(b - a <= 48 for a, b in zip(rows[:, 0], rows[1:, 0]))


def test_toxicity_on_held_out_rows(spark, labelled, edge_rows, documents):
    docs, labels = labelled
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert sum(r.predicted for r in got if r.toxic) > 0.7 * sum(r.toxic for r in got)
    edge = documents(edge_rows).withColumn("score", F.lit("x"))
    scores = toxicity.classify(edge, labels.limit(0)).collect()
    assert [r.score for r in scores] == [0.5] * len(edge_rows)
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_a_word_deep_in_a_long_text_counts(labelled):
    docs, labels = labelled
    sample = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").orderBy("doc_id").collect()]
    scorer = toxicity.Scorer(toxicity.train(sample, steps=120))
    long = " ".join(f"w{i % 4000}" for i in range(30_000))
    scores = scorer.scores([long, long + " vilea", None, ""])
    assert scores[1] > max(scores[0], 0.5) and scores[2] == scores[3] < scores[1]


def test_pipeline_stages(spark, data, tmp_path):
    """Each stage decides on its own input; the last places exactly what the mix gave."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    frames = [docs]
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, frames[-1], data)
        path = str(tmp_path / str(number))
        out.write.parquet(path)
        frames.append(spark.read.parquet(path))
    kept, single, clean, mixed, dealt = frames[1:]
    for frame in (kept, single, clean, mixed):
        assert frame.columns == docs.columns
    assert 0.5 * docs.count() < kept.count() < docs.count()
    groups = {r.first for r in near_copies.groups(kept).collect()}
    assert {r.doc_id for r in single.collect()} == groups and single.count() == len(groups)
    rows = sorted((r.doc_id, r.text or "") for r in kept.collect())
    brute = brute_groups([t for _, t in rows])
    assert groups == {rows[i][0] for i in set(brute)}
    hit = stages.drop_contaminated(spark, clean, data)
    assert hit.count() == clean.count() < single.count()
    words = F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    whole = {(r.doc_id, r.text) for r in clean.collect()}
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= whole
    most = clean.agg(F.max(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))).first()[0]
    sources = clean.select("source").distinct().count()
    want = 1.5 * clean.agg(words).first()[0]
    assert want - 20 <= mixed.agg(words).first()[0] <= want + 20 + most * sources
    assert dealt.count() == mixed.count()
    assert dealt.groupBy("doc_id").count().collect().__len__() == mixed.select("doc_id").distinct().count()


def test_stages_take_odd_rows(spark, documents, edge_rows, data):
    docs = documents(edge_rows)
    clashes = ("_score", "_stats", "_own", "_id", "_tag", "_node", "_label", "_first", "_best", "_row", "_tie",
               "_from", "tag", "size", "number", "bucket", "label", "key")
    for name in clashes:
        docs = docs.withColumn(name, F.lit(99))
    good = stages.keep_quality(spark, docs, data)
    single = stages.drop_near_copies(spark, docs, data)
    assert single.count() == near_copies.groups(docs).select("label").distinct().count()
    again = stages.drop_near_copies(spark, docs.repartition(7), data)
    assert sorted(single.collect(), key=repr) == sorted(again.collect(), key=repr)
    clean = stages.drop_contaminated(spark, docs, data)
    assert clean.count() == len(edge_rows)
    mixed = stages.mix_sources(spark, docs, data)
    assert mixed.filter("text is null").count() == 0
    for frame in (good, single, clean, mixed):
        assert frame.columns == docs.columns
        assert frame.filter(" OR ".join(f"{c} <> 99" for c in clashes)).count() == 0
    assert stages.deal_shards(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), data
                              ).count() == len(edge_rows)
    for _, function in stages.STAGES:
        assert function(spark, docs.limit(0), data).count() == 0
