import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    gold = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, gold[r.doc_id]) for r in rows if r.held_out and r.doc_id in gold]
    assert sum(p == g for p, g in held) / len(held) > 0.9
    assert all(p for p, g in held if g == 1)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    scores = rng.random(400)
    labels = (rng.random(400) < scores).astype(float)
    knots, levels = quality.isotonic(scores, labels)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    order = np.argsort(scores)
    y = labels[order]
    sums = np.concatenate([[0], np.cumsum(y)])
    slope = [max(min((sums[j] - sums[i]) / (j - i) for j in range(k + 1, 401)) for i in range(k + 1)) for k in range(0, 400, 40)]
    at = np.interp(scores[order][::40], knots, levels)
    assert np.abs(at - np.array(slope)).max() < 0.2


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    n = 3000
    model = quality.Model(np.zeros(5), np.ones(5), rng.normal(0, 1 / quality.WIDTH, (5, n)), rng.uniform(0, 2 * np.pi, n), np.zeros(n + 1))
    x = rng.normal(size=(20, 5))
    z = model.features(x)[:, 1:]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.1


def test_nulls_repeats_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7) if i % 5 else "!!!| " * i, "x", 9.0) for i in range(60)] + [(60, None, None, None), (60, None, None, None), (None, "é" * 50_000, "", None)], "doc_id bigint, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), None) for i in range(60)] + [(3, None, 1), (None, 1, 1)], "doc_id bigint, quality int, text string")
    scored = quality.score(df, quality.train(df, labels.drop("text")))
    rows = scored.collect()
    assert scored.columns == ["doc_id", "text", "label", "score", "predicted"] and len(rows) == 63
    assert len({r.score for r in rows if r.doc_id == 60}) == 1
    assert quality.train(df, labels.limit(0)) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5}
    assert quality.score(df.limit(0), None).collect() == []


@pytest.mark.parametrize("text", [None, "", " ", "\n", "a", "😀|!?", "x" * 10_000])
def test_statistics_have_one_length(text):
    stats = quality.statistics(text)
    assert len(stats) == quality.STATISTICS and np.isfinite(stats).all()


def test_held_out_of_null(spark):
    assert spark.range(1).select(quality.held_out(F.lit(None).cast("long"))).first()[0] is False


def test_scores_equal_a_plain_ridge_and_pooling(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 40)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["word", "x1", "!!", "Ab.", "zzz"], rng.integers(1, 60))) for _ in range(300)]
    labels = [int(t.count("!!") * 3 < len(t.split())) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    gold = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, quality int")
    model = quality.train(df, gold)
    rows = quality.sample(df, gold, "doc_id", "text", "quality", 1000).collect()
    assert len(rows) == len({(r._text) for r in rows})
    stats = np.array([quality.statistics(r._text) for r in rows])
    y, fold = np.array([r._label for r in rows]), np.array([r._fold for r in rows])
    scale = stats.std(axis=0)
    z = np.clip((stats - stats.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -8, 8)
    f = np.hstack([np.ones((len(z), 1)), np.sqrt(2 / 40) * np.cos(z @ model.directions + model.phases)])
    own = f[fold == 0]
    weights = np.linalg.solve(own.T @ own + (quality.RIDGE * len(own) / 40 + 1e-9) * np.eye(41), own.T @ y[fold == 0])
    assert np.allclose(f @ weights, f @ model.weights, atol=1e-6)
    raw, held = (f @ weights)[fold == 1], y[fold == 1]
    order = np.argsort(raw)
    sums = np.concatenate([[0], np.cumsum(held[order])])
    n = len(held)
    best = [max(min((sums[j] - sums[i]) / (j - i) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)]
    pools = [[k for k in range(n) if abs(best[k] - v) < 1e-12] for v in sorted(set(np.round(best, 12)))]
    pools = [p for p in pools if p]
    knots = [raw[order][p].mean() for p in pools]
    levels = np.maximum.accumulate([(held[order][p].sum() + 0.5) / (len(p) + 1) for p in pools])
    want = np.clip(np.interp(f @ weights, knots, levels), 0, 1)
    got = {r.text: r.score for r in quality.score(df, model).collect()}
    assert np.allclose([got[r._text] for r in rows], want, atol=1e-6)


def test_hot_ids_and_repeats_stay_in_bounds(spark):
    df = spark.createDataFrame([(7, "the same words")] * 400 + [(7, f"other words {i}") for i in range(200)] + [(i, f"text {i}") for i in range(8, 60)], "doc_id bigint, text string").repartition(4)
    gold = spark.createDataFrame([(7, 1)] * 300 + [(7, 0)] + [(i, i % 2) for i in range(8, 60)], "doc_id bigint, quality int")
    rows = quality.sample(df, gold, "doc_id", "text", "quality", 100).collect()
    assert len({r._text for r in rows}) <= 100 and len(rows) <= 200
    assert len({r.score for r in quality.score(df, quality.train(df, gold, rows=100)).filter("text = 'the same words'").collect()}) == 1
