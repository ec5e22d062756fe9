from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm.classifier import Ftrl, Learner, classify, features, score, train

from .conftest import prose


def test_updates_are_those_of_the_formula():
    how, rng = Ftrl(alpha=0.2, beta=1.0, l1=0.3, l2=0.5), random.Random(0)
    learner = Learner(4, 1, how)
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        return 0.0 if abs(z[i]) <= how.l1 else -(z[i] - math.copysign(how.l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(60):
        x, y = sorted(rng.sample(range(16), rng.randint(1, 6))), rng.randint(0, 1)
        w = {i: weight(i) for i in [*x, 16]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        learner.update(np.array(x, np.uint32), np.array([float(y)]))
    assert np.allclose(learner.weights()[0], [weight(i) for i in range(17)])


def test_features_are_uni_and_bigrams_once_each():
    x, offsets = features(pa.array(["a b a b", "a b", None, "", "a b!!", "A b", "x x x x", "x x"]), 20)
    sets = [set(x[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    assert len(sets[0]) == 4 and sets[1] < sets[0] and sets[1] < sets[4]
    assert len(features(pa.array(["abcdefgh"]), 20)[0]) == 3
    assert sets[2] == sets[3] == set()
    assert sets[1] != sets[5]
    assert sets[7] <= sets[6]


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.select("doc_id", "quality", "toxic").toPandas()
    train_ids = set(known.doc_id[known.doc_id % 5 != 0])
    weights = train(docs, labels.filter("doc_id % 5 <> 0"))
    got = score(docs, weights).toPandas().merge(known, on="doc_id")
    got = got[~got.doc_id.isin(train_ids)]
    assert ((got.quality_x >= 0.5) == (got.quality_y == 1)).mean() > 0.95
    assert ((got.toxicity >= 0.5) == (got.toxic == 1)).mean() > 0.95
    assert (got.toxicity[got.toxic == 1] >= 0.5).mean() > 0.9


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(awkward, labels, bits=12).collect()
    assert len(got) == awkward.count()
    none = [r for r in got if r.doc_id in (4, 5, 6)]
    assert all((r.quality, r.toxicity, r.keep) == (0.0, 0.0, False) for r in none)
    assert classify(empty, labels, bits=12).count() == 0
    unknown = classify(awkward, labels.filter("false"), bits=12).filter("doc_id = 1").collect()
    assert all(r.quality == 0.5 for r in unknown)


def test_long_texts_count_to_the_end(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40) + (" badword" if i % 2 else ""), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - b, b) for i, _, b in rows], "doc_id long, quality int, toxic int")
    tail = spark.createDataFrame([(1000, prose(rng, 60_000) + " badword")], "doc_id long, text string")
    weights = train(docs, labels)
    a = score(tail, weights).collect()[0]
    b = score(tail.select("doc_id", tail.text.substr(1, 10_000).alias("text")), weights).collect()[0]
    assert a.toxicity > b.toxicity


def test_scores_are_sparse_dot_products(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(2, (1 << 12) + 1))
    texts = ["one two two two three", "Ünder the täble!", "", None, "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in score(df, weights).collect()}
    for k, text in enumerate(texts):
        x, _ = features(pa.array([text], pa.string()), 12)
        want = [round(float(1 / (1 + np.exp(-(w.astype(np.float32)[x].astype(float).sum() + np.float32(w[-1]))))), 5) if len(x) else 0.0 for w in weights]
        assert [round(got[k].quality, 5), round(got[k].toxicity, 5)] == pytest.approx(want, abs=2e-5)


def test_repeated_rows_do_not_lift_the_bound(spark):
    """3,000 rows of one labelled document are one row of training."""
    docs = spark.createDataFrame([(1, "good text here")] * 3000 + [(k, f"text {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    plain = docs.dropDuplicates()
    a, b = (train(d, labels, bits=10, train_rows=20) for d in (docs, plain))
    assert (a == b).all()
