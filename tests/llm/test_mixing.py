from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.llm.mixing import mix_sources, source_epochs

from .conftest import prose


def water_fill(chars, weights, cap, budget):
    """Clamp and redistribute until nothing is beyond its cap."""
    clamped: set = set()
    live = {s for s in chars if weights[s] > 0 and chars[s] > 0}
    share = {s: 0.0 for s in chars}
    while True:
        rest = budget - sum(chars[s] * cap for s in clamped)
        free = live - clamped
        total = sum(weights[s] for s in free)
        for s in free:
            share[s] = rest * weights[s] / total
        over = {s for s in free if share[s] >= chars[s] * cap}
        if not over:
            break
        clamped |= over
        for s in over:
            share[s] = chars[s] * cap
    return {s: share[s] / chars[s] if chars[s] else 0.0 for s in chars}


@pytest.mark.parametrize("seed", range(4))
def test_epochs_are_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(9)]
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(sources[: 1 + i % 9])) for i in range(200)]
    chars = {}
    for _, t, s in rows:
        chars[s] = chars.get(s, 0) + len(t)
    weights = {s: rng.choice([0, 0.5, 1, 5, 40]) for s in sources}
    weights["s0"] = 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r.epochs for r in source_epochs(docs, weights, 3.0).collect()}
    want = water_fill(chars, weights, 3.0, sum(chars.values()))
    assert got == pytest.approx(want, abs=1e-6)
    assert all(e <= 3.0 + 1e-9 for e in got.values())


def test_whole_and_fractional_repetitions(spark):
    docs = spark.createDataFrame([(i, "abcd", "a" if i < 2000 else "b") for i in range(4000)], "doc_id long, text string, source string")
    got = mix_sources(docs, {"a": 3.0, "b": 1.0}, max_epochs=4.0, seed=3)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 120 and abs(n["b"] - 1000) < 120
    assert got.groupBy("doc_id").agg(F.max("repetition").alias("m")).agg(F.max("m")).collect()[0][0] == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mix_sources(docs.repartition(9), {"a": 3.0, "b": 1.0}, max_epochs=4.0, seed=3).collect()))


def test_cover_keeps_every_document(spark):
    docs = spark.createDataFrame([(i, "abcd", "a" if i < 100 else "b") for i in range(130)], "doc_id long, text string, source string")
    got = mix_sources(docs, power=0.5, max_epochs=4.0, budget="cover", seed=1)
    assert got.select("doc_id").distinct().count() == 130


def test_awkward_rows(awkward, empty):
    got = mix_sources(awkward.withColumn("repetition", F.lit("x")), {"a": 2.0}, max_epochs=4.0)
    assert got.columns == [*awkward.columns, "repetition"]
    epochs = {r.source: r for r in source_epochs(awkward).collect()}
    assert None in epochs and epochs[None].n_docs == 3
    assert mix_sources(empty).count() == 0
    assert source_epochs(awkward.filter("doc_id in (4, 5)")).agg(F.sum("epochs")).collect()[0][0] == 0
    for bad in ({"max_epochs": 0.0}, {"weights": {"a": -1.0}}):
        with pytest.raises(ValueError):
            mix_sources(awkward, **bad)


def test_many_sources_are_joined_with_salted_documents(spark):
    """The join for more sources than are broadcast gives the same rows."""
    docs = spark.createDataFrame([(i, "abcd" * (1 + i % 3), None if i % 7 == 0 else f"s{i % 5}") for i in range(300)], "doc_id long, text string, source string")
    a, b = (mix_sources(docs, {"s1": 3.0}, seed=2, most_broadcast=k).collect() for k in (100, 1))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a)
