from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quirework.llm.fingerprint import LANES, combined, deleted, fingerprints, inserted

from .conftest import prose


def plain(text: str | None) -> str:
    sums = [0] * LANES
    for p in (text or "").split("\n"):
        p = p.strip(" \t\r")
        if p:
            digest = "".join(hashlib.sha256(f"{k}:{p}".encode()).hexdigest() for k in range(LANES // 8))
            for i in range(LANES):
                sums[i] = (sums[i] + int(digest[8 * i : 8 * i + 8], 16)) % 2**32
    return "".join(f"{s:08x}" for s in sums)


def test_is_the_sum_over_paragraphs(spark):
    rng = random.Random(0)
    texts = ["\n".join(rng.choice(["a", "b  ", "", " c\r", prose(rng, 4)]) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprints(df).collect():
        assert r.fingerprint == plain(r.text)


def test_order_is_free_and_counts_are_not(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("c\na\n\nb",), ("a\nb\nc\nc",), ("a\nb",)], "text string")
    a, b, c, d = (r.fingerprint for r in fingerprints(df).collect())
    assert a == b and len({a, c, d}) == 3


def test_paragraphs_come_and_go(spark):
    df = fingerprints(spark.createDataFrame([("a\nb", "c")], "text string, p string"))
    f, p = F.col("fingerprint"), F.col("p")
    other = fingerprints(spark.createDataFrame([("x\na",)], "text string")).collect()[0].fingerprint
    r = df.select(inserted(f, p).alias("i"), deleted(inserted(f, p), p).alias("d"), f.alias("f"), combined(f, F.lit(other)).alias("c")).collect()[0]
    assert r.i == plain("a\nb\nc") and r.d == r.f and r.c == plain("a\na\nb\nx")


def test_awkward_rows(awkward, empty):
    got = fingerprints(awkward.withColumn("fingerprint", F.lit(1)))
    rows = got.collect()
    assert len(rows) == awkward.count() and set(awkward.columns) < set(got.columns)
    assert all(r.fingerprint == "0" * 8 * LANES and r.n_paragraphs == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert all(r.fingerprint == plain(r.text) for r in rows)
    assert fingerprints(empty).count() == 0
    with pytest.raises(ValueError):
        fingerprints(awkward, lanes=5)
