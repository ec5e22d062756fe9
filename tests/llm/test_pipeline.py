from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm.common import written
from quirework.llm.queries import oracle_sql, queries

from .test_ngram_join import brute as pairs
from .test_suffix import words


def test_each_stage_does_its_part(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.mode("overwrite").parquet(path := os.path.join(spark.conf.get("spark.checkpoint.dir"), f"stage-{name}"))
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
        if name != "windows":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {k: {r.doc_id: r.text for r in v[1].collect()} for k, v in out.items() if k != "windows"}
    assert not pairs(texts["near_copies"], 3, 0.5)
    lost = set(texts["quality"]) - set(texts["near_copies"])
    partners = {x for p in pairs(texts["quality"], 3, 0.5) for x in p}
    assert lost <= partners
    seen = set()
    for t in texts["passages"].values():
        w = words(t)
        mine = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert not mine & seen
        seen |= mine
    assert set(texts["mix"]) == set(texts["passages"])
    mixed, windows = out["windows"]
    total = sum(len((r.text or "").split()) for r in mixed.collect())
    assert windows.agg(F.sum("used")).collect()[0][0] == total
    assert windows.agg(F.max("used")).collect()[0][0] <= 2048


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(tuple(round(float(x), 5) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(a) == key(b)


def test_stages_over_awkward_rows(spark, awkward, empty):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names in every stage."""
    for first in (awkward, empty):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            if name != "windows":
                assert docs.columns == first.columns
            docs = written(docs, f"awkward-{name}")
        assert docs.filter("used > 2048").count() == 0
        assert (docs.count() == 0) == (first is empty)
