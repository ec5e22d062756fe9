from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.llm.packing import Packer, pack


def naive(sizes: list[int], window: int, limit: int) -> tuple[list[list[int]], list[list[int]]]:
    """Closed and open windows of one partition, by a scan of all open windows."""
    open_, closed = [], []
    for n in sizes:
        while n > 0:
            k = min(n, window)
            n -= k
            fits = [w for w in open_ if sum(w) + k <= window]
            if fits:
                best = max(fits, key=sum)
                best.append(k)
            elif k == window:
                closed.append([k])
                continue
            else:
                if len(open_) >= limit:
                    full = max(open_, key=sum)
                    open_.remove(full)
                    closed.append(full)
                best = [k]
                open_.append(best)
            if sum(best) == window:
                open_.remove(best)
                closed.append(best)
    return closed, open_


@pytest.mark.parametrize("seed", range(5))
def test_places_like_a_scan_of_all_open_windows(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 150) for _ in range(400)]
    packer, closed = Packer(100, 6), []
    for n in sizes:
        while n > 0:
            k = min(n, 100)
            n -= k
            closed += [used for used, _ in packer.place([k], k)]
            assert len(packer.free) <= 6
    a, b = naive(sizes, 100, 6)
    assert sorted(closed) == sorted(map(sum, a))
    assert sorted(u for u, _ in packer.rest()) == sorted(map(sum, b))


def pieces(df):
    return df.select("window", "used", F.explode("pieces").alias("p")).select("window", "used", "p.*").collect()


def test_every_token_is_in_one_window(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join("w" * rng.randint(0, 300))) for i in range(300)], "doc_id long, text string").repartition(5)
    out = pack(docs, window=128, open_windows=4)
    by_window, by_doc = {}, {}
    for r in pieces(out):
        by_window.setdefault((r.window, r.used), []).append(r.n)
        by_doc.setdefault(r.doc_id, []).append((r.start, r.n))
    assert all(sum(ns) == used <= 128 for (_, used), ns in by_window.items())
    assert len({w for w, _ in by_window}) == len(by_window) == out.count()
    want = {r.doc_id: len(r.text.split()) for r in docs.collect() if r.text.split()}
    for doc, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == want.pop(doc)
    assert not want


def test_leftovers_of_partitions_are_merged(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(8)], "doc_id long, text string").repartition(8)
    out = pack(docs, window=12, open_windows=2)
    assert sorted(r.used for r in out.collect()) == [12, 12]


def test_awkward_rows(awkward, empty):
    got = pieces(pack(awkward, window=1000, open_windows=3))
    assert sum(r.n for r in got if r.doc_id == 7) == 30_000
    assert sum(r.n for r in got if r.doc_id == 1) == 240
    assert {r.doc_id for r in got}.isdisjoint({4, 5, 6})
    assert pack(empty).count() == 0
    with pytest.raises(ValueError):
        pack(awkward, window=0)


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_leftovers_are_merged_as_a_tree(spark, fan_in):
    """However many tasks merge, no token is lost, and few windows are left with much room."""
    rng = random.Random(fan_in)
    docs = spark.createDataFrame([(i, " ".join("w" * rng.randint(1, 60))) for i in range(200)], "doc_id long, text string").repartition(20)
    rows = pack(docs, window=100, open_windows=3, fan_in=fan_in).collect()
    assert sum(r.used for r in rows) == sum(len(r.text.split()) for r in docs.collect())
    assert len({r.window for r in rows}) == len(rows) and all(r.used == sum(p.n for p in r.pieces) <= 100 for r in rows)
    assert sum(r.used <= 50 for r in rows) <= 3
