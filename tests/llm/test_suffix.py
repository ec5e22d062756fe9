from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quirework.llm import suffix
from quirework.llm.suffix import cut_passages, refine, repeated_passages

from .conftest import prose


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs: dict[int, str], n: int) -> dict[int, dict[int, bool]]:
    """Of each document the starts of windows that occur more than once, and whether each is the first."""
    where: dict[tuple, list] = {}
    for d in sorted(docs):
        w = words(docs[d])
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    out: dict[int, dict[int, bool]] = {}
    for places in where.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(places):
                out.setdefault(d, {})[i] = k == 0
    return out


def found(df, n):
    out: dict[int, dict[int, bool]] = {}
    for r in df.collect():
        for i in range(r.start_word, r.end_word - n + 1):
            assert i not in out.setdefault(r.doc_id, {})
            out[r.doc_id][i] = r.first
    return out


@pytest.mark.parametrize(("n", "q", "seed"), [(10, 4, 0), (12, 12, 1), (7, 1, 2), (20, 9, 3)])
def test_finds_what_a_table_of_all_windows_finds(spark, n, q, seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(n - 1, 3 * n)) for _ in range(6)]
    docs = {i: " ".join(rng.choice([prose(rng, rng.randint(0, 2 * n)), rng.choice(shared)]) for _ in range(5)) for i in range(60)}
    docs[60] = "a " * 200
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    assert found(repeated_passages(df, min_words=n, q=q), n) == brute(docs, n)


@pytest.mark.parametrize(("depth", "q"), [(1, 1), (5, 2), (50, 17), (6, 6)])
def test_refinement_sorts_suffixes(depth, q):
    rng = np.random.default_rng(depth)
    texts = [np.r_[rng.integers(0, 2, 90), rng.integers(0, 3, rng.integers(1, 40))] for _ in range(6)]
    texts.append(texts[2].copy())
    words = np.concatenate(texts)
    left = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
    at, bucket = refine(words, left, depth, q)
    have = {i: tuple(words[i : i + depth]) for i in range(len(words)) if left[i] >= depth}
    several = [w for w in have.values() if list(have.values()).count(w) > 1]
    assert sorted(at) == [i for i, w in have.items() if w in several]
    assert [have[i] for i in at] == sorted(have[i] for i in at)
    assert len(set(bucket)) == len(set(several)) and all((bucket[i] == bucket[i + 1]) == (have[at[i]] == have[at[i + 1]]) for i in range(len(at) - 1))


def test_hot_anchors_and_several_goes(spark, monkeypatch):
    """A passage that most documents have, with other words around it, sorted in many small goes."""
    monkeypatch.setattr(suffix, "HOT_LEAST", 8)
    monkeypatch.setattr(suffix, "HOT_SHARE", 0.02)
    monkeypatch.setattr(suffix, "AT_ONCE", 2000)
    rng = random.Random(6)
    passage = prose(rng, 33)
    docs = {i: f"{prose(rng, 20)} {passage} {prose(rng, 3)} {prose(rng, 20)}" if i % 3 else prose(rng, 30) for i in range(60)} | {70: passage, 71: passage + " " + passage}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    anchors = suffix._anchors(df, 12, 5, 4)
    assert len(suffix._hot_anchors(anchors))
    assert found(repeated_passages(df, min_words=12, q=5), 12) == brute(docs, 12)


def test_rows_of_one_document_are_no_repeats(spark):
    rng = random.Random(8)
    a, b = prose(rng, 70), prose(rng, 70)
    rows = [(1, a), (1, a), (1, a), (2, b), (3, b), (3, b), (2, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts_ in (1, 3, 7):
        assert {(r.doc_id, r.start_word, r.end_word, r["first"]) for r in repeated_passages(df.repartition(parts_), min_words=50).collect()} == {(2, 0, 70, True), (3, 0, 70, False)}


def test_cutting_leaves_the_first_and_all_else(spark):
    rng = random.Random(4)
    passage, a, b = prose(rng, 60), prose(rng, 30), prose(rng, 30)
    df = spark.createDataFrame([(1, f"{a}\n{passage}", 0), (2, f"{passage}. {b}", 0), (3, passage, 0), (4, b, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in cut_passages(df, min_words=50).collect()}
    assert got[1].text == f"{a}\n{passage}" and got[4].text == b
    assert got[2].text.split() == b.split() and got[2].n_chars == len(got[2].text)
    assert 3 not in got


def test_awkward_rows(awkward, empty):
    got = cut_passages(awkward, min_words=50)
    assert got.columns == awkward.columns
    rows = {}
    for r in got.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[1]) == 2 and 2 not in rows and len(rows[3][0].text.split()) == 5
    assert rows[4][0].text == "" and rows[5][0].text is None and len(rows[7][0].text.split()) == 30_000 and len(rows[None]) == 2
    assert repeated_passages(empty).count() == 0 and cut_passages(empty).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(awkward, min_words=3, q=4)
