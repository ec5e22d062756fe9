from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from quirework.llm import ngram_join
from quirework.llm.ngram_join import class_pairs, connected_components, drop_near_copies, near_groups, ngram_jaccard_join

from .conftest import prose


def grams(text, n):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(docs, n, t):
    g = {i: grams(x, n) for i, x in docs.items() if x is not None and i is not None}
    out = {}
    for a, b in itertools.combinations(sorted(g), 2):
        if g[a] and g[b] and len(g[a] & g[b]) / len(g[a] | g[b]) >= t - 1e-12:
            out[a, b] = round(len(g[a] & g[b]) / len(g[a] | g[b]), 6)
    return out


def edited(rng, text, share):
    return " ".join(rng.choice(["zz", w + "x"]) if rng.random() < share else w for w in text.split())


def corpus(seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(40)]
    for _ in range(60):
        texts.append(edited(rng, rng.choice(texts), rng.choice([0, 0.02, 0.08, 0.15])))
    texts += ["one", "one", "one two", "ONE, two!", ""]
    return dict(enumerate(texts))


def every_pair(df, n, t):
    """The pairs of representatives, with all copies of both."""
    membership, pairs = class_pairs(df, n, t)
    members = {}
    for r in membership.collect():
        members.setdefault(r.rep, []).append(r.doc_id)
    out = [(min(x, y), max(x, y), round(r.overlap / r.either, 6)) for r in pairs.collect() for x in members[r.a] for y in members[r.b]]
    return out + [(x, y, 1.0) for m in members.values() for x, y in itertools.combinations(sorted(m), 2)]


def links_and_classes(docs, pairs):
    links, group = dict.fromkeys(docs, 0), {i: i for i in docs}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    return {i: (group[i], n) for i, n in links.items() if n}


@pytest.mark.parametrize(("n", "t", "seed"), [(3, 0.5, 0), (1, 0.7, 1), (5, 0.25, 2), (2, 1.0, 3)])
def test_finds_all_pairs(spark, n, t, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    want, got = brute(docs, n, t), every_pair(df, n, t)
    assert {(a, b): j for a, b, j in got} == want
    assert len(got) == len(want)
    rows = ngram_jaccard_join(df, n, t).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in rows} == links_and_classes(docs, want)
    assert len(rows) == len({r.doc_id for r in rows})


def test_large_groups(spark):
    rng = random.Random(9)
    base = prose(rng, 100)
    docs = {i: edited(rng, base, 0.01) if i % 3 else base for i in range(700)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    want = brute(docs, 3, 0.5)
    assert {(a, b): j for a, b, j in every_pair(df, 3, 0.5)} == want
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_jaccard_join(df, 3, 0.5, rows_each=64).collect()} == links_and_classes(docs, want)
    assert near_groups(df).select("group_id").distinct().count() == 1


def test_large_groups_give_few_entries(spark, monkeypatch):
    """Copies that are joined already give no entries between each other; links within a group are counted over several tiles."""
    entries, real = [], ngram_join._row_blocks

    def spied(found, *args):
        entries.append(sum(len(r.row) // 4 for r in found.collect()))
        return real(found, *args)

    monkeypatch.setattr(ngram_join, "_row_blocks", spied)
    for name, value in (("PIECE_ROWS", 64), ("ENTRIES_AT_ONCE", 50)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    rng = random.Random(13)
    base = prose(rng, 100)
    docs = {i: edited(rng, base, 0.03) if i % 9 else prose(rng, 60) for i in range(360)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = links_and_classes(docs, brute(docs, 3, 0.5))
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_jaccard_join(df).collect()} == want
    assert entries[0] < 20 * len(docs)
    # rows beyond the bound of the broadcast count as not joined yet
    monkeypatch.setattr(ngram_join, "MOST_LABELS", 100, raising=False)
    assert {r.doc_id: (r.class_id, r.links) for r in ngram_jaccard_join(df).collect()} == want


def test_products_of_tiles():
    rng = random.Random(14)
    sides = [[np.unique(np.array([rng.randrange(5) if rng.random() < 0.3 else rng.randrange(300) for _ in range(rng.randint(1, 40))], np.uint64)) for _ in range(k)] for k in (70, 90)]
    want = [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]
    assert ngram_join._overlaps(*sides).astype(int).tolist() == want


def test_bands_join_copies_only():
    """Near copies share a band, texts that share few n-grams don't: such stars would send texts in vain."""
    rng = np.random.default_rng(15)
    base, other = (np.unique(rng.integers(0, 1 << 63, 300, np.uint64)) for _ in range(2))
    near = np.r_[base[30:], other[:30]]
    some = np.r_[other[:290], base[:10]]
    a, b, c = ngram_join._bands(np.concatenate([base, near, some]), np.cumsum([0, len(base), len(near), len(some)]))
    assert (a == b).any() and not (a == c).any()


def test_one_of_each_group_stays(spark):
    docs = corpus(4)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    group = {i: c for i, (c, _) in links_and_classes(docs, brute(docs, 3, 0.5)).items()}
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == sorted(i for i in docs if group.get(i, i) == i)


def test_short_hashes_lose_no_pair(spark, monkeypatch):
    """N-grams of a document whose bits collide lower counts; with 6 bits nearly all do."""
    monkeypatch.setattr(ngram_join, "SHORT", 6)
    docs = corpus(5)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {(a, b): j for a, b, j in every_pair(df, 3, 0.5)} == brute(docs, 3, 0.5)


def test_rows_that_share_half_a_key(spark, monkeypatch):
    """As if the first halves of keys had one bit."""
    real = ngram_join.text_keys

    def halved(h, offsets):
        out = real(h, offsets)
        out["a"] &= np.uint64(1)
        return out

    monkeypatch.setattr(ngram_join, "text_keys", halved)
    docs = {i: t for i, t in corpus(6).items() if i % 2}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {(a, b): j for a, b, j in every_pair(df, 3, 0.5)} == brute(docs, 3, 0.5)


def test_candidates_that_all_fail(spark):
    """Documents that share n-grams, none of them enough: every block is left without entries."""
    rng = random.Random(11)
    shared = prose(rng, 6)
    docs = [(i, f"{prose(rng, 12)} {shared} {prose(rng, 12)}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ngram_jaccard_join(df, 3, 0.5).count() == 0 and near_groups(df).count() == 0 and drop_near_copies(df).count() == 40


def test_components_of_paths(spark):
    rng = random.Random(0)
    nodes = list(range(60))
    rng.shuffle(nodes)
    edges = [(a, b) for chain in (nodes[:30], nodes[30:50]) for a, b in itertools.pairwise(chain)] + [(3, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(chain) for chain in (nodes[:30], nodes[30:50]) for x in chain}


def test_awkward_rows(awkward, empty):
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_jaccard_join(awkward).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 9: (9, 1), 10: (9, 1)}
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 1, 4, 5, 6, 7, 8, 9]
    assert ngram_jaccard_join(empty).count() == 0 and drop_near_copies(empty).count() == 0
    with pytest.raises(ValueError):
        ngram_jaccard_join(awkward, threshold=0)
