from __future__ import annotations

import difflib
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quirework.evaluate import metrics
from quirework.operators import blocks as B
from quirework.operators import columns as K
from quirework.operators import page as P
from quirework.operators import sections as S
from quirework.operators import vocabulary as V
from quirework.operators.groups import whole_groups
from quirework.plans import catalogue
from quirework.plans.convert import blocks_of_lines


@pytest.mark.parametrize("name", ["compress_hard", "compress_light"])
def test_first_letters_without_a_single_capital(spark, tmp_path, name):
    texts = ["ßheit the end", "the ßend of", "ﬁne is it", "ŉ so", "ᾳ the", "ᾆ is", "ǰ", "Furthermore, ßo it is", "İs it an İs", "élan", "straße", "ǆ one", ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(len(?::VARCHAR[]))) AS doc_id, unnest(?::VARCHAR[]) AS text", [texts, texts])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = {r.doc_id: r.compressed for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalogue.SQL[name]).fetchall())


def test_pages_are_read_at_once():
    rng = np.random.default_rng(7)
    for _ in range(15):
        pages = []
        for kind in rng.integers(0, 4, int(rng.integers(1, 40))):
            n = int(rng.integers(1, 50))
            x = np.where(np.arange(n) % 2, 320.0, 72.0) if kind == 0 else rng.integers(0, 5, n) * 100.0 if kind == 1 else rng.random(n) * 500
            y = 60 + 12.0 * np.arange(n) if kind < 2 else rng.random(n) * 700
            size = rng.choice([0.0, 8.0, 10.0, 14.0], n)
            if kind == 3:
                x[0] = np.nan
            pages.append((x, y - size, x + rng.random(n) * 120, y, y, size))
        page = np.repeat(np.arange(len(pages)), [len(p[0]) for p in pages])
        first = np.searchsorted(page, np.arange(len(pages)))
        want = np.concatenate([a + P.reading_order(*p) for a, p in zip(first, pages, strict=True)])
        assert np.array_equal(P.reading_order_of_pages(page, *map(np.concatenate, zip(*pages, strict=True))), want)


def test_groups_are_whole_whatever_the_batches():
    keys = [None, None, 1, 1, 1, 2, 3, 3, 3, 3, 4]
    table = pa.table({"k": pa.array(keys, pa.int64()), "v": list(range(len(keys)))})
    for size in (1, 2, 3, 20):
        seen = []
        for part, group, starts in whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"]):
            assert starts.tolist() == [group.tolist().index(g) for g in range(len(starts))]
            seen += [[part.column("k")[int(s)].as_py(), [v for v, g in zip(part.column("v").to_pylist(), group, strict=True) if g == n]] for n, s in enumerate(starts)]
        assert seen == [[None, [0, 1]], [1, [2, 3, 4]], [2, [5]], [3, [6, 7, 8, 9]], [4, [10]]]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_sixty_characters(spark, tmp_path):
    word, far = "information " * 9, "😀ab 𝒳cd information " * 7
    texts = [word, far, "", None, "x" * 60, "x" * 61, "information\nfor " * 8, "é" * 119 + " form ation"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(len(?::VARCHAR[]))) AS doc_id, unnest(?::VARCHAR[]) AS text", [texts, texts])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    df = catalogue.QUERIES["word_rejoining"](spark, str(tmp_path))
    # a substring for each line reads the text from its beginning
    assert "substring(" not in plan(df)
    want = con.execute(catalogue.SQL["word_rejoining"]).fetchall()
    assert want and sorted(map(tuple, df.collect())) == sorted(want)


def test_pages_of_html_are_read_twice(spark, sf):
    # once for the blocks and once for the outline
    assert plan(catalogue.QUERIES["html_document"](spark, sf)).count("FileScan") == 2


def test_outlines_of_odd_levels(spark):
    kinds = ["paragraph", "heading", "paragraph", "heading", "heading", "heading", "paragraph"]
    rows = [(d, k, t, None if t == "paragraph" else lv, f"t{k}", k // 2) for d, levels in ((1, (2, 7, 1)), (2, (1, None, 3))) for k, t, lv in zip(range(7), kinds, (None, 3, None, *levels, None), strict=True)]
    rows += [(3, 5, "heading", 1, "alone", 4), (4, 2, "paragraph", None, "none", 9)]
    got = S.sections(spark.createDataFrame(rows, "doc_id long, ord int, type string, level int, text string, page int")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.level, r.first_page, r.last_page, -1 if r.parent is None else r.parent) for r in got) == [
        (1, 0, 1, 0, 0, 0, -1), (1, 1, 3, 3, 0, 1, -1), (1, 3, 5, 2, 1, 2, -1), (1, 4, 7, 7, 2, 3, -1), (1, 5, 7, 1, 2, 3, -1),
        (2, 0, 1, 0, 0, 0, -1), (2, 1, 3, 3, 0, 1, -1), (2, 3, 4, 1, 1, 1, -1), (2, 4, 7, 1, 2, 3, -1), (2, 5, 7, 3, 2, 3, 4),
        (3, 0, 1, 1, 4, 4, -1), (4, 0, 1, 0, 9, 9, -1),
    ]


def test_profiles_need_no_shuffle(spark, sf):
    assert "Exchange" not in plan(catalogue.QUERIES["coverage_profile"](spark, sf))


def test_profiles_of_odd_boxes(spark):
    rows = [(1, 0, 0.5, 2.0, 3.5), (1, 0, -4.0, 1.2, 3.5), (1, 0, 3.0, 99.0, 3.5), (1, 1, 5.0, 6.0, 2.0), (2, 0, 1.0, 1.0, 1.0), (2, 1, 0.0, 1.0, 0.0)]
    got = K.coverage(spark.createDataFrame(rows, "doc_id long, page int, x0 float, x1 float, page_width float")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 2), (1, 0, 1, 2), (1, 0, 2, 0), (1, 0, 3, 1), (1, 1, 0, 0), (1, 1, 1, 0), (2, 0, 0, 0)]


def test_similarity_holds_one_pair_at_a_time():
    a = pa.array([[f"w{k % 97}é{i}" for k in range(100)] for i in range(300)] + [None, []])
    b = pa.array([[f"w{k % 89}é{i}" for k in range(100)] for i in range(300)] + [["x"], None])
    whole = sum(len(x) * 60 for x in a.to_pylist() if x)
    tracemalloc.start()
    got = metrics.similarity.func(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < whole / 10
    assert got.to_pylist()[:300] == [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a.to_pylist()[:300], b.to_pylist()[:300], strict=True)] and got.to_pylist()[300:] == [0.0, 0.0]
    assert metrics.nfkc.func(pa.array(["ﬁne", None, "plain", ""])).to_pylist() == ["fine", None, "plain", ""]


def test_conversions_read_their_lines_once(spark):
    rows = [(d, 0, k, t, 60 + 12.0 * k, 10.0) for d in (1, 2) for k, t in enumerate(("A line of words that is long enough to fill", "the page and one more.", "etc"))]
    lines = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, baseline float, size float")
    lines = lines.selectExpr("*", "72f AS x0", "cast(72 + 5 * length(text) as float) AS x1", "baseline - size AS y0", "baseline AS y1", "false AS bold", "600f AS page_height")
    df = blocks_of_lines(lines)
    # lines are ordered before, so that what remains is their texts and the fold over blocks; no group is an Arrow stream of its own
    assert plan(df).count("MapInArrow") == 2 and "FlatMapGroups" not in plan(df)
    assert [(r.doc_id, r.text) for r in df.orderBy("doc_id", "ord").collect()] == [(d, "A line of words that is long enough to fill the page and one more. etc") for d in (1, 2)]


def test_words_are_counted_where_they_are_asked_for(spark):
    rng = np.random.default_rng(3)
    words = ["information", "in", "formation", "form", "deep-learning", "deep", "learning", "Übung", "straße", "x1", "a", "(see", "-", "ΟΔΟΣ"]
    rows = []
    for d in range(60):
        text = " ".join(words[k] for k in rng.integers(0, len(words), 120))
        for k in range(0, len(text), 40):
            line = text[k : k + 40].strip()
            if rng.random() < 0.2 and len(line) > 3:
                line = line[:-1] + rng.choice(["-", "‐"])
            rows.append((d, k // 400, k // 40, None if rng.random() < 0.02 else line, 60 + 12.0 * (k // 40 % 10) + (40 if k // 40 % 10 > 6 else 0), 10.0))
    lines = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, baseline float, size float")
    lines = lines.selectExpr("*", "72f AS x0", "cast(72 + 200 + 8 * (ord % 3) as float) AS x1", "baseline - size AS y0", "baseline AS y1", "false AS bold", "600f AS page_height")
    stats = lines.selectExpr("doc_id", "10f AS body_size", "12f AS leading").distinct()
    with_table, without = (B.raw_blocks(lines, stats, w) for w in (V.vocabulary(lines), None))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])
    assert key(with_table) == key(without)
    assert any("information" in r.text and "in formation" not in r.text for r in without.collect())
    # no table of words is made
    assert "hashpartitioning(doc_id" in plan(without) and "word" not in plan(without)
