from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quirework.operators import blocks as B
from quirework.operators import furniture as N
from quirework.operators import page as P
from quirework.operators import sections as S
from quirework.operators.stats import pooled_mode


def glyph(text, x, y, size=10.0, flags=0):
    return {"text": text, "box": (x, y - 0.7 * size, x + 0.5 * size, y), "ox": x, "oy": y, "size": size, "flags": flags, "break": False, "script": None}


def run(text, x, y, size=10.0, flags=0):
    return [glyph(c, x + 0.5 * size * i, y, size, flags) for i, c in enumerate(text)]


def texts(glyphs):
    return [" ".join(w["text"] for w in line.words()) for line in P.page_lines(glyphs)]


def test_lines_and_words():
    assert texts(run("hello", 72, 100)) == ["hello"]
    assert texts(run("ab", 72, 100) + run("cd", 85, 100)) == ["ab cd"]
    assert texts(run("ab", 72, 100) + run("cd", 82.5, 100)) == ["abcd"]
    assert texts(run("low", 72, 120) + run("top", 72, 100)) == ["top", "low"]
    assert texts(run("left", 72, 133) + run("side", 320, 130.5, 8)) == ["side", "left"]


def test_scripts_join_their_line():
    assert texts(run("x", 72, 100) + run("2", 77, 96, 7) + run("+y", 81, 100)) == ["x2+y"]


def test_marked_spaces_decide():
    assert texts(run("a b", 72, 100)) == ["a b"]


def test_large_initials_go_to_the_first_line():
    got = texts(run("C", 72, 112, 20) + run("onformal", 83, 100) + run("antennas", 83, 112))
    assert got == ["Conformal", "antennas"]


def test_bold_by_majority():
    assert P.page_lines(run("abc", 72, 100, flags=256) + run("d", 87, 100))[0].bold
    assert not P.page_lines(run("ab", 72, 100, flags=256) + run("cd", 82, 100))[0].bold


def test_word_gap_is_bounded():
    rng = random.Random(0)
    for _ in range(200):
        gaps = [rng.choice([rng.gauss(0.02, 0.01), rng.gauss(0.3, 0.05)]) for _ in range(rng.randint(0, 30))]
        assert 0.10 <= P.word_gap(gaps) <= 0.19
    assert P.word_gap([0.01] * 10 + [0.12] * 5) == 0.10


def order(rows):
    c = {k: np.array([r[i] for r in rows], float) for i, k in enumerate(("x0", "y0", "x1", "y1"))}
    return list(P.reading_order(**c, baseline=c["y1"], size=np.full(len(rows), 10.0)))


def test_title_then_left_then_right():
    left = [(72, 100 + 12 * i, 290, 110 + 12 * i) for i in range(5)]
    right = [(320, 100 + 12 * i, 540, 110 + 12 * i) for i in range(5)]
    rows = [(150, 40, 450, 60)] + [x for pair in zip(left, right, strict=True) for x in pair]
    assert order(rows) == [0, 1, 3, 5, 7, 9, 2, 4, 6, 8, 10]
    assert order([]) == [] and order(rows[:1]) == [0]


def test_order_is_a_permutation():
    rng = random.Random(1)
    for _ in range(50):
        rows = [(x := rng.uniform(0, 500), y := rng.uniform(0, 700), x + rng.uniform(1, 200), y + rng.uniform(1, 20)) for _ in range(rng.randint(0, 40))]
        assert sorted(order(rows)) == list(range(len(rows)))


def test_figures_merge_to_a_fixed_point():
    rng = random.Random(2)
    for _ in range(40):
        boxes = [(x := rng.uniform(0, 500), y := rng.uniform(0, 700), x + rng.uniform(1, 60), y + rng.uniform(1, 60)) for _ in range(rng.randint(0, 25))]
        out = P.merge_boxes(boxes, [False] * len(boxes))
        assert sum(r[2] for r in out) == len(boxes)
        for i, a in enumerate(out):
            for b in out[:i]:
                assert min(a[0][2], b[0][2]) - max(a[0][0], b[0][0]) < -24 or min(a[0][3], b[0][3]) - max(a[0][1], b[0][1]) < -24


def row(y, *cells):
    words = [{"text": t, "x0": x, "x1": x + 5 * len(t), "y0": y - 7, "y1": y} for x, t in cells]
    return {"text": " ".join(t for _, t in cells), "baseline": y, "x0": words[0]["x0"], "x1": words[-1]["x1"], "words": words}


def test_a_ruled_table():
    rules = [(72, y, 400, y + 0.5) for y in (100, 120, 170)]
    lines = [row(112, (80, "Name"), (200, "Size"), (320, "Cost")), row(135, (80, "one"), (200, "12"), (320, "3")), row(155, (80, "two"), (200, "4")), row(300, (80, "prose"))]
    got = P.page_tables(rules, lines, 10, [])
    assert [(t["rows"], t["header_rows"], t["lines"]) for t in got] == [([["Name", "Size", "Cost"], ["one", "12", "3"], ["two", "4", ""]], 1, [0, 1, 2])]
    assert P.page_tables(rules, lines, 10, [(0, 0, 612, 792)]) == []
    assert P.page_tables(rules[:1], lines, 10, []) == []
    assert P.page_tables([(72, 100, 90, 100.5), (72, 170, 90, 170.5)], lines, 10, []) == []


def test_pools_take_the_last_of_equals():
    assert pooled_mode([10, 10.1, 12], [1, 1, 2], 0.25) == 12 and pooled_mode([10, 10.1, 12], [1, 2, 2], 0.25) == 10
    assert pooled_mode([], [], 0.25) is None and pooled_mode([float("nan"), 3], [9, 1], 0.25) == 3


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page int, text string, baseline float, page_height float")


def test_furniture(spark):
    running = [(1, p, t, y, 792.0) for p in range(8) for t, y in (("A Journal of Things", 40.0), (f"body {p}", 300.0), (str(p), 760.0))]
    few = [(2, *r[1:]) for r in running if r[1] < 3]
    sides = [(3, p, ("Left Head" if p % 2 else "Right Head"), 40.0, 792.0) for p in range(8)] + [(3, p, f"text {chr(97 + p)}", 300.0, 792.0) for p in range(8)]
    got = N.mark_furniture(pages(spark, running + few + sides)).groupBy("doc_id").agg(F.sum(F.col("furniture").cast("int")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 16, 2: 0, 3: 8}


BLOCKS = "doc_id long, ord int, type string, level int, ordered boolean, text string, page int, size float, body_size float, leading float, x0 float, y0 float, x1 float, y1 float"


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, t, None, None, x, p, s, 10.0, 12.0, 72.0, 100.0 + 20 * i, 300.0, 110.0 + 20 * i) for i, (t, x, p, s) in enumerate(rows)], BLOCKS)


def listed(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("ord").select(*cols).collect()]


def test_titles_levels_and_items(spark):
    df = blocks(spark, [("heading", "On the Nature of Things", 0, 16.0), ("heading", "1 Introduction", 0, 12.0), ("heading", "1.1 Details", 0, 11.0), ("heading", "Methods", 1, 12.0), ("heading", "Other", 1, 14.0), ("list_item", "1. alone", 1, 10.0)])
    out = B.heading_levels(B.promote_title(B.demote_lonely_items(df)))
    assert listed(out, "type", "level") == [("title", None), ("heading", 1), ("heading", 2), ("heading", 1), ("heading", 1), ("paragraph", None)]
    near = blocks(spark, [("list_item", "a", 0, 10.0), ("paragraph", "b", 0, 10.0), ("list_item", "c", 0, 10.0), ("list_item", "d", 1, 10.0)])
    assert listed(B.demote_lonely_items(near), "type") == ["list_item", "paragraph", "list_item", "paragraph"]


def test_fragments(spark):
    df = blocks(spark, [("paragraph", "a long paragraph of text that goes", 0, 10.0), ("paragraph", "on here", 0, 10.0), ("paragraph", "References", 0, 10.0), ("paragraph", "one two three four", 0, 10.0)])
    assert listed(B.coalesce_fragments(df), "text") == ["a long paragraph of text that goes on here", "References", "one two three four"]


def test_sections_tile_and_nest(spark):
    df = spark.createDataFrame([(1, i, t, lv, x, i // 2) for i, (t, lv, x) in enumerate([("title", None, "T"), ("paragraph", None, "p"), ("heading", 1, "A"), ("heading", 2, "A.1"), ("paragraph", None, "q"), ("heading", 1, "B")])], "doc_id long, ord int, type string, level int, text string, page int")
    got = sorted((r.start, r.end, r.level, r.title, r.parent) for r in S.sections(df).collect())
    assert got == [(0, 2, 0, None, None), (2, 5, 1, "A", None), (3, 5, 2, "A.1", 2), (5, 6, 1, "B", None)]


def test_words_are_put_together_across_lines(spark):
    rows = [(1, 0, 0, "we study deep learn", 100.0, 10.0, 72.0, 300.0, 92.0, 100.0, False, 792.0), (1, 0, 1, "ing and more", 112.0, 10.0, 72.0, 200.0, 104.0, 112.0, False, 792.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, baseline float, size float, x0 float, x1 float, y0 float, y1 float, bold boolean, page_height float")
    stats = spark.createDataFrame([(1, 10.0, 12.0)], "doc_id long, body_size float, leading float")
    words = spark.createDataFrame([(1, "learning", 3)], "doc_id long, word string, n long")
    assert B.raw_blocks(lines, stats, words).collect()[0].text == "we study deep learning and more"
    assert B.raw_blocks(lines, stats, words.filter("false")).collect()[0].text == "we study deep learn ing and more"
