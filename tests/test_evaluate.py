from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.evaluate import gate, metrics
from quirework.evaluate import source as L
from quirework.functions import geometry as G
from quirework.functions.maths import latex_of
from quirework.operators.formulas import formula
from quirework.plans import eval_queries as Q
from quirework.plans.convert import convert
from quirework.sources.adapters import html_blocks
from quirework.streaming.ingest import stream_pages


def test_scores(spark):
    rows = [(1, "The cat sat on the mat.", "the CAT sat on the mat"), (2, "a b c", "x y z and more"), (3, "", "text"), (4, "ﬁne $x^2$ words", "fine words"), (5, "a b", "a b and much more")]
    got = {r.i: r for r in metrics.score(spark.createDataFrame(rows, "i int, reference string, output string")).collect()}
    assert got[1].similarity == got[1].recall == got[1].coverage == got[4].similarity == 1.0
    assert got[2].recall == got[2].coverage == got[3].similarity == 0.0
    assert got[5].recall == 1.0 and got[5].similarity < 1.0


def test_prose_of_sources():
    assert L.prose_of("\\newcommand{\\todo}[1]{}\\begin{document}Keep \\todo{drop {this}} it, $x$ and \\emph{that}. % no\n\\begin{figure}x\\end{figure}``q''\\end{document} after") == 'Keep it, and that . "q"'
    assert L.prose_of(None) == "" and L.prose_of("50\\% of \\'e~f") == "50% of e f"
    assert L.heading_key("3.2 Model {\\bf Design}!") == "model design"
    assert L.inline_inputs({"m": "a \\input{b} \\include{none}", "b.tex": "c"}, "m") == "a c  "


def test_matching(spark):
    got = {r.paper: r for r in Q.equation_match(spark, "").collect()}
    assert (got["a"].reference, got["a"].found, got["b"].found, got["c"].reference) == (2, 2, 1, 0)
    assert {r.paper: (r.reference, r.found) for r in Q.section_match(spark, "").collect()} == {"a": (2, 1), "b": (0, 0), "c": (0, 0)}


def test_gate(spark):
    old = spark.createDataFrame([("a", 0.9, 3), ("b", 0.9, 3)], "paper string, bigram_recall double, tables_found int")
    same = gate.regressions(old, old)
    assert not gate.fails(same) and {r.verdict for r in same.collect()} == {"same"}
    assert gate.fails(gate.regressions(old.filter("paper = 'a'"), old)) and not gate.fails(gate.regressions(old.filter("paper = 'a'"), old, check_missing=False))
    assert gate.fails(gate.regressions(old.withColumn("tables_found", F.lit(2)), old)) and not gate.fails(gate.regressions(old.withColumn("bigram_recall", F.lit(0.896)), old))


def test_signs():
    assert [latex_of(c) for c in ("α", "Λ", "Α", "𝛽", "𝐀", "−", "x", "☃")] == ["\\alpha", "\\Lambda", "A", "\\beta", "A", "-", "x", None]


def test_formulas(spark):
    assert {r.formula_id: r.latex for r in Q.rebuilt_formulas(spark, "").collect()} == {1: "x^2", 2: "\\frac{a}{b}", 3: "\\sqrt{y}", 4: "\\alpha = \\beta_{ij}", 5: "☃"}
    assert formula([], []) == ("", 1.0)


def test_bibliography(spark):
    got = [(r.type, r.text, r.label) for r in Q.bibliography_blocks(spark, "").orderBy("doc_id", "ord").collect()]
    assert got[0] == ("paragraph", "As [[1](#ref-1), [3](#ref-3)] and [4] say.", None)
    assert [g[0] for g in got] == ["paragraph", "heading", "reference", "reference", "reference", "heading", "paragraph"]
    assert [g[2] for g in got[2:5]] == ["1", "2", "3"] and got[-1][1] == "No references [1]."


def test_figures(spark):
    assert [(r.type, r.text[:8]) for r in Q.figures_among_blocks(spark, "").orderBy("ord").collect()] == [("paragraph", "above it"), ("figure", "Figure 1"), ("paragraph", "below"), ("figure", "")]


def test_rectangles(spark):
    df = spark.createDataFrame([(3.0, 4.0, 1.0, 2.0)], "a float, b float, c float, d float").select(G.rect(*map(F.col, "abcd")).alias("r"))
    r = df.select("r", G.width(F.col("r")).alias("w"), G.clip(F.col("r"), F.lit(2.0), F.lit(9.0)).alias("c"), G.clip(F.col("r"), F.lit(1.0), F.lit(9.0)).alias("n"), G.path_kind(F.col("r")).alias("k")).collect()[0]
    assert tuple(r.r) == (1.0, 2.0, 3.0, 4.0) and r.w == 2.0 and tuple(r.c) == (1.0, 2.0, 2.0, 4.0) and r.n is None and r.k == "other"
    angles = spark.createDataFrame([(0.0,), (0.08,), (0.1,), (6.28,), (float("nan"),)], "t double").select(G.is_horizontal(F.col("t"))).collect()
    assert [a[0] for a in angles] == [True, True, False, True, False]


def test_conversion_and_its_stream(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "md", "light")
    assert query.awaitTermination(120)
    key = lambda df: sorted((r.doc_id, r.rendered) for r in df.select("doc_id", "rendered").collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(convert(html_blocks(pages), "md", "light"))
    with pytest.raises(ValueError):
        convert(html_blocks(pages), "pdf")


def test_command_line(spark, sf, tmp_path, capsys):
    from quirework.__main__ import main

    Q._primitives(spark).write.json(str(tmp_path / "d.json"))
    assert main(["convert", str(tmp_path / "d.json")]) == 0
    assert capsys.readouterr().out.startswith("# A Study of Things\n")
    assert main(["text", str(tmp_path / "d.json"), "--page", "0"]) == 0
    assert "1 Introduction" in capsys.readouterr().out
    assert main(["probe", str(tmp_path / "d.json")]) == 0 and main(["dump", str(tmp_path / "d.json"), "--page", "3"]) == 0
    assert main(["convert", f"{sf}/pages.parquet", "--out", str(tmp_path / "o"), "--caveman"]) == 0
    assert spark.read.parquet(str(tmp_path / "o/md")).count() > 0
