"""Queries of evaluation, mathematics, tables and whole conversions, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.evaluate import gate as Q
from quirework.evaluate import metrics
from quirework.evaluate import source as L
from quirework.functions import maths as M
from quirework.operators import bibliography as B
from quirework.operators import formulas as O
from quirework.plans import fixtures
from quirework.plans.convert import blocks_of_lines, blocks_of_primitives, convert
from quirework.plans.text_queries import docs
from quirework.sources import adapters as A
from quirework.sources import primitives as R

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


fixtures.TABLES |= {
    "latex": ("paper string, source string, emitted array<string>, headings array<string>", [
        ("a", r"\documentclass{x}\begin{document}\section{1. Model Design}Text with \textbf{bold} words \cite{k}. % gone" + "\n" + r"\begin{equation}E = mc^2 \label{e}\end{equation}\subsection*{Results {\bf today}}\begin{tabular}{c}x\end{tabular}\[ a+b=c \]\begin{thebibliography}{9}\bibitem{k} B. \bibitem[L(1)]{l} C.\end{thebibliography}\end{document}", ["E=mc^{2}", "a + b = c"], ["3 Model Design", "Discussion"]),
        ("b", r"\begin{align}x &= y \\ z_1 &= \frac{a}{b}\end{align} % \bibitem{no}", ["z_{1}=\\frac{a}{b}", "q"], []),
        ("c", "no markup at all", [], ["Introduction"]),
    ]),
    "runs": ("run string, paper string, bigram_recall double, equation_recall double, equation_fidelity double, tables_found int, references_found int, sections_found int", [
        ("old", "a", 0.9, 0.5, 0.7, 3, 10, 5), ("old", "b", 0.8, None, 0.6, 1, None, 2), ("old", "c", 0.7, 0.1, 0.1, 0, 1, 1),
        ("new", "a", 0.896, 0.6, 0.7, 2, 10, 6), ("new", "b", 0.79, 0.4, None, 1, 4, None), ("new", "d", 1.0, 1.0, 1.0, 1, 1, 1),
    ]),
    "maths": ("id int, text string", [(1, "where α = 2 holds for β_1 and γ alone"), (2, "no formula 3 = 3 in here"), (3, "∑ x ≤ 4 , ( δ ) ends"), (4, "α"), (5, "αβ")]),
    "fonts": ("id int, name string, word string", [(i, n, w) for i, (n, w) in enumerate([("CMMI10", "x"), ("CMR10", "the"), ("Mathematica1", "a"), ("STIXMath-Regular", "=2"), ("rtxmi", "α+1"), ("Times-Roman", "(3,"), ("MSBM10", "ℝ"), ("Arial", "–")])]),
}


@query(rf"""SELECT paper, len(list_filter(list_transform(flatten(list_transform(list_concat(regexp_extract_all(source, '{L.EQUATIONS}', 1), regexp_extract_all(source, '(?s)\\\[(.*?)\\\]', 1)), lambda b: string_split(b, '\\'))),
  lambda e: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(e, '\\(?:label|tag|intertext)\s*\{{[^{{}}]*\}}', '', 'g'), '\\[,;:!>]', '', 'g'), '\\(?:{L._COSMETIC})\b', '', 'g'), '\\\\|&', '', 'g'), '[{{}}\s]', '', 'g')), lambda e: length(e) >= 4))::INT AS n_equations,
  len(regexp_extract_all(source, '\\begin\{{tabular[x*]?\*?\}}'))::INT AS n_tables, len(regexp_extract_all(regexp_replace(source, '(?m)(^|[^\\])%.*?$', '\1', 'g'), '{L.BIBITEM}'))::INT AS n_references FROM {fixtures.sql("latex")}""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts(fixtures.table(spark, "latex"))


@query(fixtures.known("paper string, prose string, sections string", [("a", "1. Model Design Text with bold words . Results today", "model design; results today"), ("b", "", ""), ("c", "no markup at all", "")]))
def source_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "latex").select("paper", L.prose("source").alias("prose"), F.array_join(L.section_titles("source"), "; ").alias("sections"))


@query(fixtures.known("paper string, reference long, found long, fidelity double, recall double", [("a", 2, 2, 1.0, 1.0), ("b", 1, 1, 1.0, 1.0), ("c", 0, 0, 0.0, 0.0)]))
def equation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compare_equations(fixtures.table(spark, "latex"))


@query(fixtures.known("paper string, reference int, found int, recall double", [("a", 2, 1, 0.5), ("b", 0, 0, 0.0), ("c", 0, 0, 0.0)]))
def section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compare_sections(fixtures.table(spark, "latex"))


_FILLER = M.FILLER.replace("'", "''")
_FIELDS = [*Q.SCORES, *Q.COUNTS]


@query(f"""WITH r AS (SELECT * FROM {fixtures.sql("runs")}), o AS (SELECT * FROM r WHERE run = 'old'), n AS (SELECT * FROM r WHERE run = 'new'),
  l AS ({" UNION ALL ".join(f"SELECT o.paper, '{f}' AS field, o.{f}::DOUBLE AS b, {'coalesce(n.' + f + ', 0)' if f in Q.COUNTS else 'n.' + f}::DOUBLE AS a, {0.0 if f in Q.COUNTS else 0.005}::DOUBLE AS t FROM o JOIN n USING (paper)" for f in _FIELDS)})
SELECT paper, field, round(b, 4) AS before, round(a, 4) AS now, CASE WHEN a - b < -t THEN 'regress' WHEN a - b > t THEN 'improve' ELSE 'same' END AS verdict FROM l WHERE b IS NOT NULL AND a IS NOT NULL
UNION ALL SELECT paper, 'paper', 0, 0, 'missing' FROM o ANTI JOIN n USING (paper) UNION ALL SELECT paper, 'paper', 0, 0, 'new' FROM n ANTI JOIN o USING (paper)""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fixtures.table(spark, "runs")
    out = Q.regressions(runs.filter("run = 'new'").drop("run"), runs.filter("run = 'old'").drop("run"))
    return out.select("paper", "field", F.coalesce(F.round("before", 4), F.lit(0.0)).alias("before"), F.coalesce(F.round("now", 4), F.lit(0.0)).alias("now"), "verdict")


@query()
def copy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity, recall and coverage of each document by the next one of its source."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs(spark, sf_dir).withColumn("output", after).filter("output IS NOT NULL").select("doc_id", F.col("text").alias("reference"), "output")
    # sources are of unlike sizes: one of them has a third of all documents, which one task would compare
    pairs = pairs.repartition("doc_id")
    return metrics.score(pairs).drop("reference", "output")


@query(f"SELECT id, regexp_matches(upper(name), 'CM(?:MI|SY|EX|BSY)|MS[AB]M|EU[FS]M|RSFS|[TP]X(?:MI|SY|EX)') OR (contains(upper(name), 'MATH') AND NOT contains(upper(name), 'MATHEMATICA')) AS math_font, regexp_matches(word, '{M.SYMBOL}') AS symbol, CASE WHEN regexp_matches(word, '{M.SYMBOL}') THEN 'seed' WHEN regexp_matches(word, '{_FILLER}') THEN 'connector' ELSE 'prose' END AS role FROM {fixtures.sql('fonts')}")
def maths_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fonts").select("id", M.is_font(F.col("name")).alias("math_font"), M.is_symbol(F.col("word")).alias("symbol"), M.word_role(F.col("word"), F.lit(False)).alias("role"))


@query(rf"""WITH w AS (SELECT id AS doc_id, 0 AS ord, unnest(ws) AS t, unnest(range(len(ws)))::INT AS pos FROM (SELECT id, string_split(text, ' ') AS ws FROM {fixtures.sql("maths")})),
  r AS (SELECT *, CASE WHEN regexp_matches(t, '{M.SYMBOL}') THEN 'seed' WHEN regexp_matches(t, '{_FILLER}') THEN 'connector' ELSE 'prose' END AS role FROM w), s AS (SELECT *, sum((role = 'prose')::INT) OVER (PARTITION BY doc_id, ord ORDER BY pos) AS span FROM r)
SELECT doc_id, ord, span::BIGINT AS span, min(pos) AS first, max(pos) AS last, string_agg(t, ' ' ORDER BY pos) AS text FROM s WHERE role <> 'prose' GROUP BY doc_id, ord, span HAVING bool_or(role = 'seed') AND NOT (min(pos) = max(pos) AND length(string_agg(t, ' ')) = 1)""")
def inline_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.functions.text import split_words

    return O.inline_spans(fixtures.table(spark, "maths").select(F.col("id").alias("doc_id"), F.lit(0).alias("ord"), F.posexplode(split_words(F.col("text"))).alias("pos", "text")))


def _glyph(at: int, text: str, x: float, y: float, size: float = 10.0) -> tuple:
    return (at, text, float(x), y - 0.7 * size, x + 0.5 * size, float(y), float(y), float(size))


_GLYPHS = [
    _glyph(1, "x", 0, 100), _glyph(1, "2", 5, 96, 7), _glyph(2, "a", 10, 92), _glyph(2, "b", 10, 108), _glyph(3, "√", 0, 100), _glyph(3, "y", 5.2, 100), _glyph(4, "α", 0, 100), _glyph(4, "=", 8, 100), _glyph(4, "β", 16, 100), _glyph(4, "i", 21, 102, 7), _glyph(4, "j", 25, 102, 7), _glyph(5, "☃", 0, 100),
]


@query(fixtures.known("formula_id long, latex string, confidence double", [(1, "x^2", 1.0), (2, r"\frac{a}{b}", 1.0), (3, r"\sqrt{y}", 1.0), (4, r"\alpha = \beta_{ij}", 1.0), (5, "☃", 0.75)]))
def rebuilt_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs = spark.createDataFrame(_GLYPHS, "formula_id long, text string, x0 double, y0 double, x1 double, y1 double, oy double, size double")
    rules = spark.createDataFrame([(2, 8.0, 98.0, 18.0, 98.5), (3, 5.0, 92.5, 10.5, 93.0)], "formula_id long, x0 double, y0 double, x1 double, y1 double")
    return O.formulas(glyphs, rules)


@query()
def compressed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML pages as Markdown, compressed hard."""
    return convert(A.html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet")), "md", "hard")


@query()
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts through furniture, reading order, blocks and Markdown."""
    return convert(blocks_of_lines(A.typeset(docs(spark, sf_dir))), "md")


def _primitives(spark: SparkSession) -> DataFrame:
    def glyph(c: str, x: float, y: float, size: float = 10.0) -> dict:
        return {"text": c, "bbox": {"x0": x, "y0": y - 0.7 * size, "x1": x + 0.5 * size, "y1": y}, "ox": x, "oy": y, "font": "F1", "size": size, "angle": 0.0, "flags": 0, "color": 255, "generated": False}

    rows = [("A Study of Things", 60, 16.0), ("1 Introduction", 100, 12.0), ("The first words of it", 120, 10.0), ("go on in a second line.", 132, 10.0)]
    page = {"page": 0, "width": 612, "height": 792, "rotation": 0, "glyphs": [glyph(c, 72 + 0.5 * s * i, y, s) for t, y, s in rows for i, c in enumerate(t)], "paths": [{"bbox": {"x0": 72, "y0": 300, "x1": 400, "y1": 300.5}}], "images": [{"bbox": {"x0": 100, "y0": 400, "x1": 300, "y1": 900}, "object_index": 0, "px_width": 10, "px_height": 10}]}
    text = json.dumps({"doc_id": 1, "pages": [page]})
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", R.DOCUMENT).alias("d")).select("d.*")


@query(fixtures.known("doc_id long, rendered string", [(1, "# A Study of Things\n\n## 1 Introduction\n\nThe first words of it go on in a second line.\n\n*[figure]*\n")]))
def primitives_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of a page all the way to Markdown."""
    return convert(blocks_of_primitives(_primitives(spark)), "md")


@query(fixtures.known("doc_id long, page int, width float, height float, rotation int, n_glyphs int, n_paths int, n_images int, font string, n long, percent double, rank int", [(1, 0, 612.0, 792.0, 0, 75, 1, 1, "F1", 75, 100.0, 1)]))
def primitives_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a page's primitives, and its commonest fonts."""
    d = _primitives(spark)
    return R.pages(d).join(R.font_report(R.glyphs(d)), "doc_id")


@query(fixtures.known("doc_id long, ord int, type string, text string, page int, label string", [
    (1, 0, "paragraph", "As [[1](#ref-1), [3](#ref-3)] and [4] say.", 0, None), (1, 1, "heading", "References", 1, None), (1, 2, "reference", "[1] A. Author, B. Writer. A first work. 2001.", 1, "1"), (1, 3, "reference", "[2] C. Third. Another work of note. 2002.", 1, "2"),
    (1, 4, "reference", "[3] D. Fourth. The last one. 2003.", 1, "3"), (1, 5, "heading", "Appendix", 2, None), (2, 0, "paragraph", "No references [1].", 0, None),
]))
def bibliography_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the fixture as a paragraph after its heading, split, parsed and linked."""
    run = " ".join(f"[{k}] {t}" for k, t in enumerate(("A. Author, B. Writer. A first work. 2001.", "C. Third. Another work of note. 2002.", "D. Fourth. The last one. 2003."), 1))
    rows = [(1, 0, "paragraph", None, None, "As [1, 3] and [4] say.", 0, 10.0), (1, 1, "heading", 1, None, "References", 1, 12.0), (1, 2, "paragraph", None, None, run, 1, 10.0), (1, 3, "heading", 1, None, "Appendix", 2, 12.0), (2, 0, "paragraph", None, None, "No references [1].", 0, 10.0)]
    return B.extract_bibliography(spark.createDataFrame(rows, "doc_id long, ord int, type string, level int, ordered boolean, text string, page int, size float")).select("doc_id", "ord", "type", "text", "page", "label")


@query(fixtures.known("doc_id long, ord int, type string, text string, y0 double", [(1, 0, "paragraph", "above it all there is a text of more than twelve words, which stays where it is", 50.0), (1, 1, "figure", "Figure 1: a plot", 230.0), (1, 2, "paragraph", "below", 300.0), (1, 3, "figure", "", 500.0)]))
def figures_among_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captioned figure, one without caption, and labels within the first."""
    from quirework.operators.placement import attach_figures

    rows = [(1, k, t, None, None, x, 0, 72.0, y, 300.0, y + 10, 10.0, k) for k, (t, x, y) in enumerate((("paragraph", "above it all there is a text of more than twelve words, which stays where it is", 50.0), ("paragraph", "axis label", 150.0), ("caption", "Figure 1: a plot", 230.0), ("paragraph", "below", 300.0)))]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, type string, level int, ordered boolean, text string, page int, x0 float, y0 float, x1 float, y1 float, size float, start int")
    regions = spark.createDataFrame([(1, 0, 0, 72.0, 100.0, 300.0, 200.0), (1, 0, 1, 72.0, 500.0, 300.0, 600.0)], "doc_id long, page int, region int, x0 float, y0 float, x1 float, y1 float")
    return attach_figures(blocks, regions).select("doc_id", "ord", "type", "text", F.col("y0").cast("double").alias("y0"))
