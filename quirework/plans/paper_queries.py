"""Queries over pages of primitives: each case is a small document whose results are known, which is its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import columns as K
from quirework.operators import furniture as N
from quirework.operators import paper
from quirework.operators import render as E
from quirework.operators import sections as S
from quirework.operators import stats as T
from quirework.plans.convert import blocks_of_primitives, convert
from quirework.plans import fixtures
from quirework.plans.fixtures import known
from quirework.sources import primitives as R
from quirework.sources.pdf import parse_pdfs

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(schema: str, rows: list[tuple]) -> Callable:
    """Registers a query with the rows that it must give."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = known(schema, rows)
        return f

    return add


# ---- typesetting


def glyph(c: str, x: float, y: float, size: float = 10.0, font: str = "F1", height: float | None = None, width: float | None = None, **more: object) -> dict:
    """A glyph half as wide as its size, on baseline y."""
    tall, wide = 0.7 * size if height is None else height, 0.5 * size if width is None else width
    return {"text": c, "bbox": {"x0": x, "y0": y - tall, "x1": x + wide, "y1": y}, "ox": x, "oy": y, "font": font, "size": size, "angle": 0.0, "flags": 0, "color": 255, "generated": False} | more


def run(text: str, x: float, y: float, size: float = 10.0, font: str = "F1") -> list[dict]:
    """Glyphs side by side; spaces leave gaps."""
    return [glyph(c, x + 0.5 * size * k, y, size, font) for k, c in enumerate(text) if c != " "]


def rule(x0: float, y: float, x1: float) -> dict:
    return {"bbox": {"x0": x0, "y0": y, "x1": x1, "y1": y + 0.5}}


def page(number: int, glyphs: list[dict], paths: list[dict] | None = None, images: list[dict] | None = None) -> dict:
    return {"page": number, "width": 612, "height": 792, "rotation": 0, "glyphs": glyphs, "paths": paths or [], "images": images or []}


def documents(spark: SparkSession, cases: list[list[dict]]) -> DataFrame:
    """Documents of pages, numbered from 1."""
    rows = [(json.dumps({"doc_id": k, "pages": pages}),) for k, pages in enumerate(cases, 1)]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", R.DOCUMENT).alias("d")).select("d.*")


# ---- lines

_LINES = [
    [page(0, run("hello", 72, 100))],
    [page(0, run("ab", 72, 100) + run("cd", 85, 100) + run("ef", 95.5, 100))],
    [page(0, run("x", 72, 100) + run("2", 77, 96, 7) + run("+y", 80.5, 100))],
    [page(0, run("one", 72, 133) + run("two", 300, 130.5, 8))],
    [page(0, run("C", 72, 120, 20) + run("onformal antennas", 82.5, 108) + run("are set here", 84.5, 120))],
    [page(0, run("flat", 72, 100) + [glyph("u", 20, 300, angle=1.5708), glyph("p", 20, 310, angle=1.5708)])],
    [page(0, [glyph("ﬁ", 72, 100), glyph("t", 77, 100), glyph("\x00", 82, 100)])],
    [page(0, [])],
]


@query("doc_id long, ord int, text string, n_words int, size double, n_rotated int", [
    (1, 0, "hello", 1, 10.0, 0), (2, 0, "ab cdef", 2, 10.0, 0), (3, 0, "x2+y", 1, 10.0, 0), (4, 0, "two", 1, 8.0, 0), (4, 1, "one", 1, 10.0, 0), (5, 0, "Conformal antennas", 2, 10.0, 0), (5, 1, "are set here", 3, 10.0, 0), (6, 0, "flat", 1, 10.0, 2), (7, 0, "fit", 1, 10.0, 0),
])
def lines_of_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by gaps, scripts, neighbouring columns, an initial, rotated glyphs, ligatures."""
    pages = paper.read_pages(documents(spark, _LINES))
    lines = pages.select("doc_id", "n_rotated", F.posexplode("lines").alias("ord", "l"))
    return lines.select("doc_id", "ord", "l.text", F.size("l.words").alias("n_words"), F.col("l.size").cast("double").alias("size"), "n_rotated")


# ---- columns


def _prose(x: float, y: float, n: int, chars: int = 43, size: float = 10.0) -> list[dict]:
    """Lines of words of five letters."""
    return [g for k in range(n) for g in run("".join("lorem ipsum dolor amets elitr "[(7 * k + i) % 30] for i in range(chars)), x, y + 12 * k, size)]


def _two_columns(number: int) -> dict:
    return page(number, _prose(72, 100, 25) + _prose(320, 100, 25))


def _wide(y: float, n: int) -> list[dict]:
    """Lines across the page."""
    return _prose(72, y, n, 90)


_COLUMNS = [
    [_two_columns(0), _two_columns(1), _two_columns(2), page(3, _wide(100, 35) + _prose(72, 560, 6) + _prose(320, 560, 6))],
    [page(0, _prose(72, 100, 30, 90))],
    [page(0, run("left", 72, 100) + run("right", 320, 100))],
]


@query("doc_id long, page int, n_lines int, n_bands int, n_gutters int", [(1, 0, 50, 1, 1), (1, 1, 50, 1, 1), (1, 2, 50, 1, 1), (1, 3, 47, 2, 1), (2, 0, 30, 1, 0), (3, 0, 1, 1, 0)])
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in two columns, and one that is so at its foot only, which the document's spine tells."""
    split = paper.split_pages(*_read(spark, _COLUMNS))
    return split.select("doc_id", "page", F.size("lines").alias("n_lines"), F.size("bands").alias("n_bands"), F.aggregate("bands", F.lit(0), lambda n, b: n + F.size(b["gutters"])).alias("n_gutters"))


def _read(spark: SparkSession, cases: list[list[dict]]) -> tuple[DataFrame, DataFrame]:
    read = paper.read_pages(documents(spark, cases))
    return read, K.spine(read.select("doc_id", "page", F.explode("gutters").alias("g")).select("doc_id", "page", "g.g0", "g.g1"))


def _items(spark: SparkSession, cases: list[list[dict]]) -> DataFrame:
    split = paper.split_pages(*_read(spark, cases))
    none = spark.createDataFrame([], "doc_id long, page int, gone array<int>")
    return paper.lift_pages(split, none, T.measure(paper.light_lines(split)))


# ---- tables


def _cells(y: float, *cells: tuple[float, str]) -> list[dict]:
    return [g for x, t in cells for g in run(t, x, y)]


def _grid(x: float, y: float) -> list[dict]:
    return _cells(y + 12, (x, "Model"), (x + 110, "Score"), (x + 220, "Time")) + _cells(y + 40, (x, "base"), (x + 110, "0.5"), (x + 220, "12")) + _cells(y + 60, (x, "large"), (x + 110, "0.9"), (x + 220, "30"))


_TABLES = [
    [page(0, _grid(80, 100), [rule(72, 100, 400), rule(72, 120, 400), rule(72, 170, 400)])],
    [page(0, _cells(112, (80, "a"), (130, "b"), (320, "c"), (370, "d")) + _cells(126, (80, "1"), (130, "2"), (320, "3"), (370, "4")), [rule(72, 100, 220), rule(72, 130, 220), rule(310, 100, 460), rule(310, 130, 460)])],
    [page(0, _grid(80, 100), [rule(72, 100, 400), rule(72, 500, 400)])],
    [page(0, run("centred", 200, 112) + run("lines", 200, 126), [rule(72, 100, 400), rule(72, 130, 400)])],
]


@query("doc_id long, page int, cells string, header_rows int", [(1, 0, "Model|Score|Time;base|0.5|12;large|0.9|30", 1)])
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a head between rules; rules too far apart and lines of one cell are none."""
    found = _items(spark, [_TABLES[0], _TABLES[2], _TABLES[3]]).filter("kind = 'table'")
    return found.select("doc_id", "page", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"), "header_rows")


# ---- mathematics


def _centred(text: str, y: float, size: float = 10.0, font: str = "CMMI10") -> list[dict]:
    return run(text, 306 - 0.25 * size * len(text), y, size, font)


_AROUND = _wide(60, 3) + _wide(500, 3)
_EQUATIONS = [
    [page(0, _AROUND + _centred("α+β=γ", 200))],
    [page(0, _AROUND + run("this is a full line of prose with an α within it and so on to the end of the line", 72, 200))],
    [page(0, _AROUND + _centred("Ada Author and Bob Writer", 200, font="CMR10"))],
    [page(0, _AROUND + _centred("α=β", 200) + run("(3)", 507, 200))],
    [page(0, _AROUND + run("α = β + γ", 100, 200, font="CMMI10") + run("(2a)", 502, 200))],
    [page(0, _AROUND + _centred("α=β", 200) + run("γ=δ", 298.5, 214, font="CMMI10"))],
    [page(0, _AROUND + [glyph("∑", 276, 204, 10.0, "CMEX10", height=14.0, width=14.0)] + run("α+β+γ", 291, 200, font="CMMI10") + run("i=1", 278, 211, 7, "CMMI7") + run("n", 281, 188, 7, "CMMI7"))],
    [page(0, _AROUND + _centred("f(α)=β(3)", 200))],
]


@query("doc_id long, latex string, number string", [(1, r"\alpha+\beta=\gamma", ""), (4, r"\alpha=\beta", "3"), (5, r"\alpha = \beta + \gamma", "2a"), (6, r"\alpha=\beta", ""), (6, r"\gamma=\delta", ""), (7, r"\sum_{i=1}^n\alpha+\beta+\gamma", ""), (8, r"f(\alpha)=\beta(3)", "")])
def display_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred and numbered lines of mathematics, their numbers, and what is set above and below them."""
    found = _items(spark, _EQUATIONS).filter("kind = 'equation'")
    return found.select("doc_id", "latex", F.coalesce("number", F.lit("")).alias("number"))


_INLINE = [
    [page(0, run("where", 72, 100) + run("α", 102, 100, font="CMMI10") + run("=", 112, 100) + run("2", 122, 100) + run("holds for all of them", 137, 100))],
    [page(0, run("no formula in here", 72, 100))],
    [page(0, run("a lone", 72, 100) + run("x", 107, 100, font="CMMI10") + run("stays", 117, 100))],
]


@query("doc_id long, text string", [(1, r"where $\alpha = 2$ holds for all of them"), (2, "no formula in here"), (3, "a lone x stays")])
def inline_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of mathematics within prose, as one word each."""
    return _items(spark, _INLINE).filter("kind = 'line'").select("doc_id", "text")


# ---- a whole paper


def _paper() -> list[dict]:
    """Four pages in two columns: a title, headings, a table, a numbered equation, a figure with caption, citations and references."""
    head = run("A Journal of Things 12", 72, 40, 8)
    one = head + run("A Study of the Nature of Things", 176, 80, 16) + run("1 Introduction", 72, 120, 12) + _prose(72, 140, 22) + run("as was shown before [1].", 72, 404)
    one += run("2 Results", 320, 120, 12) + _prose(320, 140, 8) + run("Table 1: All of the numbers.", 320, 262) + _cells(292, (325, "Model"), (400, "Score"), (480, "Time")) + _cells(312, (325, "base"), (400, "0.5"), (480, "12")) + _cells(326, (325, "large"), (400, "0.9"), (480, "30"))
    one += _prose(320, 352, 4) + run("α+β=γ", 400, 424, font="CMMI10") + run("(1)", 520, 424) + _prose(320, 448, 8)
    rules = [rule(320, 280, 536), rule(320, 298, 536), rule(320, 332, 536)]
    two = head + run("3 Discussion", 72, 100, 12) + _prose(72, 120, 22) + run("Figure 1: What it looks like.", 320, 262) + _prose(320, 290, 8) + run("References", 320, 410, 12)
    two += run("[1] A. Author, B. Writer. A first work on", 320, 430) + run("things. 2001.", 320, 442) + run("[2] C. Third, D. Fourth. Another work of", 320, 454) + run("note. 2002.", 320, 466)
    three = head + run("A Proofs", 72, 100, 12) + _prose(72, 120, 22) + _prose(320, 120, 22)
    image = {"bbox": {"x0": 330, "y0": 80, "x1": 530, "y1": 240}, "object_index": 0, "px_width": 100, "px_height": 80}
    return [page(0, one, rules), page(1, two, images=[image]), page(2, three), page(3, head + _prose(72, 120, 22) + _prose(320, 120, 22))]


def _said(n: int) -> str:
    """What ``_prose`` says, as a paragraph."""
    return " ".join("".join("lorem ipsum dolor amets elitr "[(7 * k + i) % 30] for i in range(43)).strip() for k in range(n))


_MARKDOWN = [
    "# A Study of the Nature of Things", "## 1 Introduction", _said(22) + " as was shown before [[1](#ref-1)].", "## 2 Results", _said(8), "*Table 1: All of the numbers.*", "| Model | Score | Time |\n| --- | --- | --- |\n| base | 0.5 | 12 |\n| large | 0.9 | 30 |", _said(4),
    "$$\n\\alpha+\\beta=\\gamma \\tag{1}\n$$", _said(8), "## 3 Discussion", _said(22), "*Figure 1: What it looks like.*", _said(8), "## References", '<a id="ref-1"></a>[1] A. Author, B. Writer. A first work on things. 2001.', '<a id="ref-2"></a>[2] C. Third, D. Fourth. Another work of note. 2002.',
    "## A Proofs", *[_said(22)] * 4,
]


@query("doc_id long, rendered string", [(1, "\n\n".join(_MARKDOWN) + "\n")])
def paper_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper of glyphs, rules and an image all the way to Markdown."""
    return convert(blocks_of_primitives(documents(spark, [_paper()])), "md")


# ---- figures, furniture, outlines


def _picture(x0: float, y0: float, x1: float, y1: float) -> dict:
    return {"bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "object_index": 0, "px_width": 10, "px_height": 10}


_FIGURES = [
    [page(0, [], images=[_picture(100, 100, 300, 250)])],
    [page(0, [], paths=[{"bbox": {"x0": 100 + 30 * k, "y0": 100 + 20 * (k % 3), "x1": 112 + 30 * k, "y1": 112 + 20 * (k % 3)}} for k in range(9)])],
    [page(0, [], paths=[{"bbox": {"x0": 100 + 30 * k, "y0": 100, "x1": 112 + 30 * k, "y1": 112}} for k in range(4)])],
    [page(0, [], images=[_picture(0, 0, 612, 792)])],
    [page(0, [], images=[_picture(100, 100, 120, 120)])],
    [page(0, [], paths=[rule(72, 100 + 20 * k, 540) for k in range(12)])],
    [page(0, [], images=[_picture(72, 100, 280, 250), _picture(330, 100, 540, 250)])],
    [page(0, [], images=[_picture(-50, 700, 300, 900)])],
]


@query("doc_id long, region int, x0 double, y0 double, x1 double, y1 double", [
    (1, 0, 100.0, 100.0, 300.0, 250.0), (2, 0, 100.0, 100.0, 352.0, 152.0), (7, 0, 72.0, 100.0, 280.0, 250.0), (7, 1, 330.0, 100.0, 540.0, 250.0), (8, 0, 0.0, 700.0, 300.0, 792.0),
])
def figures_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, marks that merge, and what is too few, too large, too small, or a rule; boxes end at their page."""
    regions = paper.read_pages(documents(spark, _FIGURES)).select("doc_id", F.posexplode("regions").alias("region", "r"))
    return regions.select("doc_id", "region", *(F.col(f"r.{k}").cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")))


_FURNITURE = [
    [page(k, run("Running head", 72, 40) + run(f"body of page {'abcdefgh'[k]}", 72, 300) + run(str(k + 1), 300, 760)) for k in range(8)],
    [page(k, run("Running head", 72, 40) + run("body", 72, 300)) for k in range(3)],
    [page(k, run("Left side" if k % 2 else "Right side", 72, 40) + run(f"text {'abcdefghij'[k]}", 72, 300)) for k in range(10)],
]


@query("doc_id long, n_lines long, n_furniture long", [(1, 24, 16), (2, 6, 0), (3, 20, 10)])
def furniture_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and folios of eight pages, of three, and heads that alternate."""
    split = paper.split_pages(*_read(spark, _FURNITURE))
    marked = N.mark_furniture(paper.light_lines(split), split.select("doc_id", "page"))
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("furniture").cast("long")).alias("n_furniture"))


def _file(content: str, more: str = "") -> bytes:
    """A PDF file of one page."""
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> {more} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{k} 0 obj\n{p}\nendobj\n" for k, p in enumerate(parts, 1)) + "trailer << /Root 1 0 R >>\n").encode()


_FILES = [
    _file("BT /F1 10 Tf 72 700 Td (Plain) Tj ET 72 600 300 0.5 re f 10 10 m 10 400 l S 100 100 50 40 re f"), _file("BT /F1 12 Tf 72 700 Td (Turned) Tj ET", "/Rotate 90"), b"no file of this kind",
    _file("q 200 0 0 100 50 60 cm BI /W 1 /H 1 ID x EI Q"),
]


@query("doc_id long, width double, height double, words string, kinds string, n_images int, error string", [(1, 612.0, 792.0, "Plain", "hrule,vrule,box", 0, ""), (2, 792.0, 612.0, "Turned", "", 0, ""), (3, 0.0, 0.0, "", "", 0, "no PDF file"), (4, 612.0, 792.0, "", "", 1, "")])
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one page: text, rules and boxes, a turned page, an image, and bytes that are no file."""
    files = spark.createDataFrame([(k, f"{k}.pdf", bytearray(x)) for k, x in enumerate(_FILES, 1)], "doc_id long, path string, content binary")
    p = F.try_element_at("pages", F.lit(1))
    return parse_pdfs(files).select("doc_id", F.coalesce(p["width"].cast("double"), F.lit(0.0)).alias("width"), F.coalesce(p["height"].cast("double"), F.lit(0.0)).alias("height"), F.coalesce(F.array_join(F.transform(p["glyphs"], lambda g: g["text"]), ""), F.lit("")).alias("words"), F.coalesce(F.array_join(F.transform(p["paths"], lambda x: x["kind"]), ","), F.lit("")).alias("kinds"), F.coalesce(F.size(p["images"]), F.lit(0)).alias("n_images"), F.coalesce("error", F.lit("")).alias("error"))


@query("doc_id long, title string, sections string", [
    (1, "A study", '[{"level":0,"start":0,"end":2,"first_page":0,"last_page":0,"children":[]},{"title":"1 Introduction","level":1,"start":2,"end":10,"first_page":0,"last_page":1,"children":[{"title":"1.1 Detail","level":2,"start":5,"end":10,"first_page":1,"last_page":1,"children":[]}]},{"title":"2 End","level":1,"start":10,"end":14,"first_page":2,"last_page":2,"children":[]}]'),
    (2, None, '[{"level":0,"start":0,"end":1,"first_page":0,"last_page":0,"children":[]}]'),
])
def nested_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of blocks within their JSON: front matter, sections and what is below them."""
    blocks = fixtures.table(spark, "blocks").withColumn("doc_id", F.col("doc_id").cast("long"))
    return E.to_json(blocks, S.sections(blocks)).select("doc_id", "title", F.regexp_extract("document", r'"sections":(.*)\}$', 1).alias("sections"))
