"""Pages of primitives as rows: lines, columns, tables and equations, a page at a time and without a shuffle.

A page is one row with arrays of what is on it, so that the greedy passes over a page are maps over Arrow batches.
What needs the whole document (the spine of its columns, furniture, typography) is an aggregate of light rows that is
joined back by document or page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirework.functions import geometry as G
from quirework.functions import maths as M
from quirework.functions import text as X
from quirework.operators import equations as Q
from quirework.operators import page as P
from quirework.operators.columns import SPINE, profile_gutters

Row = dict[str, Any]
GLYPH = "struct<text: string, x0: float, y0: float, x1: float, y1: float, ox: float, oy: float, size: float, flags: int, seed: boolean, script: string, brk: boolean>"
WORD = "struct<text: string, x0: float, y0: float, x1: float, y1: float, start: int, end: int>"
LINE = f"struct<text: string, baseline: float, size: float, x0: float, y0: float, x1: float, y1: float, bold: boolean, italic: boolean, words: array<{WORD}>, glyphs: array<{GLYPH}>>"
GUTTER = "struct<g0: float, g1: float>"
_HEAD = f"doc_id long, page int, width float, height float, rules array<{G.RECT}>, regions array<{G.RECT}>"
READ = f"{_HEAD}, lines array<{LINE}>, gutters array<{GUTTER}>, n_rotated int"
SPLIT = f"{_HEAD}, lines array<{LINE}>, bands array<struct<y0: float, y1: float, gutters: array<{GUTTER}>>>"
ITEMS = "doc_id long, page int, kind string, ord int, at int, text string, baseline float, size float, x0 float, y0 float, x1 float, y1 float, bold boolean, page_height float, rows array<array<string>>, header_rows int, latex string, number string, confidence double"
#: Halvings of a page in search of its columns.
HALVINGS = 2


def _mapped(df: DataFrame, run: Callable[[Row], list[Row]], schema: str) -> DataFrame:
    """Rows of a page each, to rows."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = run(batch.slice(k, 1).to_pylist()[0])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.mapInArrow(each, schema)


def _glyphs() -> Column:
    """Visible glyphs of a page, with ligatures spelt out, sizes mended, and what is mathematics marked."""

    def mended(g: Column) -> Column:
        b, text = g["bbox"], X.expand_ligatures(g["text"])
        seed = M.is_font(F.coalesce(g["font"], F.lit(""))) | ((F.length(text) == 1) & M.is_symbol(text))
        size = G.glyph_size(g["size"], b, g["angle"])
        return F.struct(text.alias("text"), *(b[k].alias(k) for k in ("x0", "y0", "x1", "y1")), g["ox"].alias("ox"), g["oy"].alias("oy"), size.alias("size"), F.coalesce(g["flags"], F.lit(0)).alias("flags"), seed.alias("seed"), G.is_horizontal(g["angle"]).alias("upright"), F.coalesce(g["generated"], F.lit(False)).alias("generated"))

    some = F.filter("p.glyphs", lambda g: g["text"].isNotNull() & (g["text"] != "") & ~g["text"].rlike(r"^\p{Cntrl}+$"))
    return F.coalesce(F.transform(some, mended), F.array())


def read_pages(documents: DataFrame) -> DataFrame:
    """A row for each page of documents of primitives: ``READ``.

    Lines are those of upright glyphs; gutters are what their profile shows; regions are the page's figures.
    """
    p = documents.select("doc_id", F.explode("pages").alias("p"))
    clip = lambda b: G.clip(b, F.col("p.width"), F.col("p.height"))
    found = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    kind = lambda x: F.coalesce(x["kind"], G.path_kind(x["bbox"]))
    paths, images = F.coalesce("p.paths", F.array()), F.coalesce("p.images", F.array())
    rules = found(F.transform(F.filter(paths, lambda x: kind(x) == "hrule"), lambda x: clip(x["bbox"])))
    marks = found(F.transform(F.filter(paths, lambda x: ~kind(x).isin("hrule", "vrule")), lambda x: clip(x["bbox"])))
    pictures = found(F.transform(images, lambda x: clip(x["bbox"])))
    rows = p.select("doc_id", "p.page", F.col("p.width").cast("float").alias("width"), F.col("p.height").cast("float").alias("height"), rules.alias("rules"), marks.alias("marks"), pictures.alias("pictures"), _glyphs().alias("glyphs"))

    def run(r: Row) -> list[Row]:
        lines = [_line(x) for x in P.page_lines([_placed(g) for g in r["glyphs"] if g["upright"]])]
        boxes = [_box(b) for b in r["pictures"] + r["marks"]]
        regions = [dict(zip(_SIDES, b, strict=True)) for b, _, _ in P.figure_boxes(boxes, [k < len(r["pictures"]) for k in range(len(boxes))], r["width"] or 0.0, r["height"] or 0.0)]
        return [{k: r[k] for k in ("doc_id", "page", "width", "height", "rules")} | {"regions": regions, "lines": lines, "gutters": _gutters(lines, r["width"]), "n_rotated": sum(not g["upright"] and not g["generated"] for g in r["glyphs"])}]

    return _mapped(rows, run, READ)


_SIDES = ("x0", "y0", "x1", "y1")


def _box(r: Row) -> Q.Box:
    return r["x0"], r["y0"], r["x1"], r["y1"]


def _placed(g: Row) -> Row:
    return {"text": g["text"], "box": _box(g), "ox": g["ox"], "oy": g["oy"], "size": g["size"], "flags": g["flags"], "break": g.get("brk") or False, "script": g.get("script"), "seed": g["seed"]}


def _line(x: P._Line) -> Row:
    words = x.words()
    glyphs = [{"text": g["text"], **dict(zip(_SIDES, g["box"], strict=True)), "ox": g["ox"], "oy": g["oy"], "size": g["size"], "flags": g["flags"], "seed": g["seed"], "script": g["script"], "brk": g["break"]} for g in x.glyphs]
    return {"text": " ".join(w["text"] for w in words), "baseline": x.baseline, "size": x.size, **dict(zip(_SIDES, x.box, strict=True)), "bold": x.bold, "italic": x.italic, "words": words, "glyphs": glyphs}


def _gutters(lines: list[Row], width: float | None) -> list[Row]:
    boxes = np.array([(g["x0"], g["x1"]) for x in lines for g in x["glyphs"]], np.float32).reshape(-1, 2)
    return [{"g0": a, "g1": b} for a, b in profile_gutters(boxes[:, 0], boxes[:, 1], width or 0.0)]


# ---- bands and columns


def page_bands(lines: list[Row], gutters: list[Row], spine: Row | None, width: float) -> list[Row]:
    """Slices of a page, each with its gutters.

    A page without gutters, of a document whose pages agree on one, is halved at its widest white stripe until a half
    shows a gutter at that place.
    """
    whole = [{"y0": float("-inf"), "y1": float("inf"), "gutters": gutters}]
    if gutters or spine is None or not lines:
        return whole
    middle = (spine["g0"] + spine["g1"]) / 2

    def search(part: list[Row], depth: int) -> list[Row]:
        found = [g for g in _gutters(part, width) if abs((g["g0"] + g["g1"]) / 2 - middle) <= SPINE]
        lower = np.maximum.accumulate([x["y1"] for x in part])
        white = np.array([x["y0"] for x in part[1:]]) - lower[:-1]
        if found or depth >= HALVINGS or not len(white) or not white.max() > 0:
            return [{"y0": min(x["y0"] for x in part), "y1": float(lower[-1]), "gutters": found}]
        cut = int(white.argmax()) + 1
        return search(part[:cut], depth + 1) + search(part[cut:], depth + 1)

    out: list[Row] = []
    for band in search(sorted(lines, key=lambda x: x["y0"]), 0):
        if out and out[-1]["gutters"] == band["gutters"]:
            out[-1]["y1"] = max(out[-1]["y1"], band["y1"])
        else:
            out.append(band)
    for above, below in zip(out, out[1:], strict=False):
        above["y1"] = below["y0"] = (above["y1"] + below["y0"]) / 2
    out[0]["y0"], out[-1]["y1"] = float("-inf"), float("inf")
    return out


def gutters_at(bands: list[Row], y: float) -> list[tuple[float, float]]:
    """The gutters of the band that a height is in."""
    return next(([(g["g0"], g["g1"]) for g in b["gutters"]] for b in bands if b["y0"] <= y < b["y1"]), [])


def split_line(line: Row, gutters: list[tuple[float, float]]) -> list[Row]:
    """A line cut wherever two neighbouring glyphs have a gutter between them."""
    middle = [(g["x0"] + g["x1"]) / 2 for g in line["glyphs"]]
    cuts = [k for k in range(1, len(middle)) if any(middle[k - 1] < a and middle[k] > b for a, b in gutters)]
    if not cuts:
        return [line]
    return [_line(P._Line([_placed(g) for g in line["glyphs"][a:b]])) for a, b in zip([0, *cuts], [*cuts, len(middle)], strict=True)]


def split_pages(pages: DataFrame, spine: DataFrame) -> DataFrame:
    """Pages of ``read_pages`` with their lines cut into columns: ``SPLIT``; spine: ``doc_id, g0, g1``."""
    joined = pages.join(spine.select("doc_id", F.struct("g0", "g1").alias("spine")), "doc_id", "left")

    def run(r: Row) -> list[Row]:
        bands = page_bands(r["lines"], r["gutters"], r["spine"], r["width"] or 0.0)
        lines: list[Row] = []
        for b in bands:
            # bands are in order down the page, so that each one's lines are sorted by themselves
            mine = [x for x in r["lines"] if b["y0"] <= (x["y0"] + x["y1"]) / 2 < b["y1"]]
            cut = [p for x in mine for p in split_line(x, [(g["g0"], g["g1"]) for g in b["gutters"]])]
            lines += sorted(cut, key=lambda x: (x["baseline"], x["x0"]))
        return [{k: r[k] for k in ("doc_id", "page", "width", "height", "rules", "regions")} | {"lines": lines, "bands": bands}]

    return _mapped(joined, run, SPLIT)


def light_lines(pages: DataFrame) -> DataFrame:
    """The lines of pages without what is on them: ``doc_id, page, ord, text, baseline, size, x0, y0, x1, y1, bold, page_height``."""
    lines = pages.select("doc_id", "page", "height", F.posexplode("lines").alias("ord", "l"))
    return lines.select("doc_id", "page", "ord", *(f"l.{c}" for c in ("text", "baseline", "size", *_SIDES, "bold")), F.col("height").alias("page_height"))


# ---- tables and equations


def lift_pages(pages: DataFrame, furniture: DataFrame, body: DataFrame) -> DataFrame:
    """What is on pages of ``split_pages``, in reading order: ``ITEMS`` of kind ``line``, ``table`` and ``equation``.

    furniture: ``doc_id, page, gone`` (places of lines that are left out); body: ``doc_id, body_size``.  ``at`` is the
    place in the stream of all lines, which lifted items share with lines; ``ord`` is the place among the lines that
    are left.  Inline mathematics is one word each.
    """
    joined = pages.join(furniture, ["doc_id", "page"], "left").join(body.select("doc_id", "body_size"), "doc_id", "left")

    def run(r: Row) -> list[Row]:
        gone, size = set(r["gone"] or ()), r["body_size"] or 10.0
        kept = [x for k, x in enumerate(r["lines"]) if k not in gone]
        if not kept:
            return []
        order = P.reading_order(*(np.array([x[c] for x in kept], float) for c in (*_SIDES, "baseline", "size")))
        ordered, rules, out = [kept[k] for k in order], [_box(b) for b in r["rules"]], []
        head = {"doc_id": r["doc_id"], "page": r["page"], "page_height": r["height"]}
        used: set[int] = set()
        for t in P.page_tables(rules, ordered, size, [_box(b) for b in r["regions"]]):
            used |= set(t["lines"])
            out.append(head | {"kind": "table", "at": min(t["lines"]), "rows": t["rows"], "header_rows": t["header_rows"], **dict(zip(_SIDES, t["box"], strict=True))})
        at = [k for k in range(len(ordered)) if k not in used]
        prose = [{"box": _box(ordered[k]), "size": ordered[k]["size"], "words": ordered[k]["words"], "glyphs": [_placed(g) for g in ordered[k]["glyphs"]], "line": ordered[k]} for k in at]
        found, taken = Q.lift(prose, lambda y: gutters_at(r["bands"], y), rules)
        for e in found:
            out.append(head | {"kind": "equation", "at": at[e.lines[0]], "latex": e.latex, "number": e.number, "confidence": e.confidence, **dict(zip(_SIDES, e.box, strict=True))})
        left = [k for k, gone in enumerate(taken) if not gone]
        for n, k in enumerate(left):
            line = prose[k]["line"]
            out.append(head | {"kind": "line", "ord": n, "at": at[k], "text": " ".join(w["text"] for w in prose[k]["words"]), **{c: line[c] for c in ("baseline", "size", *_SIDES, "bold")}})
        return out

    return _mapped(joined, run, ITEMS)


def place_lifted(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks (of ``assemble``) with the tables and equations among ``items`` in their places: ``doc_id, ord`` and so on.

    Both have a place in their page's stream of lines: a lifted item goes before the block that begins there or later.
    """
    from pyspark.sql import Window

    starts = items.filter("kind = 'line'").select("doc_id", "page", F.col("ord").alias("start"), "at")
    own = blocks.join(starts, ["doc_id", "page", "start"], "left").select("*", F.lit(2).alias("rank"), F.col("ord").alias("seq"))
    lifted = items.filter("kind <> 'line'").select("doc_id", "page", F.col("kind").alias("type"), F.lit("").alias("text"), *_SIDES, "rows", "header_rows", "latex", "number", "confidence", "at", F.when(F.col("kind") == "table", 0).otherwise(1).alias("rank"), F.lit(0).alias("seq"))
    both = own.unionByName(lifted, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("page", F.col("at").asc_nulls_last(), "rank", "seq", "y0", "x0")
    return both.withColumn("ord", F.row_number().over(order) - 1).drop("at", "rank", "seq")
