"""Blocks as Markdown, Typst, plain text and JSON: an ordered aggregation of one expression per block."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions import text as X

#: Columns that blocks may lack, with their types.
OPTIONAL = {"level": "int", "ordered": "boolean", "asset": "string", "latex": "string", "number": "string", "label": "string", "rows": "array<array<string>>", "header_rows": "int"}


def _filled(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in blocks.columns}).withColumn("text", F.coalesce("text", F.lit("")))


def _marks(sign: str) -> Column:
    return F.repeat(F.lit(sign), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(5)) + 1)


def _width() -> Column:
    return F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))


def _padded(row: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(_width() - F.size(row), F.lit(0))))


def _cell(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("|"), F.lit("\\|")))


def _gfm_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _gfm_table() -> Column:
    heads = F.coalesce("header_rows", F.lit(0))
    top = F.slice("rows", F.lit(1), F.least(heads, F.size("rows")))
    rest = F.slice("rows", heads + 1, F.greatest(F.size("rows") - heads, F.lit(0)))
    names = F.transform(F.sequence(F.lit(1), F.greatest(_width(), F.lit(1))), lambda i: F.array_join(F.filter(F.transform(top, lambda r: _cell(F.coalesce(F.try_element_at(r, i), F.lit("")))), lambda c: c != ""), " "))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), _width()))
    body = F.transform(rest, lambda r: _gfm_row(F.transform(_padded(r), _cell)))
    return F.when(F.col("rows").isNull(), "*[table]*").when(_width() == 0, "").otherwise(F.array_join(F.concat(F.array(_gfm_row(names), rule), body), "\n"))


def markdown_block() -> Column:
    t, kind = F.col("text"), F.col("type")
    safe = X.escape_markdown(t)
    starred = F.concat(F.lit("*"), safe, F.lit("*"))
    picture = lambda alt: F.concat(F.lit("!["), alt, F.lit("]("), F.col("asset"), F.lit(")"))
    tag = F.when(F.col("number").isNotNull(), F.concat(F.lit(" \\tag{"), F.col("number"), F.lit("}"))).otherwise("")
    anchor = F.when(F.col("label").isNotNull(), F.concat(F.lit('<a id="ref-'), F.col("label"), F.lit('"></a>'))).otherwise("")
    return (
        F.when(kind == "title", F.concat(F.lit("# "), safe))
        .when(kind == "heading", F.concat(_marks("#"), F.lit(" "), safe))
        .when(kind == "caption", starred)
        .when(kind == "figure", F.when(F.col("asset").isNotNull(), picture(F.trim(F.regexp_replace(t, r"[\[\]]", "")))).when(t == "", "*[figure]*").otherwise(starred))
        .when(kind == "list_item", F.concat(F.when(F.col("ordered"), "1. ").otherwise("- "), X.strip_marker(t)))
        .when(kind == "footnote", F.concat(F.lit("> "), safe))
        .when(kind == "equation", F.when(F.col("asset").isNotNull(), picture(F.lit("equation"))).when(F.col("latex").isNotNull(), F.concat(F.lit("$$\n"), F.col("latex"), tag, F.lit("\n$$"))).otherwise(safe))
        .when(kind == "reference", F.concat(anchor, safe))
        .when(kind == "table", _gfm_table())
        .otherwise(safe)
    )


def _typst_table() -> Column:
    def row(r: Column, i: Column) -> Column:
        cell = lambda c: F.concat(F.when(i < F.coalesce("header_rows", F.lit(0)), "table.cell(fill: luma(240))[").otherwise("["), X.escape_typst(c), F.lit("], "))
        return F.concat(F.lit("  "), F.array_join(F.transform(_padded(r), cell), ""), F.lit("\n"))

    whole = F.concat(F.lit("#table(\n  columns: "), _width().cast("string"), F.lit(",\n"), F.array_join(F.transform("rows", row), ""), F.lit(")"))
    return F.when(F.col("rows").isNull(), "#emph[table]").when(_width() == 0, "").otherwise(whole)


def typst_block() -> Column:
    t, kind = X.escape_typst(F.col("text")), F.col("type")
    emph = F.concat(F.lit("#emph["), t, F.lit("]"))
    number = F.when(F.col("number").isNotNull(), F.concat(F.lit(" <eq-"), F.col("number"), F.lit(">"))).otherwise("")
    anchor = F.when(F.col("label").isNotNull(), F.concat(F.lit('#label("ref-'), F.col("label"), F.lit('")'))).otherwise("")
    return (
        F.when(kind == "title", F.concat(F.lit("= "), t))
        .when(kind == "heading", F.concat(_marks("="), F.lit(" "), t))
        .when(kind == "caption", emph)
        .when(kind == "figure", F.when(F.col("asset").isNotNull(), F.concat(F.lit('#figure(\n  image("'), F.col("asset"), F.lit('"),\n  caption: ['), t, F.lit("],\n)"))).otherwise(emph))
        .when(kind == "list_item", F.concat(F.when(F.col("ordered"), "+ ").otherwise("- "), X.escape_typst(X.strip_marker(F.col("text")))))
        .when(kind == "footnote", F.concat(F.lit("#footnote["), t, F.lit("]")))
        .when(kind == "equation", F.when(F.col("asset").isNotNull(), F.concat(F.lit('#figure(image("'), F.col("asset"), F.lit('"))'))).when(F.col("latex").isNotNull(), F.concat(F.lit("#mitex(`"), F.col("latex"), F.lit("`)"), number)).otherwise(t))
        .when(kind == "reference", F.concat(anchor, t))
        .when(kind == "table", _typst_table())
        .otherwise(t)
    )


def text_block() -> Column:
    t, kind = F.col("text"), F.col("type")
    return F.when(kind == "table", F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.array_join(r, "\t")), "\n")).when(kind == "equation", F.coalesce("latex", t)).when(kind == "list_item", F.concat(F.lit("  "), t)).otherwise(t)


def _render(blocks: DataFrame, shown: Column, head: Column | None = None) -> DataFrame:
    each = _filled(blocks).select("doc_id", F.struct("ord", shown.alias("s")).alias("_s"), (head if head is not None else F.lit(False)).alias("_head"))
    body = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["s"]), "\n\n"), r"\n+$", "")
    text = F.concat(body, F.lit("\n"))
    if head is not None:
        text = F.concat(F.when(F.bool_or("_head"), '#import "@preview/mitex:0.2.4": mi, mitex\n\n').otherwise(""), text)
    return each.groupBy("doc_id").agg(text.alias("rendered"))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """``doc_id, rendered``."""
    return _render(blocks, markdown_block())


def to_typst(blocks: DataFrame) -> DataFrame:
    """``doc_id, rendered``; documents with mathematics import what sets it."""
    return _render(blocks, typst_block(), F.col("latex").isNotNull() | F.col("text").contains("$"))


def to_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, rendered``."""
    return _render(blocks, text_block())


@F.pandas_udf(T.StringType())
def outline(sections: pd.Series) -> pd.Series:
    """Sections (``start, end, level, title, parent, first_page, last_page``) as JSON, each with its ``children``."""

    def nested(rows: list[dict] | None) -> str:
        top: list[dict] = []
        held: dict[int, list[dict]] = {}
        for r in sorted(rows if rows is not None else [], key=lambda r: (r["start"], r["level"])):
            node = {k: r[k] for k in ("title", "level", "start", "end", "first_page", "last_page") if k != "title" or r[k] is not None} | {"children": []}
            held.get(r["parent"], top).append(node) if r["parent"] is not None else top.append(node)
            if r["level"]:
                held[r["start"]] = node["children"]
        return json.dumps(top, ensure_ascii=False, separators=(",", ":"))

    return sections.map(nested)


def to_json(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, title, document``: title, blocks and the nested outline as JSON without null fields."""
    fields = [c for c in blocks.columns if c != "doc_id"]
    b = blocks.groupBy("doc_id").agg(F.min_by(F.when(F.col("type") == "title", F.col("text")), F.when(F.col("type") == "title", F.col("ord"))).alias("title"), F.array_sort(F.collect_list(F.struct("ord", *(f for f in fields if f != "ord")))).alias("blocks"))
    s = sections.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "level", "title", "parent", "first_page", "last_page")).alias("sections"))
    flat = F.to_json(F.struct("title", "blocks"))
    whole = F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.lit(',"sections":'), F.coalesce(outline("sections"), F.lit("[]")), F.lit("}"))
    return b.join(s, "doc_id", "left").select("doc_id", "title", whole.alias("document"))
