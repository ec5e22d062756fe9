"""The bibliography of a document as one block per entry, and citations linked to it."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.functions import refs as R
from quirework.functions.text import is_bibliography_heading

_NAMES = "(?i:references|bibliography|works cited|literature cited)"
OPENS = rf"(?s)^({_NAMES}\s*)(?=[\p{{Lu}}\[])"
CLOSES = rf"(?s)^(.*[.!?:])\s+{_NAMES}[.:]?\s*$"


def _starts(blocks: DataFrame) -> DataFrame:
    """``doc_id, at, how``: the first block that is the heading, begins with it or, unless it is the last, ends with it."""
    t, kind = F.col("text"), F.col("type")
    last = F.max("ord").over(Window.partitionBy("doc_id"))
    paragraph = kind == "paragraph"
    listed = t.rlike(r"[0-9]\s*$")
    how = F.when((kind == "heading") & is_bibliography_heading(t) & ~listed, "heading").when(paragraph & is_bibliography_heading(t), "heading").when(paragraph & t.rlike(OPENS), "opens").when(paragraph & t.rlike(CLOSES) & (F.col("ord") < F.col("_last")), "closes")
    found = blocks.withColumn("_last", last).withColumn("how", how).filter("how IS NOT NULL")
    return found.groupBy("doc_id").agg(F.min("ord").alias("at"), F.min_by("how", "ord").alias("how"))


def _entries(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The entries of the paragraphs of a bibliography, each with the page and size of the paragraph that it begins in."""
    text, origins = "", []
    for r in rows:
        text += " " if text else ""
        origins.append((len(text), r))
        text += r["text"]
    entries = R.entries_of(text)
    if len(entries) < 2:
        return [r | {"text": s} for _, r in origins if (s := r["text"].strip())]
    out, at = [], 0
    for e in entries:
        at = max(at, text.find(e, at))
        out.append([r for begin, r in origins if begin <= at][-1] | {"text": e})
        at += len(e)
    return out


def extract_bibliography(blocks: DataFrame) -> DataFrame:
    """The blocks (``doc_id, ord, type, level, ordered, text, page, size``, and others) with references, and their ``label``.

    From the heading to the next one, paragraphs are joined and split into entries, which come before what
    else is there.  Citations of known labels become links in paragraphs, list items and captions.
    """
    columns = [c for c in blocks.columns if c != "label"]
    own = blocks.select(*columns)
    marked = own.join(_starts(own), "doc_id", "left").withColumn("first", F.when(F.col("how") == "opens", F.col("at")).otherwise(F.col("at") + 1))
    w = Window.partitionBy("doc_id")
    end = F.coalesce(F.min(F.when((F.col("type") == "heading") & (F.col("ord") > F.col("first")), F.col("ord"))).over(w), F.max("ord").over(w) + 1)
    ranged = marked.withColumn("end", end).withColumn("inside", F.coalesce((F.col("ord") >= F.col("first")) & (F.col("ord") < F.col("end")), F.lit(False)))
    here = F.col("ord") == F.col("at")
    bare = F.when(here & (F.col("how") == "opens"), F.regexp_replace("text", OPENS, "")).when(here & (F.col("how") == "closes"), F.regexp_extract("text", CLOSES, 1)).otherwise(F.col("text"))
    cut = ranged.withColumn("text", bare)

    def split(table: pa.Table) -> pa.Table:
        rows = table.sort_by("ord").to_pylist()
        out = [r | {"type": "reference", "sub": k, "ord": rows[0]["ord"]} for k, r in enumerate(_entries(rows))]
        return pa.Table.from_pylist(out, schema=kinds)

    body = cut.filter(F.col("inside") & (F.col("type") == "paragraph")).select(*columns)
    whole = body.withColumn("sub", F.lit(0)).schema
    kinds = to_arrow_schema(whole)
    entries = body.groupBy("doc_id").applyInArrow(split, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.fields)).withColumn("rank", F.lit(0))
    rest = cut.filter(~(F.col("inside") & (F.col("type") == "paragraph"))).select(*columns, F.lit(0).alias("sub"), F.when(F.col("inside"), 1).otherwise(0).alias("rank"), F.when(F.col("inside"), F.col("first")).otherwise(F.col("ord")).alias("_place"))
    both = rest.unionByName(entries.withColumn("_place", F.col("ord")), allowMissingColumns=True)
    parsed = both.withColumn("label", F.when(F.col("type") == "reference", R.label(F.col("text"))))
    order = Window.partitionBy("doc_id").orderBy("_place", "rank", "ord", "sub")
    labels = F.collect_set("label").over(Window.partitionBy("doc_id"))
    linked: Column = F.when(F.col("type").isin("paragraph", "list_item", "caption"), R.link_citations(F.col("text"), labels)).otherwise(F.col("text"))
    return parsed.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), *(linked.alias("text") if c == "text" else c for c in columns if c not in ("doc_id", "ord")), "label")
