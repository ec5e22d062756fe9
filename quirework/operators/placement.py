"""Figures among blocks: captions, places in the reading order, and the labels inside them."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.functions.text import count_words

FARTHEST, MARGIN, MOST_WORDS, SHARE = 90.0, 18.0, 12, 0.8


def drop_labels(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks without short ones that lie in a figure: an anti join by page."""
    r = regions.select("doc_id", "page", *((F.col(k) + s).alias(f"_{k}") for k, s in (("x0", -MARGIN), ("y0", -MARGIN), ("x1", MARGIN), ("y1", MARGIN))))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    shared = F.greatest(F.least("x1", "_x1") - F.greatest("x0", "_x0"), F.lit(0.0)) * F.greatest(F.least("y1", "_y1") - F.greatest("y0", "_y0"), F.lit(0.0))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-7))
    may = ~F.col("type").isin("caption", "figure", "table", "equation") & (count_words(F.col("text")) <= MOST_WORDS)
    inside = may & ((cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))) | (shared / area >= SHARE))
    gone = blocks.join(r, ["doc_id", "page"]).filter(inside).select("doc_id", "ord").distinct()
    return blocks.join(gone, ["doc_id", "ord"], "left_anti")


def _attach(blocks: list[dict[str, Any]], regions: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Each region takes the nearest caption of its page that is free; else it goes below what is above it."""
    for r in sorted(regions, key=lambda r: (r["page"], r["region"])):
        beside = [(b["y0"] - r["y1"] if b["y0"] >= r["y1"] else r["y0"] - b["y1"], k) for k, b in enumerate(blocks) if b["page"] == r["page"] and b["type"] == "caption" and min(b["x1"], r["x1"]) > max(b["x0"], r["x0"])]
        near = min((g for g in beside if g[0] <= FARTHEST), default=None)
        if near:
            blocks[near[1]]["type"] = "figure"
            continue
        above = [k for k, b in enumerate(blocks) if b["page"] == r["page"] and b["y1"] <= r["y0"] and min(b["x1"], r["x1"]) > max(b["x0"], r["x0"])]
        at = above[-1] + 1 if above else next((k for k, b in enumerate(blocks) if b["page"] >= r["page"]), len(blocks))
        blocks.insert(at, {"type": "figure", "text": "", **{k: r[k] for k in ("page", "x0", "y0", "x1", "y1")}})
    return blocks


def attach_figures(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks (of ``assemble``) with figures (of ``figures``): captions become figures, others are put in, labels go."""
    names, kinds = blocks.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = _attach(left.sort_by("ord").to_pylist(), right.to_pylist())
        return pa.Table.from_pylist([b | {"doc_id": key[0].as_py(), "ord": k} for k, b in enumerate(out)], schema=kept)

    kept = to_arrow_schema(blocks.schema)
    bare = drop_labels(blocks, regions).select(*names)
    placed = bare.groupBy("doc_id").cogroup(regions.groupBy("doc_id")).applyInArrow(run, kinds)
    return placed.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)
