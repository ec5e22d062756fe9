"""Columns of a page: gutters from a profile of how many boxes cover each point, and the spine of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_BOXES, GUTTER, FLANK, MOST_GUTTERS, SPINE = 200, 9, 24, 2, 12.0


def boxes_of_pages(boxes: DataFrame) -> DataFrame:
    """``doc_id, page, width, b`` of boxes ``doc_id, page, x0, x1, page_width``: a page's boxes as one array."""
    return boxes.groupBy("doc_id", "page").agg(F.max("page_width").alias("width"), F.collect_list(F.struct(F.col("x0").cast("float"), F.col("x1").cast("float"))).alias("b"))


def _edges(x0: np.ndarray, x1: np.ndarray, bins: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The points at which boxes begin and end, on pages of so many points."""
    lo = np.clip(np.floor(x0), 0, bins).astype(np.int64)
    return lo, np.maximum(np.clip(np.ceil(x1), 0, bins).astype(np.int64), lo)


def _kinds(pages: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return f"doc_id {kinds['doc_id']}, page {kinds['page']}"


def coverage(boxes: DataFrame) -> DataFrame:
    """``doc_id, page, bin, n``: how many boxes (``x0, x1`` on ``page_width``) cover each point of a page's width."""
    return coverage_of_pages(boxes_of_pages(boxes.filter("page_width > 0")))


def coverage_of_pages(pages: DataFrame, covered: bool = False) -> DataFrame:
    """``coverage`` of pages of ``boxes_of_pages``, by a running sum of where boxes begin and end: a map without a shuffle.

    With ``covered``, of the points that some box covers only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                boxes = batch.column("b")
                at = boxes.offsets.to_numpy()
                x0, x1 = (boxes.values.field(c).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for c in (0, 1))
                bins = np.ceil(batch.column("width").to_numpy(zero_copy_only=False)).astype(np.int64)
                # pages one after another, each with a point more than its width where boxes at its end go
                start = np.concatenate([[0], np.cumsum(bins + 1)])
                of = np.repeat(np.arange(len(bins)), np.diff(at))
                lo, hi = _edges(x0, x1, bins[of])
                n = np.cumsum(np.bincount(start[of] + lo, minlength=start[-1]) - np.bincount(start[of] + hi, minlength=start[-1]))
                page = np.repeat(np.arange(len(bins)), bins + 1)
                bin_ = np.arange(start[-1]) - start[page]
                shown = np.flatnonzero((bin_ < bins[page]) & ((n > 0) | (not covered)))
                which = pa.array(page[shown])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("page").take(which), pa.array(bin_[shown], pa.int32()), pa.array(n[shown], pa.int64())], ["doc_id", "page", "bin", "n"])

    return pages.select("doc_id", "page", "width", "b").mapInArrow(run, f"{_kinds(pages)}, bin int, n long")


def profile_gutters(x0: np.ndarray, x1: np.ndarray, width: float) -> list[tuple[float, float]]:
    """The gutters of one page's boxes: stretches that few boxes cover, between stretches of text.

    A stretch is cut down to its emptiest part, if that is wide enough; text must stand close on both sides of it.
    """
    if len(x0) < LEAST_BOXES or not width > 0:
        return []
    bins = int(np.ceil(width))
    lo, hi = _edges(x0, x1, bins)
    n = np.cumsum(np.bincount(lo, minlength=bins + 1) - np.bincount(hi, minlength=bins + 1))[:bins]
    peak = int(n.max())
    dense = np.flatnonzero(n > int(np.floor(np.float32(peak) * np.float32(0.25))))
    if not peak or not len(dense):
        return []
    covered = np.sort(n[dense])
    half = int(np.floor(covered[len(covered) // 2] * 0.5))
    out = []
    for g0, g1 in zip(dense[:-1] + 1, dense[1:], strict=True):
        if g1 <= g0:
            continue
        deep = np.flatnonzero(n[g0:g1] <= n[g0:g1].min() + int(np.floor(peak * 0.02 + 0.5)))
        runs = np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1)
        core = max(runs, key=len)
        if len(core) >= GUTTER:
            g0, g1 = g0 + core[0], g0 + core[-1] + 1
        if g1 - g0 < GUTTER:
            continue
        flank = min(n[max(g0 - FLANK, 0) : g0].max(initial=0), n[g1 : g1 + FLANK].max(initial=0))
        if flank >= half and n[g0:g1].min() * 2 <= flank:
            out.append((float(g0), float(g1)))
    return out if len(out) <= MOST_GUTTERS else []


def gutters(boxes: DataFrame) -> DataFrame:
    """``doc_id, page, g0, g1`` of boxes ``doc_id, page, x0, x1, page_width``.

    Pages of fewer than 200 boxes have none, nor have those with more than two.  Boxes meet their page in one shuffle,
    as two arrays; pages of too few boxes never reach Python.
    """
    return gutters_of_pages(boxes_of_pages(boxes))


def gutters_of_pages(every: DataFrame) -> DataFrame:
    """``gutters`` of pages of ``boxes_of_pages``."""
    pages = every.select("doc_id", "page", "width", "b").filter(F.size("b") >= LEAST_BOXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("b").offsets.to_numpy()
            x0, x1 = (batch.column("b").values.field(k).to_numpy() for k in (0, 1))
            rows = [(i, *g) for i, w in enumerate(batch.column("width").to_pylist()) for g in profile_gutters(x0[at[i] : at[i + 1]], x1[at[i] : at[i + 1]], w)]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("page").take(which), pa.array([r[1] for r in rows], pa.float32()), pa.array([r[2] for r in rows], pa.float32())], ["doc_id", "page", "g0", "g1"])

    return pages.mapInArrow(run, f"{_kinds(pages)}, g0 float, g1 float")


def spine(found: DataFrame) -> DataFrame:
    """``doc_id, g0, g1``: the middle one of the gutters of pages with one, if there are three and half of them lie near it."""
    votes = found.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page"))).filter("_k = 1").withColumn("c", (F.col("g0") + F.col("g1")) * 0.5)
    ranked = votes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("c", "page", "g0", "g1"))).alias("v")).filter(F.size("v") >= 3)
    middle = ranked.withColumn("m", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")))
    agree = F.size(F.filter("v", lambda x: F.abs(x["c"] - F.col("m.c")) <= SPINE))
    return middle.filter(agree * 2 >= F.size("v")).select("doc_id", "m.g0", "m.g1")


def split_at_gutters(glyphs: DataFrame, found: DataFrame) -> DataFrame:
    """The glyphs of lines (``doc_id, page, line_idx, x0, x1``) with ``piece``: a new one where a line crosses a gutter."""
    cuts = found.groupBy("doc_id", "page").agg(F.collect_list(F.struct("g0", "g1")).alias("_cuts"))
    w = Window.partitionBy("doc_id", "page", "line_idx").orderBy("x0", "x1")
    centre = (F.col("x0") + F.col("x1")) * 0.5
    joined = glyphs.join(cuts, ["doc_id", "page"], "left").withColumn("_c", centre)
    before = F.lag("_c").over(w)
    crossed = F.coalesce(F.exists(F.coalesce("_cuts", F.array().cast("array<struct<g0: float, g1: float>>")), lambda g: (F.col("_before") < g["g0"]) & (F.col("_c") > g["g1"])), F.lit(False))
    return joined.withColumn("_before", before).withColumn("piece", F.sum(crossed.cast("int")).over(w)).drop("_cuts", "_c", "_before")
