"""The outline of a document, from the levels of its headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, end, title, level, first_page, last_page, parent``: half-open ranges of blocks.

    A section reaches to the next heading of its level or above; its parent is the nearest heading before it of
    a lower level.  Blocks before the first heading are front matter: no title, level 0.
    """
    # all windows are by document: one shuffle, and one reading of the blocks
    doc = Window.partitionBy("doc_id")
    w = doc.orderBy("ord")
    ranked = blocks.select("doc_id", "page", "type", "text", F.coalesce("level", F.lit(1)).alias("level"), (F.row_number().over(w) - 1).alias("start"), F.lag("page").over(w).alias("_before"), F.count(F.lit(1)).over(doc).alias("_n"), F.max_by("page", "ord").over(doc).alias("_last"))
    head = F.col("type") == "heading"
    marked = ranked.filter(head | (F.col("start") == 0)).select("doc_id", "start", "page", head.alias("_head"), F.when(head, F.col("text")).alias("title"), F.when(head, F.col("level")).otherwise(0).alias("level"), "_before", "_n", "_last")
    # levels are few, so that the next heading at or above a level is the least of a handful of running minima
    ahead = doc.orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    behind = doc.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    none, here = F.struct(F.col("_n").cast("int").alias("at"), F.col("_last").alias("page")), F.struct(F.col("start").alias("at"), F.col("_before").alias("page"))
    stop, parent = none, F.lit(None).cast("int")
    for k in range(6, 0, -1):
        stop = F.when(F.col("level") == k, F.coalesce(F.min(F.when(F.col("_head") & (F.col("level") <= k), here)).over(ahead), none)).otherwise(stop)
        parent = F.when(F.col("level") == k, F.max(F.when(F.col("_head") & (F.col("level") < k), F.col("start"))).over(behind)).otherwise(parent)
    # front matter ends at the first heading of whatever level
    stop = F.when(~F.col("_head"), F.coalesce(F.min(F.when(F.col("_head"), here)).over(ahead), none)).otherwise(stop)
    parent = F.when(F.col("_head"), parent)
    found = marked.withColumn("_stop", stop).withColumn("parent", parent)
    # pages never go back in block order, so the first and the last block of a range tell its pages
    return found.select("doc_id", "start", F.col("_stop.at").alias("end"), "title", "level", F.col("page").alias("first_page"), F.col("_stop.page").alias("last_page"), "parent")
