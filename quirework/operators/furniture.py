"""Page furniture: running heads and folios, by the pages on which a line's signature recurs in a margin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import signature

MARGIN, LEAST_PAGES, LEAST_CLASS = 0.12, 4, 3


def mark_furniture(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The lines with ``edge``, ``signature`` and ``furniture``.

    lines: ``doc_id, page, text, baseline, page_height``; pages: ``doc_id, page``, where pages may lack lines.
    A line in a margin is furniture if its signature is on half of all pages; or, at an edge where left and
    right pages each carry a line that the others lack, on half of its side's.  Documents of fewer than four
    pages have none.  Counts are of pages, so a line repeated on one page counts once.
    """
    share = F.col("baseline") / F.col("page_height")
    edge = F.when(F.col("page_height") > 0, F.when(share <= F.lit(MARGIN).cast("float"), "top").when(share >= F.lit(1 - MARGIN).cast("float"), "bottom"))
    marked = lines.withColumn("edge", edge).withColumn("signature", signature(F.col("text")))
    total = (pages if pages is not None else lines).groupBy("doc_id").agg((F.max("page") + 1).alias("_total") if pages is None else F.countDistinct("page").alias("_total"))
    # shorter documents have none: what is counted is a few lines of a few documents, and all lines meet it once
    margin = marked.filter("edge IS NOT NULL").select("doc_id", "signature", "edge", "page", (F.col("page") % 2).alias("_parity")).distinct().join(total.filter(F.col("_total") >= LEAST_PAGES), "doc_id")
    counts = margin.groupBy("doc_id", "signature", "edge", "_parity").agg(F.count(F.lit(1)).alias("_n"), F.first("_total").alias("_total"))
    size = F.floor(F.col("_total") / 2) + F.when((F.col("_parity") == 0) & (F.col("_total") % 2 == 1), 1).otherwise(0)
    carriers = counts.filter((size >= LEAST_CLASS) & (F.col("_n") >= F.greatest(F.ceil(size / 2), F.lit(2))))
    both = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "edge", "signature")) == 2
    # an edge alternates if both parities have a carrier that the other one lacks
    single, edges = F.when(~F.col("_both"), F.col("_parity")), Window.partitionBy("doc_id", "edge")
    own = carriers.withColumn("_both", both).withColumn("_alternates", F.min(single).over(edges) < F.max(single).over(edges)).filter("_alternates")
    everywhere = margin.groupBy("doc_id", "signature").agg(F.countDistinct("page").alias("_seen"), F.first("_total").alias("_total")).filter(F.col("_seen") >= F.ceil(F.col("_total") / 2))
    keys = ["doc_id", "signature", "edge", "_parity"]
    found = own.select(keys).union(counts.select(keys).join(everywhere.select("doc_id", "signature"), ["doc_id", "signature"], "left_semi").select(keys)).distinct().withColumn("furniture", F.lit(True))
    out = marked.withColumn("_parity", F.col("page") % 2).join(found, keys, "left")
    return out.select(*lines.columns, "edge", "signature", F.coalesce("furniture", F.lit(False)).alias("furniture"))


def strip_furniture(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The lines that are no furniture."""
    return mark_furniture(lines, pages).filter("NOT furniture").select(*lines.columns)
