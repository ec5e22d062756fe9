"""Readers of page primitives: JSON documents of pages with glyphs, paths and images, and Parquet tables of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import geometry as G

BOX = "struct<x0: float, y0: float, x1: float, y1: float>"
GLYPH = f"struct<text: string, bbox: {BOX}, ox: float, oy: float, font: string, size: float, angle: float, flags: int, color: bigint, generated: boolean>"
PATH = f"struct<kind: string, bbox: {BOX}, thickness: float, color: bigint, filled: boolean, stroked: boolean>"
IMAGE = f"struct<bbox: {BOX}, object_index: int, px_width: int, px_height: int>"
DOCUMENT = f"doc_id bigint, pages array<struct<page: int, width: float, height: float, rotation: int, glyphs: array<{GLYPH}>, paths: array<{PATH}>, images: array<{IMAGE}>>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(DOCUMENT).json(path)


def pages(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", "p.width", "p.height", F.pmod("p.rotation", F.lit(360)).alias("rotation"), F.size("p.glyphs").alias("n_glyphs"), F.size("p.paths").alias("n_paths"), F.size("p.images").alias("n_images"))


def _each(documents: DataFrame, what: str) -> DataFrame:
    p = documents.select("doc_id", F.explode("pages").alias("p"))
    return p.select("doc_id", "p.page", "p.width", "p.height", F.posexplode(f"p.{what}").alias("idx", "o"))


def glyphs(documents: DataFrame) -> DataFrame:
    """Visible glyphs, ligatures spelt out, sizes mended."""
    from quirework.functions.text import expand_ligatures

    g = _each(documents, "glyphs").filter(F.col("o.text").isNotNull() & (F.col("o.text") != "") & ~F.col("o.text").rlike(r"^\p{Cntrl}+$"))
    b = F.col("o.bbox")
    return g.select("doc_id", "page", "idx", expand_ligatures(F.col("o.text")).alias("text"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), "o.ox", "o.oy", "o.font", G.glyph_size(F.col("o.size"), b, F.col("o.angle")).alias("size"), "o.angle", "o.flags", "o.color", "o.generated")


def paths(documents: DataFrame) -> DataFrame:
    """Paths on their page, by kind."""
    clipped = _each(documents, "paths").withColumn("bbox", G.clip(F.col("o.bbox"), F.col("width"), F.col("height"))).filter("bbox IS NOT NULL")
    kind = F.coalesce("o.kind", G.path_kind(F.col("bbox")))
    return clipped.select("doc_id", "page", "idx", kind.alias("kind"), "bbox", F.coalesce("o.thickness", G.path_thickness(F.col("bbox"))).alias("thickness"), "o.color", "o.filled", "o.stroked")


def images(documents: DataFrame) -> DataFrame:
    clipped = _each(documents, "images").withColumn("bbox", G.clip(F.col("o.bbox"), F.col("width"), F.col("height"))).filter("bbox IS NOT NULL")
    return clipped.select("doc_id", "page", "idx", "bbox", "o.object_index", "o.px_width", "o.px_height")


def scanned(documents: DataFrame) -> DataFrame:
    """``doc_id, scanned``: whether most pages are an image without glyphs."""
    big = F.exists("p.images", lambda i: G.width(i["bbox"]) * G.height(i["bbox"]) > F.col("p.width") * F.col("p.height") * 0.5)
    each = documents.select("doc_id", F.explode("pages").alias("p")).select("doc_id", ((F.size("p.glyphs") <= 0) & F.coalesce(big, F.lit(False))).alias("s"))
    return mostly_scanned(each).select("doc_id", "scanned")


def mostly_scanned(pages: DataFrame) -> DataFrame:
    """``doc_id, n, pages, scanned`` of pages ``doc_id, s``: whether more than half are images."""
    n = F.sum(F.col("s").cast("long"))
    return pages.groupBy("doc_id").agg(n.alias("n"), F.count(F.lit(1)).alias("pages"), (n * 2 > F.count(F.lit(1))).alias("scanned"))


def font_report(glyph_rows: DataFrame, most: int = 12) -> DataFrame:
    """The report of the commonest fonts of each document: ``doc_id, font, n, percent, rank``."""
    from pyspark.sql import Window

    n = glyph_rows.groupBy("doc_id", "font").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4)).withColumn("rank", rank).filter(F.col("rank") <= most)
