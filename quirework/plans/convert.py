"""Whole conversions: lines or primitives to blocks, and blocks to documents."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.compress import compress_block, level_of
from quirework.operators import blocks as B
from quirework.operators import columns, furniture, page, paper, render, sections, stats
from quirework.operators.bibliography import extract_bibliography
from quirework.operators.placement import attach_figures
from quirework.storage import discard, written

FORMATS = {"md": render.to_markdown, "typst": render.to_typst, "text": render.to_text}


def blocks_of_lines(lines: DataFrame) -> DataFrame:
    """Lines of pages as typed blocks: furniture goes, lines are put in reading order, and assembled.

    lines: ``doc_id, page, ord, text, baseline, size, x0, y0, x1, y1, bold, page_height``.  What is left of them is
    written to the shared folder in reading order, since typography, vocabulary and blocks all read it.
    """
    kept = furniture.strip_furniture(lines)
    ordered = written(page.in_reading_order(kept.select(*lines.columns)), "lines")
    return B.assemble(ordered, stats.measure(ordered))


def blocks_of_primitives(documents: DataFrame) -> DataFrame:
    """Documents of primitives (of ``read_json`` or a data source) as typed blocks, through all passes.

    Lines, columns and their spine, furniture, typography, reading order, tables, equations and inline mathematics,
    blocks, figures, and the bibliography with its citations, in this order.  What several passes read is written to
    the shared folder: the pages once as read and once in columns, without glyphs from then on.
    """
    read = written(paper.read_pages(documents), "pages")
    gutters = read.select("doc_id", "page", F.explode("gutters").alias("g")).select("doc_id", "page", "g.g0", "g.g1")
    split = written(paper.split_pages(read, columns.spine(gutters)), "columns")
    discard(read)
    light = paper.light_lines(split)
    marked = written(furniture.mark_furniture(light, split.select("doc_id", "page")), "lines")
    gone = marked.filter("furniture").groupBy("doc_id", "page").agg(F.collect_set("ord").alias("gone"))
    typography = written(stats.measure(marked.filter("NOT furniture").select(*light.columns)), "typography")
    items = written(paper.lift_pages(split, gone, typography), "items")
    prose = items.filter("kind = 'line'").select(*light.columns)
    placed = paper.place_lifted(B.assemble(prose, typography), items)
    regions = split.select("doc_id", "page", F.posexplode("regions").alias("region", "r")).select("doc_id", "page", "region", "r.*")
    return extract_bibliography(written(attach_figures(placed, regions), "blocks"))


def convert(blocks: DataFrame, to: str = "md", caveman: str | None = None) -> DataFrame:
    """``doc_id, rendered`` of blocks as ``md``, ``typst``, ``text`` or ``json``, compressed at a level."""
    level = level_of(caveman)
    shown = blocks.withColumn("text", compress_block(F.col("type"), F.col("text"), level))
    if to == "json":
        return render.to_json(shown, sections.sections(shown)).select("doc_id", F.col("document").alias("rendered"))
    if to not in FORMATS:
        raise ValueError(f"format is one of {sorted([*FORMATS, 'json'])}")
    return FORMATS[to](shown)


def write(rendered: DataFrame, folder: str, to: str = "md") -> None:
    """One Parquet table of rendered documents; files of one document each are a matter of ``doc_id`` partitions."""
    rendered.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{to}")


#: Endings of files by format.
ENDINGS = {"md": "md", "typst": "typ", "text": "txt", "json": "json"}


def write_files(rendered: DataFrame, folder: str, to: str = "md") -> int:
    """A file ``<doc_id>.<ending>`` for each document, in a folder that all executors share; gives their number.

    A file takes its name once it is complete, so that a repeated task replaces it as a whole.
    """
    ending = ENDINGS[to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else Path(folder).absolute().as_uri())
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("rendered").to_pylist(), strict=True):
                with fs.open_output_stream(part := f"{root}/.{doc}.{attempt}") as f:
                    f.write((text or "").encode())
                fs.move(part, f"{root}/{doc}.{ending}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())], ["doc_id"])

    return rendered.select("doc_id", "rendered").mapInArrow(run, "doc_id long").count()
