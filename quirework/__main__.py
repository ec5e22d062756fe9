"""Command line: ``python -m quirework convert|text|probe|dump PATH [--out FOLDER] [--files] [--format md] [--caveman light]``.

PATH has PDF files (``*.pdf``, or a folder of them), JSON primitives (``*.json``, files or folders of them), or Parquet
pages (``page_id, html``).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework import reach
from quirework.operators.page import build_lines
from quirework.plans.convert import blocks_of_primitives, convert, write, write_files
from quirework.sources import adapters
from quirework.sources import primitives as P
from quirework.sources.pdf import read_pdfs


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quirework", description=__doc__.split("\n", 1)[0])
    out.add_argument("command", choices=("convert", "text", "probe", "dump"))
    out.add_argument("path")
    out.add_argument("--out", help="folder to write to; without it, results are printed")
    out.add_argument("--format", default="md", choices=("md", "json", "typst", "text"))
    out.add_argument("--caveman", nargs="?", const="light", choices=("light", "hard", "off", "none"), help="compress prose; light if no level is named")
    out.add_argument("--files", action="store_true", help="with --out, a file for each document instead of a table")
    out.add_argument("--pdf", action="store_true", help="PATH is a folder of PDF files")
    out.add_argument("--password", default="", help="of PDF files")
    out.add_argument("--page", type=int, help="a single page, for text and dump")
    return out


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """What a command gives, as a table."""
    if args.path.rstrip("/").endswith(".parquet"):
        if args.command != "convert":
            raise ValueError("Parquet pages have no primitives; they can be converted")
        return convert(adapters.html_blocks(spark.read.parquet(args.path)), args.format, args.caveman)
    documents = P.read_json(spark, args.path)
    if args.path.rstrip("/").endswith(".pdf") or args.pdf:
        documents = read_pdfs(spark, args.path, args.password).filter("error IS NULL")
    glyphs, pages = P.glyphs(documents), P.pages(documents)
    one = F.lit(True) if args.page is None else F.col("page") == args.page
    if args.command == "convert":
        readable = documents.join(P.scanned(documents).filter("NOT scanned").select("doc_id"), "doc_id", "left_semi")
        return convert(blocks_of_primitives(readable), args.format, args.caveman)
    if args.command == "text":
        return build_lines(glyphs.filter(one)).drop("words").orderBy("doc_id", "page", "ord")
    if args.command == "probe":
        return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *(F.sum(c).alias(c) for c in ("n_glyphs", "n_paths", "n_images"))).join(P.scanned(documents), "doc_id").join(P.font_report(glyphs), "doc_id")
    return glyphs.filter(one).select(F.to_json(F.struct("*")).alias("value"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = reach(SparkSession.builder.appName("quirework").getOrCreate())
    df = result(spark, args)
    if args.out and args.files and args.command == "convert":
        write_files(df, args.out, args.format)
        return 0
    if args.out:
        write(df, args.out, args.format)
        return 0
    try:
        for row in df.toLocalIterator():
            print(row[-1] if args.command in ("convert", "dump") else row.asDict())
    except BrokenPipeError:
        sys.stderr.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
