"""Scores conversions: ``python -m quirework.evaluate PDFS SOURCES [--only NAME] [--json] [--baseline FILE] [--caveman LEVEL]``.

PDFS and SOURCES are folders; a paper is a PDF file and an archive of LaTeX of the same name.  With a baseline, an
earlier report of ``--json``, the command fails if a paper has lost against it.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework import reach
from quirework.evaluate import corpus, gate, report
from quirework.plans.convert import blocks_of_primitives, convert
from quirework.sources.pdf import read_pdfs
from quirework.storage import written

FIELDS = "paper string, bigram_recall double, equation_recall double, equation_fidelity double, tables_found int, references_found int, sections_found int"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quirework.evaluate", description=__doc__.split("\n", 1)[0])
    out.add_argument("pdfs")
    out.add_argument("sources")
    out.add_argument("--only", default="", help="a part of the names of papers")
    out.add_argument("--json", action="store_true")
    out.add_argument("--baseline", type=Path)
    return out


def scores(spark: SparkSession, pdfs: str, sources: str, only: str = "") -> DataFrame:
    papers = corpus.read_sources(spark, sources, only)
    documents = read_pdfs(spark, pdfs).withColumn("paper", corpus.stem(F.col("path"), r"\.pdf")).filter(F.col("paper").contains(only) & F.col("error").isNull())
    parsed = written(documents, "papers")
    blocks = written(blocks_of_primitives(parsed.select("doc_id", "pages")), "paper-blocks")
    return report.score_papers(papers, parsed.select("doc_id", "paper"), blocks, convert(blocks, "md"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = reach(spark or SparkSession.builder.appName("quirework").getOrCreate())
    run = written(scores(spark, args.pdfs, args.sources, args.only), "scores")
    rows = [r.asDict() for r in run.orderBy("paper").collect()]
    if not rows:
        print("no paper has both a PDF file and a source", file=sys.stderr)
        return 2
    print(json.dumps({r["paper"]: r for r in rows}, indent=2, sort_keys=True) if args.json else report.table_of(rows))
    if args.baseline:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        old = [tuple(r.get(k) for k in names) for r in json.loads(args.baseline.read_text()).values() if r.get("scorable", True)]
        verdicts = gate.regressions(run.filter("scorable").select(*names), spark.createDataFrame(old, FIELDS), check_missing=not args.only)
        bad = verdicts.filter(F.col("verdict").isin("regress", "missing")).orderBy("paper", "field").collect()
        for r in bad:
            print(f"{r.verdict}: {r.paper} {r.field} {r.before} -> {r.now}", file=sys.stderr)
        return 1 if bad else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
