"""The report of a corpus: how much of each paper's source its conversion has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.evaluate import metrics
from quirework.evaluate import source as L
from quirework.functions.text import count_words

SHOWN = ("bigram_recall", "coverage", "similarity", "equations", "equation_recall", "equation_fidelity", "tables", "tables_found", "references", "references_found", "sections", "sections_found")


def found_in(blocks: DataFrame) -> DataFrame:
    """``doc_id, emitted, headings, tables_found, references_found, blocks`` of converted blocks."""
    count = lambda kind: F.sum((F.col("type") == kind).cast("int"))
    return blocks.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("type") == "equation", F.col("latex"))).alias("emitted"), F.collect_list(F.when(F.col("type") == "heading", F.col("text"))).alias("headings"),
        count("table").alias("tables_found"), count("reference").alias("references_found"), F.count(F.lit(1)).alias("blocks"),
    )


def score_papers(papers: DataFrame, documents: DataFrame, blocks: DataFrame, rendered: DataFrame) -> DataFrame:
    """A row for each paper that was converted, with null scores for those that can't be scored.

    papers: of ``corpus.read_sources``; documents: ``doc_id, paper``; rendered: ``doc_id, rendered``.  A source that
    declares no references or sections has none to find: their numbers are null, not 0.
    """
    every = documents.join(found_in(blocks), "doc_id").join(rendered, "doc_id").join(papers, "paper").drop("doc_id")
    some = every.filter("scorable")
    words = metrics.score(some.select("paper", "reference", F.col("rendered").alias("output"))).select("paper", F.col("recall").alias("bigram_recall"), "coverage", "similarity", "reference_words")
    maths = L.compare_equations(some.select("paper", "source", "emitted")).select("paper", F.col("reference").alias("equations"), F.col("recall").alias("equation_recall"), F.col("fidelity").alias("equation_fidelity"))
    heads = L.compare_sections(some.select("paper", "source", "headings")).select("paper", F.col("reference").alias("sections"), F.col("found").alias("sections_found"))
    tables = L.counts(some.select("paper", "source")).select("paper", F.col("n_tables").alias("tables"))
    listed = L.counts(some.select("paper", F.col("bibliography").alias("source"))).select("paper", F.col("n_references").alias("references"))
    out = every.select("paper", "scorable", "blocks", count_words(F.col("rendered")).alias("output_words"), "tables_found", "references_found")
    for part in (words, maths, heads, tables, listed):
        out = out.join(part, "paper", "left")
    known = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    rounded = [F.round(c, 4).alias(c) for c in SHOWN if c in ("bigram_recall", "coverage", "similarity", "equation_recall", "equation_fidelity")]
    return out.select("paper", "scorable", "blocks", "output_words", "reference_words", *rounded, "equations", "tables", "tables_found", known("references"), "references_found", known("sections"), "sections_found")


def table_of(rows: list[dict[str, object]]) -> str:
    """The report as a table of text, with means and sums of what was scored."""
    heads = ["paper", *SHOWN]
    scored = [r for r in rows if r["scorable"]]

    def summed(name: str) -> object:
        values = [r[name] for r in scored if r[name] is not None]
        if not values:
            return None
        return round(sum(values) / len(values), 4) if isinstance(values[0], float) else sum(values)

    lines = [heads, *([r["paper"], *(r[k] if r["scorable"] else None for k in SHOWN)] for r in rows), ["all", *(summed(k) for k in SHOWN)]]
    cells = [["-" if c is None else str(c) for c in line] for line in lines]
    width = [max(len(line[k]) for line in cells) for k in range(len(heads))]
    return "\n".join("  ".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, w) in enumerate(zip(line, width, strict=True))).rstrip() for line in cells)
