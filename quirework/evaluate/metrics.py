"""How much of a reference text an output has: recall of bigrams, coverage of words, similarity of word sequences."""

from __future__ import annotations

import difflib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions import text as X


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition, for which Spark has no function."""
    fold = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t)
    # a few texts at a time are Python's, not those of a whole batch
    parts = [pa.array([fold(x.as_py()) for x in text.slice(k, 64)], pa.string()) for k in range(0, len(text), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _recall(items: DataFrame, docs: DataFrame, parts, name: str) -> DataFrame:  # noqa: ANN001
    """The share of the distinct parts of each item that each document has: an equi join on parts, counted by pair."""
    wanted = items.select("item_id", parts(X.normalise_words(F.col("text"))).alias("_g")).select("item_id", F.size("_g").alias("_n"), F.explode("_g").alias("_part"))
    had = docs.select("doc_id", F.explode(parts(X.normalise_words(F.col("text")))).alias("_part"))
    return wanted.join(had, "_part").groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.first("_n")).alias(name))


def bigram_recall(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id, doc_id, recall`` of pairs that share a bigram; items of fewer than two words have none."""
    return _recall(items, docs, X.bigrams, "recall")


def coverage(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id, doc_id, coverage`` of pairs that share a word."""
    return _recall(items, docs, F.array_distinct, "coverage")


@F.arrow_udf(T.DoubleType())
def similarity(reference: pa.Array, output: pa.Array) -> pa.Array:
    """Matching blocks of two arrays of words, twice their length by that of both; 0 for an empty reference.

    One pair at a time is taken from Arrow: as Python's words, a batch takes many times its bytes.
    """

    def ratio(a: list[str] | None, b: list[str] | None) -> float:
        return difflib.SequenceMatcher(None, a, b or [], autojunk=False).ratio() if a else 0.0

    return pa.array([ratio(reference[i].as_py(), output[i].as_py()) for i in range(len(reference))], pa.float64())


def score(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``reference``, ``output``) with ``similarity, edit_distance, recall, coverage`` and numbers of words."""
    words = pairs.withColumn("_a", X.normalise_words(nfkc("reference"))).withColumn("_b", X.normalise_words(nfkc("output")))
    n = lambda c: F.greatest(F.size(c), F.lit(1))
    a2, b2 = X.bigrams(F.col("_a")), X.bigrams(F.col("_b"))
    out = words.withColumn("similarity", similarity("_a", "_b")).withColumn("recall", F.size(F.array_intersect(a2, b2)) / n(a2))
    return out.withColumn("coverage", F.size(F.array_intersect("_a", "_b")) / n(F.array_distinct("_a"))).withColumn("edit_distance", 1 - F.col("similarity")).withColumn("reference_words", F.size("_a")).withColumn("output_words", F.size("_b")).drop("_a", "_b")
