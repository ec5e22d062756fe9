"""The words of each document, and the rejoining of words that a line break has cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import let, split_words, vocabulary_key


def vocabulary(lines: DataFrame) -> DataFrame:
    """``doc_id, word, n``: words of letters and hyphens within lines, where no break can have cut them."""
    # split once: a filter before, or that which Spark puts before an explode of no empty arrays, would split again
    inner = lines.select("doc_id", F.explode_outer(let(split_words(F.col("text")), lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))).alias("w"))
    return inner.select("doc_id", vocabulary_key(F.col("w")).alias("word")).filter("word IS NOT NULL").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def may_rejoin(head: Column, tail: Column) -> Column:
    """The word that both sides of a break would make, null if they can't."""
    merged = F.lower(F.concat(head, tail))
    letters = F.regexp_replace(tail, "-", "")
    good = vocabulary_key(head).isNotNull() & vocabulary_key(tail).isNotNull() & (F.length(tail) >= 2) & ~tail.rlike(r"^\p{Lu}") & (F.length(merged) >= 6)
    return F.when(good & (letters != ""), merged)


def rejoins(n_merged: Column, n_tail: Column) -> Column:
    """Whether the counts of a document speak for one word."""
    return (n_merged > 0) & (n_merged >= F.greatest(n_tail * 2, F.lit(1)))


def rejoin_candidates(lines: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, ord, head, tail, merged, joins`` of neighbouring lines whose boundary may be within a word."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    sides = lines.withColumn("_next", after).select("doc_id", "ord", F.try_element_at(split_words(F.col("text")), F.lit(-1)).alias("head"), F.try_element_at(split_words(F.col("_next")), F.lit(1)).alias("tail"))
    some = sides.withColumn("merged", may_rejoin(F.col("head"), F.col("tail"))).filter("merged IS NOT NULL")
    a = words.select("doc_id", F.col("word").alias("merged"), F.col("n").alias("_m"))
    b = words.select("doc_id", F.col("word").alias("_tail"), F.col("n").alias("_t"))
    counted = some.withColumn("_tail", F.lower("tail")).join(a, ["doc_id", "merged"], "left").join(b, ["doc_id", "_tail"], "left")
    return counted.select("doc_id", "ord", "head", "tail", "merged", rejoins(F.coalesce("_m", F.lit(0)), F.coalesce("_t", F.lit(0))).alias("joins"))
