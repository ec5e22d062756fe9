"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and gives what the next one reads from Parquet.

Rows with a null or blank text break a quality rule and go in the first stage.  Rows without identifier are judged by
their text alone: they have no copies and no passages.  Repeated rows of one identifier fare alike in the first three
stages and the mix, and are packed once each.  Of ties, i.e. copies of one text, the least identifier stays.  Very long texts
are taken whole in every stage.  Other columns stay, whatever their names, until packing, which gives windows.  An
empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.common import written
from quirework.llm.mixing import mix_sources
from quirework.llm.ngram_join import drop_near_copies
from quirework.llm.packing import pack
from quirework.llm.quality import keep_good
from quirework.llm.suffix import cut_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word 3-grams, Jaccard similarity of a half and more."""
    return drop_near_copies(docs, n=3, threshold=0.5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document has."""
    return cut_passages(docs, min_words=50)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the 0.7th power of their size; each document at least once, at most four times."""
    return mix_sources(docs, power=0.7, max_epochs=4.0, budget="cover", seed=7).drop("repetition")


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of 2048 words."""
    return pack(docs, window=2048, open_windows=16)


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("mix", mix), ("windows", windows)]
#: Packing depends on the order in which files are read, so its rows are not a matter of SQL: tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
