"""The queries over the corpus tables, with the parameters of production, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import classifier, fingerprint, html_extract, mixing, ngram_join, packing, quality, suffix, token_counts, url_filter

#: Sources that count more, or less, than the rest.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), window=2048, open_windows=16)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).filter("keep").select("doc_id", "quality", "toxicity")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"), min_words=50)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents")).select("doc_id", "n_paragraphs", "fingerprint")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=3, threshold=0.5)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "canonical", F.concat_ws(",", "matched").alias("matched"), "blocked")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=WEIGHTS, max_epochs=4.0, seed=7).select("doc_id", "source", "repetition")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = quality.quality_rules(_table(spark, sf_dir, "documents")).filter("keep")
    return good.select("doc_id", F.col("measures.n_words").alias("n_words"), *(F.round(F.col(f"measures.{m}"), 6).alias(m) for m in quality.SHOWN))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages)).select("page_id", "content", "n_text_nodes", "n_content_nodes", "confidence")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_classifier, op3_suffix_dedup, op4_fingerprints, op5_ngram_jaccard_join, op6_url_filters, op7_mixing, op8_quality_rules, op9_html_extraction, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_fingerprints": fingerprint.oracle(),
        "op6_url_filters": url_filter.oracle(),
        "op7_mixing": mixing.oracle(WEIGHTS, 4.0, 7),
        "op8_quality_rules": quality.kept_oracle(),
    }
