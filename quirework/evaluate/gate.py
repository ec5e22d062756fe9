"""The regression gate: a run's scores against those of a stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ("bigram_recall", "equation_recall", "equation_fidelity")
COUNTS = ("tables_found", "references_found", "sections_found")


def regressions(run: DataFrame, stored: DataFrame, tolerance: float = 0.005, check_missing: bool = True) -> DataFrame:
    """``paper, field, before, now, verdict`` (``regress``, ``improve``, ``same``, ``new``, ``missing``).

    Both have ``paper`` and any of the scores and counts; a field that is null or lacking on either side of a
    score is skipped, a count that is lacking now is 0.  Scores may fall by the tolerance, counts not at all.
    """
    fields = [f for f in (*SCORES, *COUNTS) if f in run.columns and f in stored.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields))
        return df.select("paper", F.explode(pairs).alias("x")).select("paper", "x.*")

    old, new = stored.select("paper", F.lit(True).alias("_old")), run.select("paper", F.lit(True).alias("_new"))
    both = old.join(new, "paper", "full_outer")
    lost = both.filter("_new IS NULL").select("paper", F.lit("paper").alias("field"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("now"), F.lit("missing").alias("verdict"))
    fresh = both.filter("_old IS NULL").select("paper", F.lit("paper").alias("field"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("now"), F.lit("new").alias("verdict"))
    joined = long(stored, "before").join(long(run, "now"), ["paper", "field"]).filter("before IS NOT NULL")
    count = F.col("field").isin(*COUNTS)
    settled = joined.withColumn("now", F.when(count, F.coalesce("now", F.lit(0.0))).otherwise(F.col("now"))).filter("now IS NOT NULL")
    slack = F.when(count, F.lit(0.0)).otherwise(F.lit(float(tolerance)))
    change = F.col("now") - F.col("before")
    judged = settled.withColumn("verdict", F.when(change < -slack, "regress").when(change > slack, "improve").otherwise("same"))
    out = judged.unionByName(fresh)
    return out.unionByName(lost) if check_missing else out


def fails(verdicts: DataFrame) -> bool:
    return not verdicts.filter(F.col("verdict").isin("regress", "missing")).isEmpty()


def totals(run: DataFrame) -> DataFrame:
    """Sums of what was found, and of what there was where that is known; means of the scores."""
    sums = [F.sum(c).alias(c) for c in run.columns if c.endswith(("_found", "_wanted"))]
    return run.agg(F.count(F.lit(1)).alias("papers"), *sums, *(F.avg(c).alias(c) for c in SCORES if c in run.columns))
