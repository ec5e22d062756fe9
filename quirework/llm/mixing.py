"""Mixing sources to target weights by capped water-filling, and seeded sampling of repetitions.

Of a budget of B characters, source s with weight w and c characters should give B·w/Σw, but at most
``max_epochs``·c.  Sources whose cap lies below the common level are clamped, and the level of the rest is what the
budget leaves them, in proportion to their weights; that is repeated until no more are clamped.  Each round is one
aggregate over the written table of sources, whatever their number, and comes to the driver as three sums.
Epochs = share / c: a document is repeated ⌊epochs⌋ times, and once more if its seeded uniform number is below the
fraction.

Null sources form a source of their own; null or empty texts have 0 characters and are repeated like
the rest of their source.  A source without characters has 0 epochs.  Sources that ``weights`` does not
name have weight ``default_weight``; weights of 0 leave a source out.  Repeated rows share an identifier
and so a random number, and sources of one ratio of cap to weight (ties) are clamped together.  Very long texts count
with all their characters.  Other columns stay, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import unused, written

#: Among how many copies of a source's epochs its documents are spread, where there are too many sources to broadcast.
SALTS = 64


def source_epochs(docs: DataFrame, weights: dict[str, float] | None = None, max_epochs: float = 4.0, budget: float | None = None, power: float | None = None, default_weight: float = 1.0) -> DataFrame:
    """``source, n_docs, chars, weight, epochs`` of each source.

    budget: characters to draw, by default as many as there are; "cover" is the least that gives each
    source with a weight one epoch.  power: weights are the sources' characters to this power instead.
    """
    if max_epochs <= 0 or any(w < 0 for w in (weights or {}).values()) or default_weight < 0:
        raise ValueError("weights must not be negative, and max_epochs must be positive")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"))
    weight: Column = F.lit(float(default_weight))
    for s, w in (weights or {}).items():
        weight = F.when(F.col("source") == s, float(w)).otherwise(weight)
    if power is not None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(power)))
    table = written(sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0)), "sources")
    cap, ratio = F.col("chars") * float(max_epochs), F.col("chars") * float(max_epochs) / F.col("weight")
    some = table.filter("weight > 0")

    def summed(*sums: Column) -> list[float]:
        return [x or 0.0 for x in some.agg(*sums).first()]

    if budget == "cover":
        # the level that reaches the characters of the source that has the most for its weight
        (level,) = summed(F.max(F.col("chars") / F.col("weight")))
        (total,) = summed(F.sum(F.least(cap, level * F.col("weight"))))
    else:
        total = float(budget) if budget is not None else float(table.agg(F.sum("chars")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        # what those clamped so far leave goes to the rest in proportion to their weights
        over = ratio <= level
        n, taken, weights_left = summed(F.sum(over.cast("long")), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))))
        if n == clamped or not weights_left:
            break
        level, clamped = (total - taken) / weights_left, n
    share = F.when(F.col("weight") == 0, 0.0).when(ratio <= level, cap).otherwise(level * F.col("weight")) if weights_left else F.when(F.col("weight") == 0, 0.0).otherwise(cap)
    return table.select("source", "n_docs", "chars", "weight", F.round(F.when(F.col("chars") > 0, share / F.col("chars")).otherwise(0.0), 9).alias("epochs"))


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from md5 of seed and key: the same on every run, and in other engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, max_epochs: float = 4.0, budget: float | None = None, power: float | None = None, default_weight: float = 1.0, seed: int = 0, most_broadcast: int = 100_000) -> DataFrame:
    """The documents repeated to the target mix, with ``repetition`` (0, 1, ...); a column of that name in the input is replaced.

    Epochs of up to ``most_broadcast`` sources are broadcast; those of more are joined with salted documents.
    """
    docs = docs.drop("repetition")
    own, times, salt = unused(docs, "own_source", "times", "salt")
    epochs = written(source_epochs(docs, weights, max_epochs, budget, power, default_weight).select(F.col("source").alias(own), F.col("epochs").alias(times)), "epochs")
    joined = docs.join(F.broadcast(epochs), docs["source"].eqNullSafe(F.col(own)))
    if epochs.count() > most_broadcast:
        # a source may have any share of the rows: each meets one of several copies of its epochs
        copies = epochs.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, salted["source"].eqNullSafe(copies[own]) & (salted[salt] == copies[salt])).drop(copies[salt])
    whole = F.floor(times)
    n = (whole + F.when(uniform(seed, F.col("doc_id")) < F.col(times) - whole, 1).otherwise(0)).cast("int")
    drawn = joined.withColumn(times, n).filter(F.col(times) > 0)
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("repetition"))


def oracle(weights: dict[str, float], max_epochs: float, seed: int) -> str:
    """``mix_sources`` with the budget of all characters, in DuckDB, as clamping and redistributing over sorted sources."""
    cases = " ".join(f"WHEN source = '{s}' THEN {float(w)}" for s, w in weights.items())
    return f"""
WITH z AS (SELECT source, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source),
  w AS (SELECT source, chars::DOUBLE AS chars, CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE (CASE {cases} ELSE 1.0 END)::DOUBLE END AS weight FROM z),
  r AS (SELECT *, chars * {max_epochs}::DOUBLE AS cap, CASE WHEN weight > 0 THEN chars * {max_epochs}::DOUBLE / weight ELSE 'inf'::DOUBLE END AS ratio, (SELECT sum(chars) FROM w) AS budget FROM w),
  l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
  f AS (SELECT arg_min(level, {{'r': ratio, 's': source}}) AS free FROM l WHERE weight > 0 AND level < ratio),
  e AS (SELECT source, round(CASE WHEN weight = 0 THEN 0 WHEN free IS NULL OR ratio <= free THEN cap ELSE free * weight END / greatest(chars, 1), 9) AS epochs FROM l, f),
  t AS (SELECT doc_id, d.source, (floor(epochs) + CASE WHEN ('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < epochs - floor(epochs) THEN 1 ELSE 0 END)::INT AS times FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, unnest(range(times))::INT AS repetition FROM t"""
