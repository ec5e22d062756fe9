"""Typography of a document: body size, leading, weighted modes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.geometry import upper_median

TOLERANCE = 0.25


def pooled_mode(values: list[float], weights: list[float], tolerance: float) -> float | None:
    """The first value of the heaviest pool, the last of equals; a value joins the first pool within the tolerance."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        if v != v or v in (float("inf"), float("-inf")):
            continue
        pool = next((p for p in pools if abs(p[0] - v) < tolerance), None)
        if pool is None:
            pools.append([v, w])
        else:
            pool[1] += w
    best: list[float] | None = None
    for pool in pools:
        if best is None or pool[1] >= best[1]:
            best = pool
    return best[0] if best else None


@F.pandas_udf(T.DoubleType())
def pooled(values: pd.Series, weights: pd.Series, tolerance: pd.Series) -> pd.Series:
    """``pooled_mode`` of arrays."""
    return pd.Series([pooled_mode(list(v), list(w), t) for v, w, t in zip(values, weights, tolerance, strict=True)], dtype=float)


def dominant(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value of each group with the greatest weight in all, of equals the greatest: for values that are quantised."""
    sums = df.filter(~F.isnan(value)).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("_w", value)).alias(value))


def leading(lines: DataFrame, body: DataFrame) -> DataFrame:
    """``doc_id, leading``: the upper median of steps between lines of body size, 1.2 times that size without any."""
    near = lines.join(body, "doc_id").filter(F.abs(F.col("size") - F.col("body_size")) <= TOLERANCE)
    step = F.lead("baseline").over(Window.partitionBy("doc_id", "page").orderBy("baseline", "ord")) - F.col("baseline")
    steps = near.withColumn("_step", step).filter((F.col("_step") > F.col("body_size") * 0.5) & (F.col("_step") < F.col("body_size") * 2.5))
    found = steps.groupBy("doc_id").agg(upper_median(F.col("_step")).alias("leading"))
    return body.join(found, "doc_id", "left").select("doc_id", F.coalesce("leading", F.col("body_size") * 1.2).cast("float").alias("leading"))


def measure(lines: DataFrame) -> DataFrame:
    """``doc_id, body_size, leading``: the size of most characters, and the usual step between its lines."""
    weighed = lines.withColumn("_n", F.length("text"))
    body = dominant(weighed, ["doc_id"], "size", "_n").withColumnRenamed("size", "body_size")
    return body.join(leading(lines, body), "doc_id")
