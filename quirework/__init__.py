"""Document analytics and corpus processing on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where the driver has it; on a cluster that is a shared folder, or it is installed."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
    return spark
