"""Parameter tables of the two tuning sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, n: int = 20) -> DataFrame:
    """n x n points: quality 0 to 0.35, attenuation 4 down to 1."""
    i = F.col("id")
    return spark.range(n * n).select(i.cast("int").alias("iter"), (0.35 * (i % n) / n).alias("quality"), (4 - 3 * F.floor(i / n) / n).alias("attenuation"))


def line(spark: SparkSession, n: int = 50) -> DataFrame:
    """n points at quality 0: attenuation from 4 down towards 2, in steps of 2 / n."""
    return spark.range(n).select(F.col("id").cast("int").alias("iter"), F.lit(0.0).alias("quality"), (4 - 2 * F.col("id") / n).alias("attenuation"))
