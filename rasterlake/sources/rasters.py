"""Rasters as DataFrames.

Tall: image_id, y, x, c, v. Planes: image_id, c, side, plane (row-major array of
double). Tables of numbers stand in for images where there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, CHANNELS = 16, 3


def events_tall(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """``events.value`` as 16 x 16 images of 3 channels: (image_id, y, x, c, v, cents).

    Events are dense in event_id; ``whole``: the last, incomplete image is left
    out. Images are found per row, so nothing is shuffled but the one count.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    size = SIDE * SIDE * CHANNELS
    complete = events.agg(((F.max("event_id") + 1) / size).cast("bigint").alias("complete"))
    at, cell = F.col("event_id") % size, (F.col("event_id") % size / CHANNELS).cast("int")
    tall = events.select(
        (F.col("event_id") / size).cast("bigint").alias("image_id"), (cell / SIDE).cast("int").alias("y"), (cell % SIDE).alias("x"),
        (at % CHANNELS).cast("int").alias("c"), F.col("value").alias("v"), F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    return tall.filter(F.col("image_id") < (complete.first()[0] or 0)) if whole else tall


def to_planes(tall: DataFrame, side: int = SIDE, value: str = "v") -> DataFrame:
    """One row per (image_id, c); an image is one value, so side bounds what meets in a task."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v"))))
    return tall.groupBy("image_id", "c").agg(F.transform(cells, lambda p: p["v"]).alias("plane")).select("image_id", "c", F.lit(side).alias("side"), "plane")


def to_tall(planes: DataFrame) -> DataFrame:
    flat = planes.select("image_id", "c", "side", F.posexplode("plane").alias("i", "v"))
    return flat.select("image_id", (F.col("i") / F.col("side")).cast("int").alias("y"), (F.col("i") % F.col("side")).alias("x"), "c", "v")


def embedding_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8 x 8 planes of channel 0."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("image_id"), F.lit(0).alias("c"), F.lit(8).alias("side"), F.col("embedding").cast("array<double>").alias("plane"))
