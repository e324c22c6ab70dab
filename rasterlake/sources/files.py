"""File and byte sources, text results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content of the regular files right in ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path).select("path", "length", "content")


def list_directory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Names only: contents are not read."""
    return binary_files(spark, path, glob).select("path", "length")


def _status(spark: SparkSession, path: str):
    """Hadoop's status of a path, or None where there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(path) if system.exists(path) else None


def file_exists(spark: SparkSession, path: str) -> bool:
    found = _status(spark, path)
    return found is not None and found.isFile()


def directory_exists(spark: SparkSession, path: str) -> bool:
    found = _status(spark, path)
    return found is not None and found.isDirectory()


def write_containers(containers: DataFrame, path: str) -> None:
    containers.write.mode("overwrite").parquet(path)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sweep(rows: DataFrame, path: str) -> None:
    """Figures as text, separated by spaces: quality, attenuation, ssim, bits_per_pixel."""
    rows.select("quality", "attenuation", "ssim", "bits_per_pixel").write.mode("overwrite").option("sep", " ").csv(path)


def read_number_list(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """Numbers of a text file, ``width`` to a row, wherever its lines end: row, values.

    A file is one list, read whole.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    numbers = text.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"([-+0-9.eE]+)"), 1)).alias("i", "n"))
    keyed = numbers.select("file", F.floor(F.col("i") / width).alias("row"), F.struct("i", F.col("n").cast("double").alias("n")).alias("p"))
    rows = keyed.groupBy("file", "row").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("file", "row", F.transform("p", lambda p: p["n"]).alias("values"))
