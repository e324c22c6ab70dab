"""Sessions: what a Spark session needs before the library's Python functions run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: How much of a table a task holds at once. Rows with long texts or whole planes are large, and
#: the defaults are for narrow ones. A value that the session's owner has set is left alone.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
}


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow and Parquet batches where the session has Spark's defaults."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per Spark context, and bound the session's batches."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_rasterlake_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="rasterlake-src-")) / "rasterlake-src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._rasterlake_shipped = True
