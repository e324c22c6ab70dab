"""Shared scratch storage: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: A writing task holds at most about so many bytes of rows.
ROW_GROUP_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one if all tasks run on this machine."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rasterlake-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


#: The folders that this process has made and not cleared.
_MADE: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made() -> int:
    """How many scratch folders there are: a mark for ``clear``."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch folders made since a mark. Results that are not written yet still read theirs."""
    for base in _MADE[since:]:
        _delete(spark, base)
    del _MADE[since:]


class Scratch:
    """Parquet tables under one fresh folder of the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self.base)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def save(self, df: DataFrame, table: str, **options) -> DataFrame:
        """Write ``df`` and return the written table."""
        schema = df.schema
        df.write.options(**{"parquet.block.size": str(ROW_GROUP_BYTES)} | options).mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            _delete(self.spark, self.path(table))


#: Keys that are sent to every task; beyond this they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def small_side(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` with a broadcast hint if it has at most ``limit`` rows (of a few fixed-width columns)."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys
