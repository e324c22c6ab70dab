"""Seeded symbol vectors with runs of zeros, for studies of the run-length coder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def sparse_vector(size: int, sparsity: float, seed: int) -> np.ndarray:
    """About ``sparsity`` of the values are 0, in runs of skewed lengths (r ** 5 of a tenth of the size); the rest are 1 to 255."""
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 256, size)
    while (x == 0).mean() < sparsity:
        n = int(rng.random() ** 5 * size / 10) + 1
        at = int(rng.integers(0, size))
        x[at : at + n] = 0
    return x


def sparse_vectors(spark: SparkSession, n: int, low: float = 0.0, high: float = 0.95, size: int = 1000, seed: int = 0) -> DataFrame:
    """vec_id, sparsity, symbols: ``n`` vectors, their sparsity rising from low to high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = low + (high - low) * batch["id"] / max(1, n - 1)
            yield pd.DataFrame({"vec_id": batch["id"], "sparsity": s, "symbols": [sparse_vector(size, p, seed + i) for i, p in zip(batch["id"], s, strict=True)]})

    return spark.range(n).mapInPandas(run, "vec_id bigint, sparsity double, symbols array<int>")
