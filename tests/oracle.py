"""Compare a Spark result with DuckDB's over the same Parquet tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def connect(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"create view {path.stem} as select * from '{source}'")
    return con


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str([round(float(v), 9) if isinstance(v, float) else v for v in r]) for r in frame.astype(object).values.tolist())


def same(spark_frame, con, sql: str) -> None:
    got, want = spark_frame.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert not [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
