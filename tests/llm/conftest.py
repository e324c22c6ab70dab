import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang, source]); extra columns whose names clash with inner ones."""

    def build(rows, clash=False):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("th", "key", "n", "rep", "digest", "unit", "_d", "_t", "copies", "size", "part", "d"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
