"""A corpus from documents to token files: quality, near duplicates, benchmark leaks, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import decontaminate, minhash, mixing, quality, queries, tokens
from rasterlake.llm.scratch import Scratch, clear, made


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts. Null and empty texts are judged as empty, repeated rows alike; extra columns stay."""
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8). Texts without words and rows without doc_id stay; extra columns stay."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item. Texts without words stay, repeated rows stay or go together; extra columns stay."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, 0 to 3 times. A null source is one of its own, a null text has no words; extra columns stay."""
    return mixing.mix_corpus(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in ascending doc_id order, and a row per document read back from them. A null text has the end id alone."""
    return tokens.token_report(docs, queries.tokenizer_file())


STAGES = [
    ("quality classifier", filter_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]
#: The classifier's decisions can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each written and read again; what a stage but the last leaves behind is deleted.

    An empty table goes through all stages and gives an empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = made()
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k + 1 < len(STAGES):  # the last stage's token files are what all this is for
            clear(spark, mark)
    return docs
