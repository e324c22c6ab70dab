"""Run-length coding of symbol streams.

Runs of one token of ``min_block`` or more become constant blocks; all other
symbols are literals in literal blocks. Blocks hold at most MAX_BLOCK symbols. In
DataFrames runs are found by windows; single streams are coded in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BLOCK, CONST_FLAG = 32767, 32768
MIN_INPUT = 4


def _split(n: int) -> list[int]:
    return [MAX_BLOCK] * (n // MAX_BLOCK) + ([n % MAX_BLOCK] if n % MAX_BLOCK else [])


def encode(symbols: np.ndarray, token: int, min_block: int) -> tuple[np.ndarray, list[int]]:
    """(literals, blocks). Constant blocks have CONST_FLAG set. Fewer than MIN_INPUT symbols: all literals, no blocks."""
    x = np.asarray(symbols, np.int64)
    if len(x) < MIN_INPUT:
        return x, []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x == token).astype(np.int8), [0]])))
    runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= max(2, min_block)]
    blocks, keep, at = [], np.ones(len(x), bool), 0
    for a, b in runs:
        blocks += _split(a - at) + [CONST_FLAG | n for n in _split(b - a)]
        keep[a:b], at = False, b
    return x[keep], blocks + _split(len(x) - at)


def decode(literals: np.ndarray, token: int, blocks: list[int]) -> np.ndarray:
    """No blocks: the literals as they are."""
    if not blocks:
        return np.asarray(literals, np.int64)
    out, at = [], 0
    for b in blocks:
        n = b & MAX_BLOCK
        if b & CONST_FLAG:
            out.append(np.full(n, token))
        else:
            out.append(literals[at : at + n])
            at += n
    return np.concatenate(out).astype(np.int64)


def encoded_length(blocks: list[int]) -> int:
    return sum(b & MAX_BLOCK for b in blocks)


def is_const(block: Column) -> Column:
    return block.bitwiseAND(F.lit(CONST_FLAG)) != 0


def ratio(n_literals, n_blocks, n_input):
    """Coded by plain size, at two bytes for a symbol or block."""
    return (2 * n_literals + 2 * n_blocks) / (2 * n_input)


def runs(streams: DataFrame) -> DataFrame:
    """stream, run, symbol, start, len of (stream, pos, symbol): maximal runs of equal symbols, by pos."""
    order = Window.partitionBy("stream").orderBy("pos")
    change = F.when(F.lag("symbol").over(order) == F.col("symbol"), 0).otherwise(1)
    marked = streams.withColumn("run", F.sum(change).over(order))
    return marked.groupBy("stream", "run").agg(F.min("symbol").alias("symbol"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("len"))


def blocks(streams: DataFrame, token, min_block) -> DataFrame:
    """stream, block, is_const, start, len: the block table of each stream (not above MAX_BLOCK symbols a stream).

    ``token`` and ``min_block`` are values or columns of ``streams`` that are constant in a stream.
    """
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    const = ((F.col("symbol") == col(token)) & (F.col("len") >= F.greatest(col(min_block), F.lit(2)))).alias("is_const")
    return merge_literals(runs(streams).select("stream", "run", const, "start", "len"))


def merge_literals(found: DataFrame) -> DataFrame:
    """Blocks of (stream, run, is_const, start, len): neighbouring literal runs are one block."""
    order = Window.partitionBy("stream").orderBy("run")
    before = F.lag("is_const").over(order)
    new = F.when(before.isNull() | F.col("is_const") | before, 1).otherwise(0)
    marked = found.withColumn("block", F.sum(new).over(order))
    return marked.groupBy("stream", "block").agg(F.bool_or("is_const").alias("is_const"), F.min("start").alias("start"), F.sum("len").alias("len"))


def encode_rows(streams: DataFrame, token, min_block) -> tuple[DataFrame, DataFrame]:
    """The block table of ``streams`` and their literals: (stream, at, symbol), ``at`` counting a stream's literals from 0."""
    order = Window.partitionBy("stream").orderBy("pos")
    change = F.when(F.lag("symbol").over(order) == F.col("symbol"), 0).otherwise(1)
    marked = streams.withColumn("run", F.sum(change).over(order))
    length = F.count(F.lit(1)).over(Window.partitionBy("stream", "run"))
    literals = marked.withColumn("len", length).filter(~((F.col("symbol") == F.lit(token)) & (F.col("len") >= max(2, min_block))))
    literals = literals.select("stream", (F.row_number().over(order) - 1).cast("bigint").alias("at"), "symbol")
    return blocks(streams, token, min_block), literals


def expand(table: DataFrame, literals: DataFrame, token) -> DataFrame:
    """stream, pos, symbol: what a block table and its literals stand for."""
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("is_const"), 0).otherwise(F.col("len"))
    placed = table.withColumn("first", F.coalesce(F.sum(own).over(before), F.lit(0)))
    each = placed.select("stream", "is_const", "start", "first", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
    each = each.withColumn("at", F.when(~F.col("is_const"), F.col("first") + F.col("pos") - F.col("start")))
    return each.join(literals, ["stream", "at"], "left").select("stream", "pos", F.when(F.col("is_const"), F.lit(token)).otherwise(F.col("symbol")).alias("symbol"))


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """stream, pos, left, right of all places of either; null where one has none."""
    a = left.select("stream", "pos", F.col("symbol").alias("left"), F.lit(True).alias("in_left"))
    b = right.select("stream", "pos", F.col("symbol").alias("right"), F.lit(True).alias("in_right"))
    met = a.join(b, ["stream", "pos"], "full")
    return met.withColumn("differs", ~F.col("left").eqNullSafe(F.col("right")) | F.col("in_left").isNull() | F.col("in_right").isNull())


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """stream, pos, left, right where two tables of (stream, pos, symbol) differ."""
    return _sides(left, right).filter("differs").select("stream", "pos", "left", "right")


def first_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """stream, pos: the first place at which two tables differ, one ending before the other included; -1 for equal streams."""
    first = F.min(F.when(F.col("differs"), F.col("pos")))
    return _sides(left, right).groupBy("stream").agg(F.coalesce(first, F.lit(-1)).alias("pos"))


def ratios(table: DataFrame) -> DataFrame:
    """stream, n_input, n_literals, n_blocks, ratio."""
    sums = table.groupBy("stream").agg(F.sum("len").alias("n_input"), F.sum(F.when(F.col("is_const"), 0).otherwise(F.col("len"))).alias("n_literals"), F.count(F.lit(1)).alias("n_blocks"))
    return sums.withColumn("ratio", ratio(F.col("n_literals"), F.col("n_blocks"), F.col("n_input")))


def best_block_size(symbols: np.ndarray, token: int, sizes=(2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)) -> int:
    """The size with the least coded length; the smaller one of equals."""
    coded = lambda m: (lambda out: ratio(len(out[0]), len(out[1]), max(1, len(symbols))))(encode(symbols, token, m))
    return min(sizes, key=lambda m: (coded(m), m))
