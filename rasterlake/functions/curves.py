"""The Hilbert curve on squares whose side is a power of two, as column expressions and in numpy.

A two-bit state is carried from the highest coordinate bit to the lowest: whether
both axes are reversed, and whether they are exchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _levels(side: int) -> list[int]:
    if side < 1 or side & (side - 1):
        raise ValueError("side must be a power of two")
    return list(range(side.bit_length() - 2, -1, -1))


def _bit(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x.cast("int"), k).bitwiseAND(F.lit(1))


def _next(state: Column, rx: Column, ry: Column) -> Column:
    """Lower half: exchange; on its right side: reverse, too."""
    return F.when(ry == 1, state).when(rx == 1, state.bitwiseXOR(F.lit(3))).otherwise(state.bitwiseXOR(F.lit(2)))


def _turned(state: Column, a: Column, b: Column) -> tuple[Column, Column]:
    flip, swap = state.bitwiseAND(F.lit(1)), state.bitwiseAND(F.lit(2)) > 0
    return F.when(swap, b).otherwise(a).bitwiseXOR(flip), F.when(swap, a).otherwise(b).bitwiseXOR(flip)


def hilbert_index(x: Column, y: Column, side: int) -> Column:
    """The place of the cell (x, y) on the curve."""
    levels = _levels(side)
    if not levels:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("d"))

    def step(acc, k):
        rx, ry = _turned(acc["s"], _bit(x, k), _bit(y, k))
        return F.struct(_next(acc["s"], rx, ry).alias("s"), (acc["d"] * 4 + (rx * 3).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.array(*map(F.lit, levels)), start, step)["d"]


def hilbert_cell(t: Column, side: int) -> Column:
    """(x, y) of the t-th cell, as a struct."""
    levels = _levels(side)
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("x"), F.lit(0).alias("y"))

    def step(acc, k):
        digit = F.call_function("shiftright", t.cast("int"), k * 2).bitwiseAND(F.lit(3))
        rx = F.shiftright(digit, 1)
        ry = digit.bitwiseAND(F.lit(1)).bitwiseXOR(rx)
        x, y = _turned(acc["s"], rx, ry)
        return F.struct(_next(acc["s"], rx, ry).alias("s"), (acc["x"] * 2 + x).alias("x"), (acc["y"] * 2 + y).alias("y"))

    out = F.aggregate(F.array(*map(F.lit, levels)), start, step) if levels else start
    return F.struct(out["x"].alias("x"), out["y"].alias("y"))


def hilbert_order(side: int) -> np.ndarray:
    """For each cell in raster order, its place on the curve."""
    y, x = np.divmod(np.arange(side * side), side)
    flip, swap, d = np.zeros_like(x), np.zeros(len(x), bool), np.zeros_like(x)
    for k in _levels(side):
        a, b = x >> k & 1, y >> k & 1
        rx, ry = np.where(swap, b, a) ^ flip, np.where(swap, a, b) ^ flip
        d = d * 4 + (3 * rx ^ ry)
        flip, swap = flip ^ ((ry == 0) & (rx == 1)), swap ^ (ry == 0)
    return d
