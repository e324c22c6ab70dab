"""Wavelet transforms.

A pass over n samples is linear: a filter bank's taps, and how positions beyond
the edges fold back. One-dimensional transforms of short arrays are column
expressions over the non-zero entries of the pass' matrix; planes are transformed
in numpy, a few at a time, each tap being one gather along an axis.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bank:
    """Analysis and synthesis taps; ``first`` is the offset of the first tap, ``last`` of the last."""

    first: int
    last: int
    low: tuple[float, ...]
    high: tuple[float, ...]
    low_back: tuple[float, ...]
    high_back: tuple[float, ...]


_R3 = math.sqrt(3.0)
#: The taps of the published Haar, Daubechies 4 and Cohen-Daubechies-Feauveau 5/3 and 9/7 filters.
BANKS = {
    "haar": Bank(0, 1, (0.5, 0.5), (0.5, -0.5), (0.5, 0.5), (0.5, -0.5)),
    "d4": Bank(
        -1, 2,
        ((1 + _R3) / 8, (3 + _R3) / 8, (3 - _R3) / 8, (1 - _R3) / 8), ((1 - _R3) / 8, -(3 - _R3) / 8, (3 + _R3) / 8, -(1 + _R3) / 8),
        ((1 + _R3) / 8, (3 + _R3) / 8, (3 - _R3) / 8, (1 - _R3) / 8), ((1 - _R3) / 8, -(3 - _R3) / 8, (3 + _R3) / 8, -(1 + _R3) / 8),
    ),
    "cdf53": Bank(
        -2, 3,
        (0, 0.25, 0.5, 0.25, 0, 0), (0, -0.125, -0.25, 0.75, -0.25, -0.125),
        (-0.125, 0.25, 0.75, 0.25, -0.125, 0), (0, 0, -0.25, 0.5, -0.25, 0),
    ),
    "cdf97": Bank(
        -4, 5,
        (0.026748757411, -0.016864118443, -0.078223266529, 0.266864118443, 0.602949018236, 0.266864118443, -0.078223266529, -0.016864118443, 0.026748757411, 0),
        (0, 0, 0.091271763114, -0.057543526229, -0.591271763114, 1.11508705, -0.591271763114, -0.057543526229, 0.091271763114, 0),
        (0, -0.0456358815570, -0.0287717631145, 0.295635881557, 0.557543525, 0.295635881557, -0.0287717631145, -0.0456358815570, 0, 0),
        (0, 0.0133743787055, 0.0084320592215, -0.0391116332645, -0.1334320592215, 0.301474509118, -0.1334320592215, -0.0391116332645, 0.0084320592215, 0.0133743787055),
    ),
}


def tap_sums(family: str) -> dict[str, tuple[float, float]]:
    """Sum and sum of absolute values of the taps of each filter."""
    b = BANKS[family]
    return {name: (sum(t), sum(map(abs, t))) for name, t in (("low", b.low), ("high", b.high), ("low_back", b.low_back), ("high_back", b.high_back))}


def min_size(family: str) -> int:
    """The least block a bank folds over correctly (divisions truncate)."""
    b = BANKS[family]
    return 2 * max(1 - int(-b.last / 2), 1 - int(-(b.first - 1) / 2))


def n_passes(side: int) -> int:
    return int(math.log2(side // min_size("haar"))) + 1


def n_primary_passes(side: int, family: str) -> int:
    """Passes with ``family``; the coarser rest is Haar. Blocks below the bank's least size are refused."""
    if side < min_size(family) or side & (side - 1):
        raise ValueError(f"{family} needs a power of two of {min_size(family)} or more")
    return int(math.log2(side // min_size(family))) + 1


@cache
def analysis_taps(family: str, n: int) -> list[tuple[np.ndarray, float, float]]:
    """(positions, low, high) of each tap for all n / 2 outputs; positions beyond an edge are mirrored at the edge sample."""
    b, starts = BANKS[family], 2 * np.arange(n // 2) + BANKS[family].first
    fold = lambda p: np.where(np.abs(p) < n - 1, np.abs(p), 2 * (n - 1) - np.abs(p))
    return [(fold(starts + k), low, high) for k, (low, high) in enumerate(zip(b.low, b.high, strict=True))]


@cache
def synthesis_taps(family: str, n: int) -> list[tuple[int, np.ndarray, np.ndarray, float, float]]:
    """(phase, low positions, high positions, weights): samples are twice the overlapping taps, the two halves mirrored each at its own edge."""
    b, half, out = BANKS[family], n // 2, []
    for phase in (0, 1):
        for shift in range(int(-b.last / 2), int(-(b.first - 1) / 2) + 1):
            k, at = phase - 2 * shift - b.first, np.arange(half) + shift
            if 0 <= k < len(b.low_back):
                low = np.where(at < 0, -at, np.where(at >= half, 2 * half - 1 - at, at))
                high = np.where(at < 0, -at - 1, np.where(at >= half, 2 * half - 2 - at, at))
                out.append((phase, low, half + high, 2 * b.low_back[k], 2 * b.high_back[k]))
    return out


def analyse(x: np.ndarray, family: str) -> np.ndarray:
    """One pass along the last axis: averages, then details. A tap is one gather, so n samples cost n times the taps."""
    out, half = np.zeros(x.shape), x.shape[-1] // 2
    for at, low, high in analysis_taps(family, x.shape[-1]):
        part = x[..., at]
        out[..., :half] += low * part
        out[..., half:] += high * part
    return out


def synthesise(x: np.ndarray, family: str) -> np.ndarray:
    """The inverse of ``analyse``."""
    out = np.zeros(x.shape)
    for phase, low, high, w_low, w_high in synthesis_taps(family, x.shape[-1]):
        out[..., phase::2] += w_low * x[..., low] + w_high * x[..., high]
    return out


def both_axes(x: np.ndarray, step, family: str) -> np.ndarray:
    """A pass of planes (count, n, n): along rows, then along columns."""
    return step(step(x, family).swapaxes(-1, -2), family).swapaxes(-1, -2)


def analysis_matrix(family: str, n: int) -> np.ndarray:
    """The pass over n samples as a matrix, for column expressions over short arrays."""
    return analyse(np.eye(n), family).T


def synthesis_matrix(family: str, n: int) -> np.ndarray:
    return synthesise(np.eye(n), family).T


def _apply(matrix: np.ndarray, signal: Column) -> Column:
    """matrix x signal, as sums over the non-zero entries in order of position; the matrix is one literal."""
    entries = [[{"p": p, "w": float(row[p])} for p in np.flatnonzero(row).tolist()] for row in matrix]
    rows = F.from_json(F.lit(json.dumps(entries)), "array<array<struct<p:int,w:double>>>")
    return F.transform(rows, lambda row: F.aggregate(row, F.lit(0.0), lambda total, e: total + F.get(signal, e["p"]) * e["w"]))


def forward_1d(signal: Column, family: str, n: int) -> Column:
    """One analysis pass over an array of n doubles, as an array."""
    return _apply(analysis_matrix(family, n), signal)


def inverse_1d(coefficients: Column, family: str, n: int) -> Column:
    return _apply(synthesis_matrix(family, n), coefficients)


def families(side: int, family: str) -> list[str]:
    """The bank of each pass, finest first."""
    primary = n_primary_passes(side, family)
    return [family if k < primary else "haar" for k in range(n_passes(side))]


def forward_planes(p: np.ndarray, family: str = "cdf97", passes: int | None = None) -> np.ndarray:
    """Transform planes (count, side, side): each pass splits the top-left block into four quadrants."""
    p, size = np.array(p, float), p.shape[-1]
    for name in families(size, family)[:passes]:
        p[:, :size, :size] = both_axes(p[:, :size, :size], analyse, name)
        size //= 2
    return p


def inverse_planes(p: np.ndarray, family: str = "cdf97", passes: int | None = None) -> np.ndarray:
    p = np.array(p, float)
    for k, name in reversed(list(enumerate(families(p.shape[-1], family)[:passes]))):
        size = p.shape[-1] >> k
        p[:, :size, :size] = both_axes(p[:, :size, :size], synthesise, name)
    return p


def _details(p: np.ndarray, half: int) -> list[np.ndarray]:
    """Views of the three detail quadrants: right, below, both."""
    return [p[:, :half, half : 2 * half], p[:, half : 2 * half, :half], p[:, half : 2 * half, half : 2 * half]]


def local_peak(averages: np.ndarray, reach: int = 0) -> np.ndarray:
    """max(1, the largest absolute average of the cells at most ``reach`` away on both axes)."""
    peak = np.maximum(1, np.abs(averages))
    for axis in (-1, -2):
        n, spread = peak.shape[axis], peak
        for k in range(1, min(reach, n - 1) + 1):
            low, high = np.arange(n - k), np.arange(k, n)
            moved = spread.copy()
            for to, at in ((high, low), (low, high)):
                np.put_along_axis(moved, _along(to, axis, peak), np.maximum(np.take(moved, to, axis), np.take(peak, at, axis)), axis)
            spread = moved
        peak = spread
    return peak


def _along(at: np.ndarray, axis: int, x: np.ndarray) -> np.ndarray:
    shape = [1] * x.ndim
    shape[axis] = len(at)
    return np.broadcast_to(at.reshape(shape), [len(at) if k == x.ndim + axis else n for k, n in enumerate(x.shape)])


def normalised_forward(p: np.ndarray, family: str = "cdf97", log_space: bool = True, peak_reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and pass norms (count, passes).

    ``peak_reach``: details are divided by the largest average within so many cells.

    After each pass details are divided by max(1, abs(average)) where the bank
    is the primary one, brought to log space, and, where a plane's largest
    exceeds 1, divided by it: that is the norm.
    """
    p, side = np.array(p, float), p.shape[-1]
    names, size = families(side, family), side
    norms = np.ones((len(p), len(names)))
    primary = n_primary_passes(side, family)
    for k, name in enumerate(names):
        p[:, :size, :size] = both_axes(p[:, :size, :size], analyse, name)
        size //= 2
        peak = local_peak(p[:, :size, :size], peak_reach)
        for d in _details(p, size):
            if k < primary:
                d /= peak
            if log_space:
                d[...] = np.copysign(np.log1p(np.abs(d)), d)
        norm = np.maximum(1, np.max([np.abs(d).max((1, 2)) for d in _details(p, size)], axis=0))
        for d in _details(p, size):
            d /= norm[:, None, None]
        norms[:, k] = norm
    return p, norms


def normalised_inverse(p: np.ndarray, norms: np.ndarray, family: str = "cdf97", log_space: bool = True, peak_reach: int = 0) -> np.ndarray:
    p, side = np.array(p, float), p.shape[-1]
    primary = n_primary_passes(side, family)
    for k, name in reversed(list(enumerate(families(side, family)))):
        size = side >> k
        peak = local_peak(p[:, : size // 2, : size // 2], peak_reach)
        for d in _details(p, size // 2):
            d *= norms[:, k][:, None, None]
            if log_space:
                d[...] = np.copysign(np.expm1(np.abs(d)), d)
            if k < primary:
                d *= peak
        p[:, :size, :size] = both_axes(p[:, :size, :size], synthesise, name)
    return p


#: Bytes of planes that are transformed at once.
PLANES_BYTES = 8 << 20


def map_planes(planes: DataFrame, function, extra: str = "") -> DataFrame:
    """Apply ``function`` (planes of one side as (count, side, side) -> planes, or (planes, {column: values})) to Arrow batches.

    ``extra`` declares the added columns. Planes of several sides may be mixed. At
    most ``PLANES_BYTES`` of planes are transformed at once, or one plane.
    """
    schema = "image_id bigint, c int, side int, plane array<double>" + (", " + extra if extra else "")

    def run(batches):
        for batch in batches:
            sides = batch.column("side").to_numpy()
            for side in np.unique(sides).tolist():
                alike = batch.filter(pa.array(sides == side))
                step = max(1, PLANES_BYTES // (8 * side * side))
                for at in range(0, alike.num_rows, step):
                    some = alike.slice(at, step)
                    values = some.column("plane").flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)
                    out = function(values)
                    out, more = out if isinstance(out, tuple) else (out, {})
                    flat = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * side * side, pa.array(np.ascontiguousarray(out, float).reshape(-1)))
                    columns = {"image_id": some.column("image_id"), "c": some.column("c"), "side": some.column("side"), "plane": flat}
                    columns |= {k: pa.array(list(v)) for k, v in more.items()}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return planes.select("image_id", "c", F.col("side").cast("int").alias("side"), "plane").mapInArrow(run, schema)


def precincts(side: int) -> list[tuple[int, int, int, int]]:
    """(precinct, quadrant, y, x) corners: precinct p >= 1 has three quadrants of side 2 ** (p - 1)."""
    out = []
    for p in range(1, side.bit_length()):
        h = 1 << (p - 1)
        out += [(p, 0, 0, h), (p, 1, h, 0), (p, 2, h, h)]
    return out


def explode_precincts(coefficients: DataFrame) -> DataFrame:
    """image_id, c, side, precinct, quad, y, x (within the quadrant), v; precinct 0 is the single average."""
    flat = coefficients.select("image_id", "c", "side", F.posexplode("plane").alias("i", "v"))
    y, x = (F.col("i") / F.col("side")).cast("int"), F.col("i") % F.col("side")
    flat = flat.withColumns({"py": y, "px": x})
    big = F.greatest("py", "px")
    precinct = F.when(big == 0, 0).otherwise(F.floor(F.log2(big.cast("double") + 0.5)).cast("int") + 1)
    flat = flat.withColumn("precinct", precinct)
    half = F.when(F.col("precinct") == 0, 1).otherwise(F.pow(F.lit(2.0), F.col("precinct") - 1).cast("int"))
    quad = F.when(F.col("precinct") == 0, 0).otherwise((F.col("py") >= half).cast("int") * 2 + (F.col("px") >= half).cast("int") - 1)
    return flat.select("image_id", "c", "side", "precinct", quad.alias("quad"), (F.col("py") % half).alias("y"), (F.col("px") % half).alias("x"), "v")
