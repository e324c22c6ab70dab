"""Image-pair metrics: squared error, signal-to-noise ratio, structural similarity, codec statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import finite

#: The stabilising constants of structural similarity.
EPS_MEAN, EPS_VAR = 1e-10, 9e-10


def pair(approx: DataFrame, reference: DataFrame) -> DataFrame:
    """image_id, y, x, c, a, r: both values of each cell."""
    key = ["image_id", "y", "x", "c"]
    return approx.select(*key, F.col("v").alias("a")).join(reference.select(*key, F.col("v").alias("r")), key)


def mse(pairs: DataFrame) -> DataFrame:
    """Squared differences where both are finite, over all cells."""
    d = F.when(finite(F.col("a")) & finite(F.col("r")), (F.col("a") - F.col("r")) * (F.col("a") - F.col("r"))).otherwise(0.0)
    return pairs.groupBy("image_id").agg((F.sum(d) / F.count(F.lit(1))).alias("mse"))


def psnr(pairs: DataFrame) -> DataFrame:
    """image_id, psnr_sum (over channels), psnr (their mean); infinite for equal images."""
    both = finite(F.col("a")) & finite(F.col("r"))
    per = pairs.groupBy("image_id", "c").agg(
        (F.sum(F.when(both, (F.col("a") - F.col("r")) * (F.col("a") - F.col("r"))).otherwise(0.0)) / F.count(F.lit(1))).alias("m"),
        F.greatest(F.max(F.when(both, F.col("r")).otherwise(0.0)), F.lit(0.0)).alias("peak"),
    )
    level = F.when(F.col("m") == 0, F.lit(float("inf"))).otherwise(20 * F.log10("peak") - 10 * F.log10("m"))
    return per.groupBy("image_id").agg(F.sum(level).alias("psnr_sum"), F.avg(level).alias("psnr"))


def ssim_tall(pairs: DataFrame, patch: int, width: int, height: int, limit: int | None = None) -> DataFrame:
    """image_id, ssim of single-channel pairs: patches of (2 * (patch div 2) + 1) squared cells around each cell.

    ``limit``: only centres with x and y below it (the compat form; see ``ssim_planes``).
    Each cell is sent to the centres around it, by a table of offsets whose size
    the patch bounds; ``ssim_images`` does the same by sums over boxes.
    """
    reach = patch // 2
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)))
    sent = pairs.select("image_id", "a", "r", "y", "x", F.explode(offsets).alias("o")).select("image_id", "a", "r", (F.col("y") + F.col("o.dy")).alias("cy"), (F.col("x") + F.col("o.dx")).alias("cx"))
    sent = sent.filter((F.col("cy") >= 0) & (F.col("cy") < (limit or height)) & (F.col("cx") >= 0) & (F.col("cx") < (limit or width)))
    m = sent.groupBy("image_id", "cy", "cx").agg(F.avg("a").alias("a"), F.avg("r").alias("r"), F.var_pop("a").alias("va"), F.var_pop("r").alias("vr"), F.covar_pop("a", "r").alias("cov"))
    a, r = F.col("a"), F.col("r")
    s = (2 * a * r + EPS_MEAN) * (2 * F.col("cov") + EPS_VAR) / ((a * a + r * r + EPS_MEAN) * (F.col("va") + F.col("vr") + EPS_VAR))
    return m.groupBy("image_id").agg(F.avg(s).alias("ssim"))


def _box(x: np.ndarray, reach: int) -> np.ndarray:
    """Sums over the part of each (2 reach + 1) squared patch that lies inside."""
    h, w = x.shape[-2:]
    total = np.zeros((*x.shape[:-2], h + 1, w + 1))
    total[..., 1:, 1:] = x.cumsum(-1).cumsum(-2)
    y0, y1 = np.maximum(0, np.arange(h) - reach), np.minimum(h, np.arange(h) + reach + 1)
    x0, x1 = np.maximum(0, np.arange(w) - reach), np.minimum(w, np.arange(w) + reach + 1)
    rows = total[..., y1, :] - total[..., y0, :]
    return rows[..., x1] - rows[..., x0]


def ssim_planes(a: np.ndarray, r: np.ndarray, patch: int = 16, stride: int = 1, compat: bool = False) -> np.ndarray:
    """Mean similarity of planes (count, h, w). Centres are every ``stride`` cells; ``compat``: all in the first 1 / stride of each axis."""
    reach = patch // 2
    n = _box(np.ones(a.shape[-2:]), reach)
    ma, mr, aa, rr, ar = (_box(x, reach) / n for x in (a, r, a * a, r * r, a * r))
    va, vr, cov = aa - ma * ma, rr - mr * mr, ar - ma * mr
    s = (2 * ma * mr + EPS_MEAN) * (2 * cov + EPS_VAR) / ((ma * ma + mr * mr + EPS_MEAN) * (va + vr + EPS_VAR))
    h, w = s.shape[-2:]
    s = s[..., : h // stride, : w // stride] if compat else s[..., ::stride, ::stride]
    return s.mean((-2, -1))


def ms_ssim_planes(a: np.ndarray, r: np.ndarray, patch: int = 4, stride: int = 1) -> np.ndarray:
    """Mean over the full size and every halving that leaves more than two patches; halved images are scored themselves."""
    out, side = [ssim_planes(a, r, patch, stride)], min(a.shape[-2:]) // 2
    halve = lambda x: (x[..., ::2, ::2] + x[..., 1::2, ::2] + x[..., ::2, 1::2] + x[..., 1::2, 1::2]) / 4
    while side > 2 * patch:
        a, r, side = halve(a), halve(r), side // 2
        out.append(ssim_planes(a, r, patch, stride))
    return np.mean(out, axis=0)


def plane_pairs(pairs: DataFrame, side: int) -> DataFrame:
    """image_id, side, a, r (arrays): one row per image of single-channel pairs (image_id, y, x, a, r)."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "a", "r")))
    rows = pairs.groupBy("image_id").agg(cells.alias("p"))
    return rows.select("image_id", F.lit(side).alias("side"), F.transform("p", lambda p: p["a"]).alias("a"), F.transform("p", lambda p: p["r"]).alias("r"))


def ssim_images(planes: DataFrame, patch: int, scales: bool = False) -> DataFrame:
    """image_id, ssim of (image_id, side, a, r), one image at a time; ``scales``: the mean over its halvings."""
    score = ms_ssim_planes if scales else ssim_planes

    def run(batches):
        for batch in batches:
            for image, side, a, r in zip(batch.column("image_id").to_pylist(), batch.column("side").to_pylist(), *(batch.column(c) for c in "ar"), strict=True):
                a, r = (np.asarray(x.values, float).reshape(1, side, side) for x in (a, r))
                yield pa.RecordBatch.from_arrays([pa.array([image], pa.int64()), pa.array([float(score(a, r, patch)[0])])], names=["image_id", "ssim"])

    return planes.select("image_id", "side", "a", "r").mapInArrow(run, "image_id bigint, ssim double")


def fidelity(a: np.ndarray, r: np.ndarray) -> dict:
    """The figures of the image r (3, h, w) and its decoding a that do not depend on the code's size."""
    area = r.shape[1] * r.shape[2]
    both = np.isfinite(a) & np.isfinite(r)
    d2 = np.where(both, (np.where(both, a, 0) - np.where(both, r, 0)) ** 2, 0)
    per = d2.sum((1, 2)) / area
    peak = np.maximum(0, np.where(both, r, 0).max((1, 2)))
    with np.errstate(divide="ignore"):
        level = 20 * np.log10(peak) - 10 * np.log10(per)
    luma = np.array([0.17691, 0.8124, 0.01063])
    s = float(ssim_planes(np.tensordot(luma, a, 1)[None], np.tensordot(luma, r, 1)[None], 16, 4)[0])
    return {"mse": float(d2.sum() / r.size), "psnr": float(level.mean()), "psnr_sum": float(level.sum()), "ssim": s}


def size_stats(r: np.ndarray, coded_bytes: int, found: dict) -> dict:
    """All figures of one coding of the image r, from its size and its fidelity."""
    original, bpp = r.size * 4, 8 * coded_bytes / (r.shape[1] * r.shape[2])
    return {
        "original_size": original, "compressed_size": coded_bytes, "efficiency": 1 - coded_bytes / original, "bits_per_pixel": bpp,
        **found, "score": found["ssim"] + 1 / (1 + bpp),
    }


def stats(a: np.ndarray, r: np.ndarray, coded_bytes: int) -> dict:
    """The figures of one coding of the image r (3, h, w) whose decoding is a."""
    return size_stats(r, coded_bytes, fidelity(a, r))


STATS = "original_size bigint, compressed_size bigint, efficiency double, bits_per_pixel double, mse double, psnr double, psnr_sum double, ssim double, score double"


def report(stats_rows: DataFrame) -> DataFrame:
    """Aligned ``name  value`` lines, one row per figure."""
    lines = [("Compressed size", "compressed_size", "%d bytes"), ("Compression efficiency", "efficiency", "%.4f"), ("Bits per pixel", "bits_per_pixel", "%.5f"), ("MSE", "mse", "%.5f"), ("PSNR", "psnr", "%.5f dB"), ("SSIM", "ssim", "%.5f"), ("Score", "score", "%.5f")]
    each = F.array(*(F.concat(F.rpad(F.lit(f"  - {k}:"), 30, " "), F.format_string(f, c)) for k, c, f in lines))
    return stats_rows.select("image_id", F.explode(each).alias("line"))
