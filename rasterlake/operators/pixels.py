"""Per-pixel projections, sampling and block means of tall rasters (image_id, y, x, c, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]
#: Luminance weights, and the matrices from RGB to YUV and back.
LUMINANCE = (0.17691, 0.8124, 0.01063)
RGB_TO_YUV = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))
YUV_TO_RGB = ((1.0, 0.0, 1.13983), (1.0, -0.394565, -0.58060), (1.0, 2.03211, 0.0))


def pixels(tall: DataFrame) -> DataFrame:
    """One row per pixel: image_id, y, x, v0, v1, v2."""
    channel = lambda k: F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"v{k}")
    return tall.groupBy(*KEY).agg(*map(channel, range(3)))


def channels(px: DataFrame) -> DataFrame:
    """The inverse of ``pixels``."""
    each = F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"v{k}").alias("v")) for k in range(3)))
    return px.select(*KEY, F.explode(each).alias("p")).select(*KEY, "p.c", "p.v")


def extract_channel(tall: DataFrame, k: int) -> DataFrame:
    return tall.filter(F.col("c") == k).select(*KEY, "v")


def emplace_channel(tall: DataFrame, plane: DataFrame, k: int) -> DataFrame:
    """``tall`` with channel k taken from ``plane`` (image_id, y, x, v); cells it lacks stay."""
    new = plane.select(*KEY, F.lit(k).alias("c"), F.col("v").alias("new"))
    return tall.join(new, [*KEY, "c"], "left").select(*KEY, "c", F.coalesce("new", "v").alias("v"))


def erase(tall: DataFrame) -> DataFrame:
    return tall.withColumn("v", F.lit(0.0))


def populate(images: DataFrame, side: int, value) -> DataFrame:
    """Rows for every cell of each image_id; ``value`` maps the columns (image_id, x, y, c) to v."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = images.select("image_id", axis(side).alias("y")).select("*", axis(side).alias("x")).select("*", axis(3).alias("c"))
    return grid.withColumn("v", value(F.col("image_id"), F.col("x"), F.col("y"), F.col("c")))


def resize(tall: DataFrame, side: int) -> DataFrame:
    """Square images of another side: an image that has it already stays as it is, any other becomes zeros."""
    shape = tall.groupBy("image_id", "c").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    other = shape.filter((F.col("w") != side) | (F.col("h") != side)).select("image_id", "c")
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    made = other.select("image_id", axis().alias("y"), "c").select("image_id", "y", axis().alias("x"), "c", F.lit(0.0).alias("v"))
    return tall.join(other, ["image_id", "c"], "left_anti").select(*KEY, "c", "v").unionByName(made)


def _dot(weights, names) -> Column:
    return reduce(Column.__add__, (F.col(n) * w for w, n in zip(weights, names, strict=True)))


def luminance(px: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, the columns of ``keep``, and the luminance as v."""
    return px.select(*KEY, *keep, _dot(LUMINANCE, ("v0", "v1", "v2")).alias("v"))


def _mapped(px: DataFrame, matrix, keep: tuple[str, ...]) -> DataFrame:
    return px.select(*KEY, *keep, *(_dot(row, ("v0", "v1", "v2")).alias(f"v{k}") for k, row in enumerate(matrix)))


def rgb_to_yuv(px: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _mapped(px, RGB_TO_YUV, keep)


def yuv_to_rgb(px: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _mapped(px, YUV_TO_RGB, keep)


def apply_gamma(tall: DataFrame, gamma: float) -> DataFrame:
    """v ** gamma; a gamma of 1 changes nothing, a negative base gives NaN."""
    return tall if gamma == 1 else tall.withColumn("v", F.pow("v", F.lit(float(gamma))))


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def check_shape(images: DataFrame) -> DataFrame:
    """Fails on images (width, height) that are not square with a power of two as side."""
    fine = (F.col("width") == F.col("height")) & (F.bit_count("width") == 1)
    return images.filter(F.assert_true(fine, F.lit("images must be square, their side a power of two")).isNull())


def _cells(tall: DataFrame) -> DataFrame:
    return tall.select(F.col("image_id").alias("_i"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("c").alias("_c"), F.col("v").alias("_v"))


def _at(points: DataFrame, cells: DataFrame, x: Column, y: Column):
    return (points["image_id"] == cells["_i"]) & (points["c"] == cells["_c"]) & (x == cells["_x"]) & (y == cells["_y"])


def bilinear_sample(tall: DataFrame, points: DataFrame, side: int) -> DataFrame:
    """``points`` (image_id, c, u, v: 0 to 1, clamped) with ``sample``: four cells, weighted.

    Each point asks for its four cells in one join, in which it must find them all.
    """
    top = side - 1
    at = points
    for name, k in (("u", "x"), ("v", "y")):
        scaled = F.least(F.greatest(F.col(name) * top, F.lit(0.0)), F.lit(float(top)))
        at = at.withColumn(f"_{k}0", F.least(F.floor(scaled), F.lit(side - 2)).cast("int")).withColumn(f"_d{k}", scaled - F.col(f"_{k}0"))
    share = lambda k, o: F.col(f"_d{k}") if o else 1 - F.col(f"_d{k}")
    taps = [F.struct((F.col("_x0") + ox).alias("tx"), (F.col("_y0") + oy).alias("ty"), (share("x", ox) * share("y", oy)).alias("w")) for oy in (0, 1) for ox in (0, 1)]
    asked = at.select(*points.columns, F.explode(F.array(*taps)).alias("_tap"))
    cells = _cells(tall)
    met = asked.join(cells, _at(asked, cells, F.col("_tap.tx"), F.col("_tap.ty")))
    times = F.count(F.lit(1)) / 4
    sampled = met.groupBy(*points.columns).agg((F.sum(F.col("_v") * F.col("_tap.w")) / times).alias("sample"), F.sequence(F.lit(1), times.cast("int")).alias("_times"))
    return sampled.select(*points.columns, "sample", F.explode("_times").alias("_time")).drop("_time")


def nearest_sample(tall: DataFrame, points: DataFrame, side: int) -> DataFrame:
    """``points`` with the cell that the truncated coordinates name, clamped."""
    cell = lambda name: F.least(F.greatest(F.col(name) * (side - 1), F.lit(0.0)), F.lit(float(side - 1))).cast("int")
    at, cells = points.withColumns({"_x0": cell("u"), "_y0": cell("v")}), _cells(tall)
    return at.join(cells, _at(at, cells, F.col("_x0"), F.col("_y0"))).select(*points.columns, F.col("_v").alias("sample"))


def downsample(tall: DataFrame, factor: int, value: Column | None = None) -> DataFrame:
    """Means of factor x factor blocks (of sides that factor divides): sum and n are exact where values are integers."""
    block = lambda name: (F.col(name) / factor).cast("int").alias(name)
    return tall.groupBy("image_id", block("y"), block("x"), "c").agg(F.sum(F.col("v") if value is None else value).alias("s"), F.count(F.lit(1)).alias("n"))


def diagnostic(coefficients: DataFrame) -> DataFrame:
    """abs((symbol - rate) / rate) ** 2.2 of (image_id, c, y, x, symbol, rate); where symbol is null (DC) the value itself."""
    g = F.pow(F.abs((F.col("symbol") - F.col("rate")) / F.col("rate")), F.lit(2.2))
    return coefficients.withColumn("v", F.when(F.col("symbol").isNull(), F.abs("v")).otherwise(g))
