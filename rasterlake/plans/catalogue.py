"""All queries of the library by name; ``catalogue_sql`` has their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, halves, scalar
from ..operators import codec, entropy, metrics, pixels, quantise, rle, wavelets
from ..operators.quantise import Params
from ..runtime import ship_package
from ..sources import rasters, synthetic
from . import sweeps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAMMA = 1 / 2.2
RATE, THRESHOLD = 12, 0.5 / 12
STREAM = 256
EVENT_KINDS = ("click", "error", "purchase", "signup", "view")
STUDY_SIZES = tuple(2**k for k in range(1, 12))


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        out = f(spark, sf_dir)
        return out.select(*(F.col(c).cast("bigint").alias(c) if kind == "int" else c for c, kind in out.dtypes))

    QUERIES[f.__name__] = run
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(c, digits: int = 6):
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + 0.0


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: _round(n, digits) for n in names})


# -- pixels


@query
def pixels_tall(spark, d):
    return rasters.events_tall(spark, d, whole=False).drop("cents")


@query
def planes_roundtrip(spark, d):
    return rasters.to_tall(rasters.to_planes(rasters.events_tall(spark, d)))


@query
def extract_channel(spark, d):
    return pixels.extract_channel(rasters.events_tall(spark, d, whole=False), 1)


@query
def emplace_channel(spark, d):
    tall = rasters.events_tall(spark, d).drop("cents")
    plane = pixels.extract_channel(tall, 1).withColumn("v", F.col("v") * 2)
    return pixels.emplace_channel(tall, plane, 0)


@query
def luminance(spark, d):
    return _rounded(pixels.luminance(pixels.pixels(rasters.events_tall(spark, d))), "v", digits=9)


@query
def rgb_to_yuv(spark, d):
    return _rounded(pixels.rgb_to_yuv(pixels.pixels(rasters.events_tall(spark, d))), "v0", "v1", "v2", digits=9)


@query
def yuv_to_rgb(spark, d):
    return _rounded(pixels.yuv_to_rgb(pixels.pixels(rasters.events_tall(spark, d))), "v0", "v1", "v2", digits=9)


@query
def yuv_roundtrip_error(spark, d):
    px = pixels.pixels(rasters.events_tall(spark, d))
    first = [F.col(f"v{k}").alias(f"r{k}") for k in range(3)]
    yuv = pixels.rgb_to_yuv(px.select("*", *first), keep=("r0", "r1", "r2"))
    back = pixels.yuv_to_rgb(yuv, keep=("r0", "r1", "r2"))
    error = F.greatest(*(F.abs(F.col(f"v{k}") - F.col(f"r{k}")) for k in range(3)))
    return back.groupBy("image_id").agg(_round(F.max(error), 6).alias("max_error"))


@query
def apply_gamma(spark, d):
    return _rounded(pixels.apply_gamma(rasters.events_tall(spark, d, whole=False).drop("cents"), GAMMA), "v")


@query
def resized(spark, d):
    """Every second image as another side would leave it."""
    tall = rasters.events_tall(spark, d).drop("cents")
    return pixels.resize(tall.filter("image_id % 2 = 0"), 16).unionByName(pixels.resize(tall.filter("image_id % 2 = 1"), 4))


@query
def shape_guard(spark, d):
    """Of all sides to 70 and two off-square shapes: which may be coded; bits set in the width."""
    shapes = spark.range(1, 71).select(F.col("id").alias("width"), F.col("id").alias("height")).unionByName(spark.range(1).select(F.lit(16).cast("bigint").alias("width"), F.lit(8).cast("bigint").alias("height")))
    fine = (F.col("width") == F.col("height")) & (F.bit_count("width") == 1)
    kept = pixels.check_shape(shapes.filter(fine)).select("width", "height", F.lit(True).alias("kept"))
    return shapes.join(kept, ["width", "height"], "left").select("width", "height", F.bit_count("width").alias("bits"), F.coalesce("kept", F.lit(False)).alias("fits"))


@query
def pass_counts(spark, d):
    """The least side of each family, and its passes on powers of two."""
    rows = [(f, wavelets.min_size(f), 2**k, wavelets.n_passes(2**k), wavelets.n_primary_passes(2**k, f)) for f in wavelets.BANKS for k in range(3, 13)]
    return spark.createDataFrame(rows, "family string, min_size bigint, side bigint, passes bigint, primary_passes bigint")


@query
def clean_params(spark, d):
    """Parameters brought into their ranges."""
    rows = []
    for k in range(-3, 4):
        p = Params(quality=k / 2, image_gamma=10.0 ** (2 * k), threshold=k / 4, threshold_attenuation=k / 2, min_compressed_precinct=k).clean()
        rows.append((k, p.quality, p.image_gamma, p.threshold, p.threshold_attenuation, p.min_compressed_precinct))
    return _rounded(spark.createDataFrame(rows, "k bigint, quality double, image_gamma double, threshold double, threshold_attenuation double, min_compressed_precinct bigint"), "image_gamma", digits=9)


@query
def raw_precincts(spark, d):
    """What a container holds uncoded: the last average and the precincts below the first coded one, in order, as halves."""

    def run(batches):
        for batch in batches:
            for image, raw in zip(batch.column("image_id").to_pylist(), batch.column("container").to_pylist(), strict=True):
                for c, values in enumerate(codec.raw_values(raw)):
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([image] * n, pa.int64()), pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(values.astype(float))], names=["image_id", "c", "i", "v"])

    coded = codec.encode(_images(spark, d), Params(quality=1.0)).select("image_id", "container")
    return _rounded(coded.mapInArrow(run, "image_id bigint, c int, i int, v double"), "v")


@query
def populate_erase(spark, d):
    images = rasters.events_tall(spark, d).select("image_id").distinct()
    made = pixels.populate(images, 8, lambda i, x, y, c: (i + 10 * x + 100 * y + 1000 * c).cast("double"))
    return pixels.erase(made.withColumn("made", F.col("v"))).select("image_id", "y", "x", "c", F.col("made").alias("v"), F.col("v").alias("erased"))


def _points(spark, d):
    ids = rasters.events_tall(spark, d).select("image_id").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")
    c = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")
    return ids.select("image_id", k).select("*", c).select("image_id", "c", "k", (F.col("k") * 7 % 11 / 10.0).alias("u"), (F.col("k") * 3 % 7 / 6.0).alias("v"))


@query
def bilinear_sample(spark, d):
    return _rounded(pixels.bilinear_sample(rasters.events_tall(spark, d), _points(spark, d), rasters.SIDE), "sample").select("image_id", "c", "k", "sample")


@query
def nearest_sample(spark, d):
    return pixels.nearest_sample(rasters.events_tall(spark, d), _points(spark, d), rasters.SIDE).select("image_id", "c", "k", "sample")


@query
def downsample_2x(spark, d):
    s = pixels.downsample(rasters.events_tall(spark, d), 2, F.col("cents"))
    return s.select("image_id", "y", "x", "c", (F.col("s") / (100 * F.col("n"))).alias("v"))


@query
def diagnostic_image(spark, d):
    s = F.col("symbol")
    return _rounded(pixels.diagnostic(_symbols(spark, d).select("image_id", "i", "v", s, F.lit(RATE).alias("rate"))), "v").select("image_id", "i", "v")


# -- wavelets


def _signals(spark, d):
    e = _table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("s"))


def _exploded(df: DataFrame, c, digits: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(c).alias("i", "v")).select("vec_id", "i", _round("v", digits).alias("v"))


def _one_d(family: str, back: bool = False) -> None:
    def forward(spark, d):
        return _exploded(_signals(spark, d), wavelets.forward_1d(F.col("s"), family, 64))

    def inverse(spark, d):
        return _exploded(_signals(spark, d), wavelets.inverse_1d(F.col("s"), family, 64))

    f = inverse if back else forward
    f.__name__ = f"{family}_1d_{'inverse' if back else 'forward'}"
    query(f)


for _family in wavelets.BANKS:
    _one_d(_family)
    _one_d(_family, True)


@query
def wavelet_tap_sums(spark, d):
    rows = [(f, r, float(a), float(b)) for f in wavelets.BANKS for r, (a, b) in wavelets.tap_sums(f).items()]
    return _rounded(spark.createDataFrame(rows, "family string, role string, total double, total_abs double"), "total", "total_abs")


def _haar_blocks(spark, d):
    tall = rasters.events_tall(spark, d)
    px, py = F.when(F.col("x") % 2 == 0, 1).otherwise(-1), F.when(F.col("y") % 2 == 0, 1).otherwise(-1)
    part = lambda s: F.sum(F.col("cents") * s)
    half = lambda n: (F.col(n) / 2).cast("int").alias(n)
    return tall.groupBy("image_id", "c", half("y"), half("x")).agg(part(F.lit(1)).alias("ll"), part(px).alias("hl"), part(py).alias("lh"), part(px * py).alias("hh"))


@query
def haar_2d_level1(spark, d):
    return _haar_blocks(spark, d).select("image_id", "c", "y", "x", *((F.col(b) / 400).alias(b) for b in ("ll", "hl", "lh", "hh")))


@query
def subband_energy(spark, d):
    """Energy of the sub-bands of one Haar level: integer sums, one division."""
    e = lambda b: (F.sum(F.col(b) * F.col(b)) / 160000).alias(b.upper())
    return _haar_blocks(spark, d).agg(F.count_distinct("image_id").alias("images"), F.count(F.lit(1)).alias("cells"), *map(e, ("ll", "hl", "lh", "hh")))


@query
def cdf97_2d_level1(spark, d):
    planes = wavelets.map_planes(rasters.embedding_planes(spark, d), lambda p: wavelets.forward_planes(p, "cdf97", 1))
    return _rounded(rasters.to_tall(planes), "v").drop("c")


@query
def cdf53_2d_level1(spark, d):
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), lambda p: wavelets.forward_planes(p, "cdf53", 1))
    return _rounded(rasters.to_tall(planes), "v", digits=9)


@query
def dwt_multilevel(spark, d):
    planes = wavelets.map_planes(rasters.embedding_planes(spark, d), lambda p: wavelets.forward_planes(p, "haar"))
    return _rounded(rasters.to_tall(planes), "v").drop("c")


@query
def wavelet_only_encode(spark, d):
    return _rounded(rasters.to_tall(codec.wavelet_only(rasters.to_planes(rasters.events_tall(spark, d)))), "v", digits=4)


@query
def dwt_roundtrip(spark, d):
    """Forward and back: the samples, to the cent."""
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), lambda p: wavelets.inverse_planes(wavelets.forward_planes(p)))
    return _rounded(rasters.to_tall(planes), "v", digits=2)


@query
def normalised_roundtrip(spark, d):
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), lambda p: wavelets.normalised_inverse(*wavelets.normalised_forward(p)))
    return _rounded(rasters.to_tall(planes), "v", digits=2)


def _normalised(p):
    q, norms = wavelets.normalised_forward(p)
    return q, {"norms": norms.tolist()}


@query
def normalised_dwt_level1(spark, d):
    """The details of the first pass: divided by their average and the pass norm, in log space."""
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), _normalised, "norms array<double>")
    tall = rasters.to_tall(planes).filter((F.col("y") >= 8) | (F.col("x") >= 8))
    return _rounded(tall, "v")


@query
def pass_norms_multilevel(spark, d):
    """The norm of every pass of every plane."""
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), _normalised, "norms array<double>")
    return planes.select("image_id", "c", F.posexplode("norms").alias("pass", "norm")).select("image_id", "c", "pass", _round("norm", 6).alias("norm"))


@query
def normalised_dwt_multilevel(spark, d):
    """All passes: details divided by their average (primary bank) and the norm of their pass, in log space."""
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), _normalised, "norms array<double>")
    return _rounded(rasters.to_tall(planes), "v")


@query
def local_peaks(spark, d):
    """The largest sample at most 2 cells away, 1 at least."""
    planes = wavelets.map_planes(rasters.to_planes(rasters.events_tall(spark, d)), lambda p: wavelets.local_peak(p, 2))
    return rasters.to_tall(planes)


@query
def pass_norms(spark, d):
    """The first pass only; ``pass_norms_multilevel`` has all."""
    return QUERIES["pass_norms_multilevel"](spark, d).filter(F.col("pass") == 0)


# -- quantiser and precincts


def _coefficients(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))


def _symbols(spark, d):
    return _coefficients(spark, d).withColumn("symbol", quantise.quantise(F.col("v"), F.lit(RATE), F.lit(THRESHOLD), Params()))


@query
def quant_rates(spark, d):
    return quantise.rate_table(spark, [8, 16, 64, 256, 1024, 4096], Params())


@query
def precinct_thresholds(spark, d):
    p = Params(threshold_attenuation=0.5)
    t = quantise.threshold(F.col("rate"), F.col("precinct"), F.floor(F.log2(F.col("side").cast("double")) + 1.5), p)
    return quantise.rate_table(spark, [8, 16, 64], p).select("side", "channel_kind", "precinct", _round(t, 9).alias("threshold"))


@query
def quantise_symbols(spark, d):
    return _symbols(spark, d).select("image_id", "i", "symbol")


@query
def dequantise_symbols(spark, d):
    v = quantise.dequantise(F.col("symbol"), F.lit(RATE), F.lit(THRESHOLD), Params())
    return _symbols(spark, d).select("image_id", "i", _round(v, 6).alias("v"))


@query
def quant_error(spark, d):
    v = quantise.dequantise(F.col("symbol"), F.lit(RATE), F.lit(THRESHOLD), Params())
    return _symbols(spark, d).groupBy("image_id").agg(_round(F.max(F.abs(F.col("v") - v)), 6).alias("max_error"))


@query
def precinct_rows(spark, d):
    return _rounded(wavelets.explode_precincts(rasters.embedding_planes(spark, d)), "v").drop("c", "side")


@query
def precinct_emptiness(spark, d):
    rows = wavelets.explode_precincts(rasters.embedding_planes(spark, d))
    return quantise.empty_precincts(rows, F.lit(0.2), Params()).drop("c")


# -- curves


@query
def hilbert_to_curve(spark, d):
    xy = spark.range(256).select((F.col("id") % 16).cast("int").alias("x"), (F.col("id") / 16).cast("int").alias("y"))
    return xy.select("x", "y", curves.hilbert_index(F.col("x"), F.col("y"), 16).alias("t"))


@query
def hilbert_from_curve(spark, d):
    c = spark.range(256).select(F.col("id").cast("int").alias("t"), curves.hilbert_cell(F.col("id"), 16).alias("p"))
    return c.select("t", "p.x", "p.y")


@query
def hilbert_order_symbols(spark, d):
    """The symbols of each image as a list in the order of the curve."""
    at = curves.hilbert_index(F.col("i") % 8, (F.col("i") / 8).cast("int"), 8)
    lists = _symbols(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), F.col("symbol").alias("s")))).alias("p"))
    return lists.select("image_id", F.array_join(F.transform("p", lambda p: p["s"].cast("string")), ",").alias("symbols"))


# -- entropy


def _flag_counts(spark, d):
    li = _table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("symbol"))
    return entropy.frequencies(li, ["l_returnflag"])


@query
def symbol_frequency(spark, d):
    return _flag_counts(spark, d)


@query
def model_pmf(spark, d):
    return entropy.model(_flag_counts(spark, d), ["l_returnflag"]).select("l_returnflag", "symbol", "pmf")


@query
def model_cmf(spark, d):
    return entropy.model(_flag_counts(spark, d), ["l_returnflag"]).select("l_returnflag", "symbol", "cmf")


@query
def shannon_entropy(spark, d):
    out = entropy.entropy(entropy.model(_flag_counts(spark, d), ["l_returnflag"]), ["l_returnflag"])
    return out.select("l_returnflag", _round("entropy", 6).alias("entropy"))


@query
def bits_per_symbol(spark, d):
    out = entropy.entropy(entropy.model(_flag_counts(spark, d), ["l_returnflag"]), ["l_returnflag"])
    return out.select("l_returnflag", "n_symbols", "bits")


def _streams(spark, d):
    e = _table(spark, d, "events").select("event_id", "event_type")
    return e.select((F.col("event_id") / STREAM).cast("bigint").alias("stream"), (F.col("event_id") % STREAM).alias("pos"), F.col("event_type").alias("symbol"))


@query
def rle_blocks(spark, d):
    return rle.blocks(_streams(spark, d), "view", 2)


@query
def rle_expand(spark, d):
    """Streams, coded as a table of blocks and one of literals, and expanded to their symbols."""
    table, literals = rle.encode_rows(_streams(spark, d), "view", 2)
    return rle.expand(table, literals, "view")


@query
def rle_roundtrip(spark, d):
    """The symbols of each stream, coded with every block size of the study and decoded."""
    sizes = F.explode(F.array(*map(F.lit, STUDY_SIZES)))

    def run(batches):
        for batch in batches:
            for stream, size, x in zip(*(batch.column(c).to_pylist() for c in ("stream", "size", "s")), strict=True):
                literals, blocks = rle.encode(np.array(x), EVENT_KINDS.index("view") + 1, size)
                back = rle.decode(literals, EVENT_KINDS.index("view") + 1, blocks)
                assert not blocks or rle.encoded_length(blocks) == len(back)
                yield pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([size], pa.int64()), pa.array([back.tolist()], pa.list_(pa.int32()))], names=["stream", "size", "s"])

    decoded = _stream_lists(spark, d).select("stream", sizes.alias("size"), "s").mapInArrow(run, "stream bigint, size bigint, s array<int>")
    return decoded.select("size", "stream", F.posexplode("s").alias("pos", "k")).select("size", "stream", "pos", F.get(_event_kinds(), F.col("k") - 1).alias("symbol"))


@query
def rle_best_block_size(spark, d):
    """The size of the study that codes each stream shortest; the smaller one of equals."""

    def run(batches):
        for batch in batches:
            best = [rle.best_block_size(np.array(x), EVENT_KINDS.index("view") + 1) for x in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), pa.array(best, pa.int64())], names=["stream", "size"])

    return _stream_lists(spark, d).mapInArrow(run, "stream bigint, size bigint")


@query
def rle_encoded_length(spark, d):
    return rle.blocks(_streams(spark, d), "view", 2).groupBy("stream").agg(F.sum("len").alias("n"))


@query
def rle_ratio(spark, d):
    return _rounded(rle.ratios(rle.blocks(_streams(spark, d), "view", 2)), "ratio")


def _block_sizes(spark, d, wanted) -> DataFrame:
    sizes = F.explode(F.array(*map(F.lit, wanted))).alias("size")
    many = _streams(spark, d).select(sizes, "stream", "pos", "symbol").select(F.struct("size", "stream").alias("stream"), "pos", "symbol", "size")
    found = rle.runs(many.drop("size")).select("stream", "run", ((F.col("symbol") == "view") & (F.col("len") >= F.col("stream.size"))).alias("is_const"), "start", "len")
    out = rle.ratios(rle.merge_literals(found))
    return out.groupBy(F.col("stream.size").alias("size")).agg(F.sum("n_literals").alias("n_literals"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_input").alias("n_input"))


@query
def rle_block_size_sweep(spark, d):
    """The sizes of its SQL; ``rle_block_size_study`` has those of the study."""
    return _block_sizes(spark, d, (2, 3, 4, 8))


@query
def rle_block_size_study(spark, d):
    return _block_sizes(spark, d, STUDY_SIZES)


@query
def rle_sparse_roundtrip(spark, d):
    """Seeded sparse vectors, coded with every block size of the study and decoded: the symbols in, and those out of each size."""

    def run(batches):
        for batch in batches:
            for vector, symbols in zip(batch.column("vec_id").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
                back = [rle.decode(a, 0, b).tolist() for a, b in (rle.encode(np.array(symbols), 0, m) for m in STUDY_SIZES)]
                n = len(back)
                yield pa.RecordBatch.from_arrays([pa.array([vector] * n, pa.int64()), pa.array(STUDY_SIZES, pa.int64()), pa.array([symbols] * n, pa.list_(pa.int32())), pa.array(back, pa.list_(pa.int32()))], names=["vec_id", "size", "symbols", "decoded"])

    return synthetic.sparse_vectors(spark, 100).mapInArrow(run, "vec_id bigint, size bigint, symbols array<int>, decoded array<int>")


def _event_kinds():
    return F.array(*map(F.lit, EVENT_KINDS))


def _stream_lists(spark, d) -> DataFrame:
    """stream, s: the symbols in order, as places in EVENT_KINDS from 1."""
    code = F.array_position(_event_kinds(), F.col("symbol"))
    lists = _streams(spark, d).select("stream", F.struct("pos", code.cast("int").alias("s")).alias("p")).groupBy("stream").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return lists.select("stream", F.transform("p", lambda p: p["s"]).alias("s"))


def _coded(spark, d):
    """stream, n, n_symbols, code_bytes, entropy, decoded: each stream entropy-coded and decoded."""
    lists = _stream_lists(spark, d)

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for s in batch.column("s").to_pylist():
                x = np.array(s)
                model = entropy.build_model(x)
                raw = entropy.arith_encode(x, model)
                p = np.array([m[1] for m in model]) / entropy.MASS
                for col, v in zip(out, (len(x), len(model), len(raw), float(-(p * np.log2(p)).sum()), entropy.arith_decode(raw, model).tolist()), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("stream"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["stream", "n", "n_symbols", "code_bytes", "entropy", "decoded"])

    return lists.mapInArrow(run, "stream bigint, n bigint, n_symbols bigint, code_bytes bigint, entropy double, decoded array<int>")


@query
def arith_roundtrip(spark, d):
    """The symbols of each stream as its code gives them back."""
    back = _coded(spark, d).select("stream", "n", "n_symbols", F.posexplode("decoded").alias("pos", "k"))
    return back.select("stream", "n", "n_symbols", "pos", F.get(_event_kinds(), F.col("k") - 1).alias("symbol"))


@query
def arith_size(spark, d):
    """Within 2 bytes of what the shares' cross entropy asks for, besides the length."""
    return _coded(spark, d).select("stream", "n", "code_bytes")


@query
def coding_efficiency(spark, d):
    c = _coded(spark, d)
    null = F.ceil(F.log2("n_symbols"))
    return c.select("stream", _round(entropy.efficiency((F.col("code_bytes") - 4) * 8, F.col("n"), F.col("entropy"), null), 4).alias("efficiency"))


# -- metrics


def _pairs(spark, d, whole=True):
    r = rasters.events_tall(spark, d, whole)
    return r.select("image_id", "y", "x", "c", (F.floor(F.col("v") / 10) * 10).cast("double").alias("a"), F.col("v").alias("r"))


@query
def mse(spark, d):
    return _rounded(metrics.mse(_pairs(spark, d, whole=False)), "mse", digits=4)


@query
def finite_mse(spark, d):
    """Cells that are not finite on either side count as equal."""
    odd = F.when(F.col("x") == 3, float("nan")).when(F.col("y") == 5, float("inf")).otherwise(F.col("a"))
    return _rounded(metrics.mse(_pairs(spark, d).withColumn("a", odd)), "mse", digits=4)


@query
def psnr(spark, d):
    return _rounded(metrics.psnr(_pairs(spark, d)), "psnr_sum", "psnr", digits=5)


@query
def pair_mse(spark, d):
    """Both rasters as tables of their own, met by cell."""
    r = rasters.events_tall(spark, d)
    a = r.withColumn("v", (F.floor(F.col("v") / 10) * 10).cast("double"))
    return _rounded(metrics.mse(metrics.pair(a, r)), "mse", digits=4)


def _luminances(spark, d) -> DataFrame:
    """image_id, y, x, a, r: the luminance of the copy and of the image."""
    px = pixels.pixels(rasters.events_tall(spark, d))
    seen = pixels.luminance(px.withColumns({f"o{k}": F.col(f"v{k}") for k in range(3)}), keep=("o0", "o1", "o2")).withColumnRenamed("v", "r")
    copy = seen.withColumns({f"v{k}": (F.floor(F.col(f"o{k}") / 10) * 10).cast("double") for k in range(3)})
    return pixels.luminance(copy, keep=("r",)).withColumnRenamed("v", "a")


def _luminance_planes(spark, d) -> DataFrame:
    return metrics.plane_pairs(_luminances(spark, d), rasters.SIDE)


@query
def ssim(spark, d):
    """Of the luminance, over the whole image."""
    return _rounded(metrics.ssim_images(_luminance_planes(spark, d), 4), "ssim")


@query
def ssim_compat(spark, d):
    """Of the luminance, over the top-left part that a stride of 4 leaves."""
    return _rounded(metrics.ssim_tall(_luminances(spark, d), 4, 16, 16, limit=4), "ssim")


@query
def ssim_patches(spark, d):
    """As ``ssim``, by sending each cell to the patches around it."""
    return _rounded(metrics.ssim_tall(_luminances(spark, d), 4, 16, 16), "ssim")


@query
def ms_ssim(spark, d):
    """Of the luminance, the mean of the full size and its halvings."""
    return _rounded(metrics.ssim_images(_luminance_planes(spark, d), 3, scales=True).withColumnRenamed("ssim", "ms_ssim"), "ms_ssim")


# -- scalar functions


@query
def math_functions(spark, d):
    v = F.col("value") - 100
    return _table(spark, d, "events").select(
        "event_id", scalar.sign(v).alias("sign"), _round(scalar.sqr(v), 4).alias("sqr"), _round(scalar.cub(v), 3).alias("cub"), _round(scalar.pow4(v / 100), 6).alias("pow4"),
        scalar.comp_mod(F.col("event_id") - 500, 7).alias("comp_mod"), scalar.heaviside(50.0, v).alias("heaviside"), scalar.clamp(v, -20.0, 30.0).alias("clamp"),
        _round(scalar.saturate(v / 100), 6).alias("saturate"), _round(scalar.fract(v), 6).alias("fract"), _round(scalar.mix(1.0, 5.0, v / 100), 6).alias("mix"),
        _round(F.radians(v), 6).alias("rad"), _round(F.degrees(v / 100), 5).alias("deg"),
    )


@query
def interp_curves(spark, d):
    t = F.col("event_id") % 101 / 100.0
    return _table(spark, d, "events").select(
        "event_id", _round(scalar.smoothstep(2.0, 5.0, t), 6).alias("smooth"), _round(scalar.smoothstep(t), 6).alias("smooth_unit"), _round(scalar.trig_interpolate(t), 6).alias("trig"),
        _round(scalar.trig_interpolate_exp(t, 2.0), 6).alias("trig_exp"), _round(scalar.sigmoid_interpolate(t, 4.0), 6).alias("sigmoid"),
    )


@query
def fnv1a_u32(spark, d):
    return _table(spark, d, "events").select("event_id", scalar.fnv1a_u32(F.col("event_id")).alias("h"))


@query
def fnv1a_text(spark, d):
    return _table(spark, d, "pages").select("page_id", scalar.fnv1a_text(F.col("url")).alias("h"))


@query
def hash_combine(spark, d):
    e = _table(spark, d, "events")
    return e.select("event_id", scalar.hash_combine(F.col("event_id"), F.col("user_id")).alias("h"), scalar.hash_of(F.col("event_id"), F.col("user_id")).alias("pack"))


@query
def hash_float(spark, d):
    """Floats are hashed by the bits of their 32-bit form."""
    v = F.col("value")
    return _table(spark, d, "events").select("event_id", scalar.hash_of_float(v).alias("h"), scalar.hash_combine_float(F.col("event_id"), v).alias("combined"), scalar.cast_bits(v).alias("bits"))


@query
def packed_bits(spark, d):
    """The bits of a text's bytes up to the last one set, as a string."""
    return _table(spark, d, "pages").select("page_id", scalar.packed_bit_string(F.encode(F.substring(F.coalesce("url", F.lit("")), 1, 12), "UTF-8")).alias("bits"))


@query
def constants(spark, d):
    """The library's named constants."""
    return spark.createDataFrame([(k, float(v)) for k, v in scalar.CONSTANTS.items()], "name string, value double")


@query
def hash_as_float(spark, d):
    return _table(spark, d, "events").select("event_id", _round(scalar.as_unit_float(scalar.fnv1a_u32(F.col("event_id"))), 9).alias("f"))


@query
def xor_hash8(spark, d):
    return _table(spark, d, "pages").select("page_id", scalar.xor_hash8(F.col("url")).alias("h"), scalar.xor_checksum(F.col("url")).alias("checksum"))


@query
def ordered_dither(spark, d):
    e = F.col("event_id")
    return _table(spark, d, "events").select("event_id", scalar.ordered_dither(e, (e / 16).cast("bigint")).alias("dither"))


@query
def pcg_random(spark, d):
    return scalar.pcg4(spark.range(1, 1001).select(F.col("id").alias("seed")), "seed", 2).select("seed", "u0", "u1", "u2", "u3", _round("r0", 9).alias("r0"))


@query
def half_roundtrip(spark, d):
    def run(batches):
        for batch in batches:
            v = batch.column("v").to_numpy()
            bits = halves.to_half_bits(v, ieee=False)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("i"), pa.array(bits.astype(np.int32)), pa.array(halves.from_half_bits(bits, ieee=False).astype(float))], names=["image_id", "i", "bits", "v"])

    return _coefficients(spark, d).mapInArrow(run, "image_id bigint, i int, bits int, v double")


@query
def bit_string(spark, d):
    e = F.col("event_id")
    text = scalar.bit_string(e)
    raw = F.unhex(F.lpad(F.hex(e), 8, "0"))
    return _table(spark, d, "events").select("event_id", text.alias("bits"), scalar.bits_to_int(text).alias("back"), scalar.packed_length(raw).alias("packed_bits"))


@query
def path_parts(spark, d):
    p = F.regexp_extract("url", "^[^?#]*", 0)
    return _table(spark, d, "pages").select(
        "page_id", scalar.filename(p).alias("filename"), scalar.parent_directory(p).alias("parent"), scalar.extension(p).alias("extension"),
        scalar.replace_extension(p, ".exr").alias("as_exr"), scalar.replace_filename(p, "x").alias("renamed"), scalar.lowercase(p).alias("lower"),
    )


@query
def command_options(spark, d):
    """Words like ``-key=value`` of a command line, as a map."""
    line = F.concat(F.lit("tool -quality=0.3 -in="), F.coalesce("url", F.lit("")), F.lit(" -quality=0.5 -diagnostics plain"))
    m = scalar.parse_options(line)
    return _table(spark, d, "pages").select("page_id", m["in"].alias("source"), m["quality"].alias("quality"), m["diagnostics"].alias("flag"), F.size(m).alias("n"))


def _spoilt(spark, d) -> DataFrame:
    """The streams with a symbol changed in every third, and every fifth cut short."""
    st = _streams(spark, d)
    changed = F.when((F.col("stream") % 3 == 0) & (F.col("pos") == F.col("stream") % 100 + 20), F.lit("other")).otherwise(F.col("symbol"))
    return st.select("stream", "pos", changed.alias("symbol")).filter((F.col("stream") % 5 != 0) | (F.col("pos") < 90))


@query
def stream_mismatch(spark, d):
    """The first place of each stream at which two tables differ, lengths included, or -1."""
    return rle.first_mismatch(_streams(spark, d), _spoilt(spark, d))


@query
def stream_differences(spark, d):
    """Both symbols side by side at every place at which two tables differ."""
    return rle.differences(_streams(spark, d), _spoilt(spark, d))


@query
def first_mismatch(spark, d):
    """The first cell of each plane in which the quantised copy differs, or -1."""
    i = F.col("y") * 16 + F.col("x")
    differs = F.min(F.when(F.col("a") != F.col("r"), i))
    return _pairs(spark, d).groupBy("image_id", "c").agg(F.coalesce(differs, F.lit(-1)).alias("first_mismatch"))


# -- codec


def _images(spark, d):
    return codec.images(rasters.to_planes(rasters.events_tall(spark, d)))


@query
def codec_encode(spark, d):
    coded = codec.encode(_images(spark, d), Params(quality=0.5))
    return coded.select("image_id", F.octet_length("container").alias("n_bytes"), "error")


@query
def codec_sizes(spark, d):
    """What the parts of every container take, and their sum."""
    coded = codec.encode(_images(spark, d), Params(quality=0.5))
    parts = codec.sizes(coded).groupBy("image_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    return parts.join(coded.select("image_id", F.octet_length("container").cast("bigint").alias("container_bytes")), "image_id")


@query
def codec_decode(spark, d):
    """The cells of every image as its container gives them back."""
    back = codec.decode(codec.encode(_images(spark, d), Params(quality=1.0)))
    cells = back.select("image_id", "side", F.posexplode("pixels").alias("i", "v"))
    area = F.col("side") * F.col("side")
    y, x = ((F.col("i") % area) / F.col("side")).cast("int"), F.col("i") % F.col("side")
    return cells.select("image_id", (F.col("i") / area).cast("int").alias("c"), y.alias("y"), x.alias("x"), _round("v", 3).alias("v"))


@query
def codec_stats(spark, d):
    return codec.codec_stats(_images(spark, d)).drop("error")


@query
def stats_report(spark, d):
    return metrics.report(codec.codec_stats(_images(spark, d)))


@query
def param_sweep(spark, d):
    """Every image at all 20 x 20 points of the grid."""
    return codec.sweep(_images(spark, d), sweeps.grid(spark)).drop("error")


@query
def param_line(spark, d):
    """Every image at the 50 points of the line."""
    return codec.sweep(_images(spark, d), sweeps.line(spark)).drop("error")
