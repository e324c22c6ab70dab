"""Rasters of real sizes, and what the catalogue's small inputs don't show."""

import threading
from dataclasses import replace

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import scalar
from rasterlake.operators import codec, entropy, metrics, pixels, rle, wavelets
from rasterlake.operators.quantise import Params
from rasterlake.plans import sweeps
from rasterlake.sources import files


class Workers:
    """The largest resident size of a Python worker while it is watched."""

    def __enter__(self):
        self.most, self.stop = 0, threading.Event()

        def watch():
            while not self.stop.wait(0.2):
                for p in psutil.Process().children(recursive=True):
                    try:
                        if "pyspark.daemon" in " ".join(p.cmdline()):
                            self.most = max(self.most, p.memory_info().rss)
                    except psutil.Error:
                        pass

        self.thread = threading.Thread(target=watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.stop.set()
        self.thread.join()


def test_an_image_of_2048(spark):
    """Coded, decoded and swept within 3 GB of a worker; other tasks hold nothing."""
    side = 2048
    pixels_ = F.transform(F.sequence(F.lit(0), F.lit(3 * side * side - 1)), lambda k: F.when((k % (side * 128) < side * 32) & (k % side > 700), 40.0).otherwise(10.0))
    image = spark.range(1).select(F.col("id").alias("image_id"), F.lit(side).alias("side"), pixels_.alias("pixels"))
    with Workers() as workers:
        back = codec.decode(codec.encode(image, Params(quality=0.6))).select("side", "error", F.size("pixels").alias("n"), F.get("pixels", F.lit(5)).alias("first")).first()
        swept = codec.sweep(image, sweeps.grid(spark, 1), groups=1).collect()
    assert (back.side, back.error, back.n) == (side, None, 3 * side * side)
    assert len(swept) == 1 and swept[0].error is None and 0 < swept[0].compressed_size < swept[0].original_size
    assert 0 < workers.most < 3 << 30


def test_a_sweep_codes_every_image_at_every_point(spark):
    rng = np.random.default_rng(4)
    rows = [(k, 8, rng.uniform(1, 50, 192).tolist()) for k in range(3)]
    images = spark.createDataFrame(rows, "image_id bigint, side int, pixels array<double>")
    points = sweeps.line(spark, 11)
    for groups in (1, 4, 50):
        got = codec.sweep(images, points, groups=groups).collect()
        assert sorted((r.image_id, r.iter) for r in got) == [(i, k) for i in range(3) for k in range(11)]


@pytest.mark.parametrize("family", list(wavelets.BANKS))
def test_passes_are_sums_over_taps(family):
    """Against a loop over outputs and taps, positions folded at the edges."""
    rng, n, b = np.random.default_rng(2), 16, wavelets.BANKS[family]
    x = rng.normal(size=n)
    want = np.zeros(n)
    for j in range(n // 2):
        for k, (low, high) in enumerate(zip(b.low, b.high, strict=True)):
            p = abs(2 * j + b.first + k)
            p = p if p < n - 1 else 2 * (n - 1) - p
            want[j] += low * x[p]
            want[n // 2 + j] += high * x[p]
    assert wavelets.analyse(x, family) == pytest.approx(want)


def test_local_peaks_of_wide_neighbourhoods():
    x = np.random.default_rng(3).normal(size=(1, 9, 9)) * 4
    for reach in (0, 1, 2, 20):
        want = [[max(1, np.abs(x[0, max(0, y - reach) : y + reach + 1, max(0, q - reach) : q + reach + 1]).max()) for q in range(9)] for y in range(9)]
        assert wavelets.local_peak(x, reach)[0] == pytest.approx(np.array(want))
    p = np.random.default_rng(4).normal(size=(2, 32, 32)) * 30
    assert np.abs(wavelets.normalised_inverse(*wavelets.normalised_forward(p, peak_reach=2), peak_reach=2) - p).max() < 1e-3


def test_planes_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(wavelets, "PLANES_BYTES", 1000)
    rows = [(k, 0, side, [float(k + v) for v in range(side * side)]) for k, side in enumerate([8, 16, 8, 8, 16])]
    planes = spark.createDataFrame(rows, "image_id bigint, c int, side int, plane array<double>").coalesce(1)
    got = {r.image_id: r.plane for r in wavelets.map_planes(planes, lambda p: p * 2).collect()}
    assert got == {k: [2 * v for v in plane] for k, _, _, plane in rows}


def test_mismatches_of_unequal_lengths(spark):
    table = lambda rows: spark.createDataFrame(rows, "stream bigint, pos bigint, symbol string")
    left = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, None), (4, 0, "x"), (5, 0, None)]
    right = [(1, 0, "a"), (2, 0, "a"), (2, 1, "c"), (3, 0, None), (4, 0, "y"), (6, 0, None)]
    got = {r.stream: r.pos for r in rle.first_mismatch(table(left), table(right)).collect()}
    assert got == {1: 1, 2: 1, 3: -1, 4: 0, 5: 0, 6: 0}
    lines = sorted((r.stream, r.pos, r.left, r.right) for r in rle.differences(table(left), table(right)).filter("stream < 5").collect())
    assert lines == [(1, 1, "b", None), (2, 1, None, "c"), (4, 0, "x", "y")]
    assert rle.first_mismatch(table([]), table([])).count() == 0


def test_blocks_and_literals_stand_for_the_symbols(spark):
    rows = [(s, p, "z" if (p * (s + 3)) % 7 > 2 else "abc"[p % 3]) for s in range(4) for p in range(40)]
    streams = spark.createDataFrame(rows, "stream bigint, pos bigint, symbol string")
    for least in (1, 2, 3, 99):
        got = rle.expand(*rle.encode_rows(streams, "z", least), "z").collect()
        assert sorted((r.stream, r.pos, r.symbol) for r in got) == rows
    assert spark.range(1).select(rle.is_const(F.lit(rle.CONST_FLAG | 5)).alias("a"), rle.is_const(F.lit(5)).alias("b")).first() == (True, False)


def test_the_last_of_equal_options_counts(spark):
    got = spark.createDataFrame([("-a=1 -b -a=2 x -c= -b=3",), ("",), (None,)], "t string").select(scalar.parse_options(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [{"a": "2", "b": "3", "c": ""}, {}, None]


def test_float_bits(spark):
    values = [0.0, -0.0, 1.0, -1.5, 1e-40, -1e-45, 3.4e38, float("inf"), float("-inf"), 0.1, 2.0**-126, 2.0**24, 1 - 2.0**-24, 255.99999]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalar.cast_bits(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [int(np.float32(v).view(np.uint32)) for v in values]
    assert spark.range(1).select(scalar.cast_bits(F.lit(float("nan"))).alias("b")).first().b == 0x7FC00000


def test_packed_bits(spark):
    raw = [b"", b"\x01", b"\xf0\x80", b"\xff\x00", b"\x0a\xb0\xc4"]
    out = spark.createDataFrame([(bytearray(x),) for x in raw], "x binary").select(scalar.packed_bit_string(F.col("x")).alias("all"), scalar.packed_bit_string(F.col("x"), 1, 2).alias("second")).collect()
    assert [r.all for r in out] == ["", "00000001", "11110000,1", "11111111", "00001010,10110000,110001"]
    assert [r.second for r in out] == ["", "", ",1", "", ",10110000"]


def test_points_that_repeat_are_sampled_each(spark):
    tall = spark.createDataFrame([(0, y, x, 0, float(4 * y + x)) for y in range(4) for x in range(4)], "image_id bigint, y int, x int, c int, v double")
    points = spark.createDataFrame([(0, 0, 0.5, 0.5), (0, 0, 0.5, 0.5), (0, 0, 9.0, -1.0)], "image_id bigint, c int, u double, v double")
    assert sorted(r.sample for r in pixels.bilinear_sample(tall, points, 4).collect()) == [3.0, 7.5, 7.5]


def test_similarity_by_boxes_is_that_by_patches(spark):
    rng = np.random.default_rng(6)
    rows = [(k, y, x, float(rng.uniform(0, 9)), float(rng.uniform(0, 9))) for k in range(2) for y in range(8) for x in range(8)]
    pairs = spark.createDataFrame(rows, "image_id bigint, y int, x int, a double, r double")
    a = {r.image_id: r.ssim for r in metrics.ssim_tall(pairs, 4, 8, 8).collect()}
    b = {r.image_id: r.ssim for r in metrics.ssim_images(metrics.plane_pairs(pairs, 8), 4).collect()}
    assert a == pytest.approx(b)


def test_hooks_of_a_sweep(spark):
    images = spark.createDataFrame([(1, 8, np.linspace(1, 50, 192).tolist())], "image_id bigint, side int, pixels array<double>")
    points = sweeps.line(spark, 3)
    plain = {r.compressed_size for r in codec.sweep(images, points).collect()}
    best = codec.sweep(images, points, on_init=lambda p, k: replace(p, quality=1.0, attenuation=4.0), on_complete=lambda s, k: s | {"score": float(k)}).collect()
    assert {r.score for r in best} == {0.0, 1.0, 2.0}
    assert len({r.compressed_size for r in best}) == 1 < len(plain)


def test_the_coder_s_debug_window():
    x = np.array([1, 2, 1, 1, 3, 2] * 5)
    model, seen = entropy.build_model(x), []
    raw = entropy.arith_encode(x, model, (4, 9), seen)
    assert raw == entropy.arith_encode(x, model) and (entropy.arith_decode(raw, model) == x).all()
    assert [(i, s) for i, s, _, _ in seen] == [(i, x[i]) for i in range(4, 10)] and all(low <= high for *_, low, high in seen)


def test_files_and_folders_exist_or_not(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    there, folder, gone = str(tmp_path / "a.bin"), str(tmp_path), str(tmp_path / "b")
    assert [files.file_exists(spark, p) for p in (there, folder, gone)] == [True, False, False]
    assert [files.directory_exists(spark, p) for p in (there, folder, gone)] == [False, True, False]
