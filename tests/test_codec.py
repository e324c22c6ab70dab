import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import codec, metrics, pixels
from rasterlake.operators.quantise import Params
from rasterlake.plans import sweeps
from rasterlake.sources import exr, files, rasters
from rasterlake.streaming.encoder import encode_stream


def picture(side: int = 32) -> np.ndarray:
    y, x = np.mgrid[0:side, 0:side]
    return np.stack([100 + 50 * np.sin(x / 5) + y, 80 + 30 * np.cos(y / 4), 20 + 0.5 * x])


def rows(spark, n: int = 3, side: int = 16):
    data = [(i, side, (picture(side) + i).ravel().tolist()) for i in range(n)]
    return spark.createDataFrame(data, "image_id bigint, side int, pixels array<double>")


def test_quality_buys_bytes_and_fidelity():
    image, sizes, levels = picture(), [], []
    for q in (0.3, 0.6, 1.0):
        raw = codec.encode_image(image, Params(quality=q))
        s = metrics.stats(codec.decode_image(raw), image, len(raw))
        sizes.append(s["bits_per_pixel"])
        levels.append(s["psnr"])
    assert sizes == sorted(sizes) and levels == sorted(levels) and levels[-1] > 45


@pytest.mark.parametrize("changes", [{"use_rle": False}, {"hilbert": False}, {"log_space": False}, {"rounding": 0.5}, {"min_compressed_precinct": 2}, {"threshold": 0.0}, {"image_gamma": 1.0}])
def test_options_decode_from_the_container_alone(changes):
    image = picture()
    decoded = codec.decode_image(codec.encode_image(image, Params(quality=1.0, **changes)))
    assert np.abs(decoded - image).max() < 8


def test_compat_token_decodes_to_the_same():
    image = picture()
    a, b = (codec.decode_image(codec.encode_image(image, Params(), compat=c)) for c in (False, True))
    assert (a == b).all()


def test_bad_input_is_refused(spark):
    with pytest.raises(ValueError):
        codec.encode_image(np.zeros((3, 12, 12)))
    with pytest.raises(ValueError):
        codec.decode_image(b"\0" * 100)
    made = codec.encode(spark.createDataFrame([(1, 12, [0.0] * 432)], "image_id bigint, side int, pixels array<double>")).first()
    assert made.container is None and "power of two" in made.error
    assert codec.decode(spark.createDataFrame([(1, bytearray(b"xx"))], "image_id bigint, container binary")).first().error


def test_nan_pixels_are_survived():
    image = picture()
    image[0, 3, 3] = np.nan
    codec.encode_image(image)


def test_frames_roundtrip_and_sweep(spark):
    images = rows(spark)
    back = codec.decode(codec.encode(images, Params(quality=1.0))).collect()
    assert len(back) == 3 and all(r.error is None and len(r.pixels) == 768 for r in back)
    out = codec.sweep(images, sweeps.grid(spark, 2)).collect()
    assert len(out) == 12 and all(r.bits_per_pixel > 0 for r in out)
    assert sweeps.grid(spark).count() == 400 and sweeps.line(spark).count() == 50


def test_stream(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("image_id bigint, side int, pixels array<double>").parquet(str(tmp_path / "in"))
    encode_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("container is not null").count() == 3


@pytest.mark.parametrize("tile", [0, 5, 64])
@pytest.mark.parametrize("compression", [exr.NONE, exr.RLE, exr.ZIPS, exr.ZIP])
def test_exr_tiles_and_runs(compression, tile):
    image = np.random.default_rng(1).choice([0.0, 0.5, 3.25], (3, 23, 17), p=[0.8, 0.1, 0.1])
    assert (exr.read_exr(exr.write_exr(image, compression, tile)) == image).all()


def test_exr_runs():
    for data in (b"", b"a", b"aaaa" * 100, bytes(range(256)) * 2, b"abbbbbbcdd" * 40, b"ab" * 300 + b"c" * 300):
        assert exr._runs_undone(exr._runs_made(data)) == data


def test_exr_sub_sampled_and_integer_channels():
    """A grey image whose one channel has every second value of every second line, as 32-bit integers."""
    w, h = 6, 4
    item = lambda name, kind, value: name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value
    head = struct.pack("<II", exr.MAGIC, exr.VERSION) + item("channels", "chlist", b"Y\0" + struct.pack("<iiii", 0, 0, 2, 2) + b"\0") + item("compression", "compression", b"\0") + item("dataWindow", "box2i", struct.pack("<4i", 0, 0, w - 1, h - 1)) + b"\0"
    lines = [struct.pack("<3I", 1 + y, 2 + y, 3 + y) if y % 2 == 0 else b"" for y in range(h)]
    blocks = [struct.pack("<ii", y, len(line)) + line for y, line in enumerate(lines)]
    at = np.cumsum([len(head) + 8 * h, *(len(b) for b in blocks[:-1])])
    got = exr.read_exr(head + struct.pack(f"<{h}Q", *at.tolist()) + b"".join(blocks))
    assert got[0].tolist() == [[1, 1, 2, 2, 3, 3]] * 2 + [[3, 3, 4, 4, 5, 5]] * 2


def test_bare_containers_and_sizes(spark):
    """Without parameters appended a container is as the format says, and decodes with what the caller knows."""
    rng = np.random.default_rng(5)
    image = rng.uniform(1, 60, (3, 32, 32))
    for compat in (False, True):
        p = Params(quality=0.8, threshold=0.3, hilbert=False)
        raw, full = codec.encode_image(image, p, compat, bare=True), codec.encode_image(image, p, compat)
        assert (full.startswith(raw) or compat) and struct.unpack_from("<IIII", raw) == (codec.IMAGE_MAGIC, 32, 32, 3)
        assert struct.unpack_from("<IBBxxii", raw, 44)[:3] == (codec.CHANNEL_MAGIC, 6, 4)
        known = Params(threshold=0.3)
        back = codec.decode_image(raw, known, compat)
        assert np.abs(back - codec.decode_image(full)).max() < (2 if compat else 1e-3)
        for x in (raw, full):
            assert sum(n for *_, n in codec.sizes_of(x)) == len(x)
        assert codec.sizes_of(raw)[-1] == ("parameters", None, None, 0)
    with pytest.raises(ValueError):
        codec.decode_image(b"\0" * 200)
    assert codec.with_flags(Params(use_rle=False, hilbert=False), 8 | 2) == (Params(use_rle=True, hilbert=False), {"verbose": False, "wavelet_out": True, "debug_coder": False})


@pytest.mark.parametrize("compression", [exr.NONE, exr.ZIPS, exr.ZIP])
def test_exr_bytes(compression):
    image = np.random.default_rng(0).normal(size=(3, 37, 21)).astype(np.float32)
    assert (exr.read_exr(exr.write_exr(image, compression)) == image.astype(np.float16)).all()


def test_exr_files(spark, tmp_path):
    folder = tmp_path / "exr"
    folder.mkdir()
    files_ = exr.encode_exr(rows(spark))
    exr.save_files(files_, str(folder))
    (folder / "bad.exr").write_bytes(b"no")
    (folder / "sub").mkdir()
    found = exr.load_exr(spark, str(folder), square=True).collect()
    assert len(found) == 4 and sum(r.error is None for r in found) == 3
    assert files.list_directory(spark, str(folder), "*.exr").count() == 4
    grey = exr.read_exr(exr.write_exr(np.ones((1, 4, 4))))
    assert grey.shape == (3, 4, 4)


def test_text_results(spark, tmp_path):
    out = codec.sweep(rows(spark, 1), sweeps.grid(spark, 2))
    files.write_sweep(out.coalesce(1), str(tmp_path / "sweep"))
    back = files.read_number_list(spark, str(tmp_path / "sweep")).collect()
    assert sum(len(r["values"]) for r in back) == 16


def test_container_table_and_cursor(spark, tmp_path):
    made = codec.encode(rows(spark))
    files.write_containers(made, str(tmp_path / "c"))
    assert files.read_containers(spark, str(tmp_path / "c")).count() == 3
    r = codec.ByteReader(bytes(range(8)))
    r.seek(99)
    assert r.at == 8
    r.seek(2)
    assert r.read("H") == 2 + 3 * 256 and r.at == 4
    with pytest.raises(Exception):
        r.read("Q")


def test_non_finite_cells_count_in_the_denominator(spark):
    key = "image_id bigint, y int, x int, c int, a double, r double"
    pairs = spark.createDataFrame([(0, 0, 0, 0, 1.0, 3.0), (0, 0, 1, 0, math.nan, 3.0), (0, 1, 0, 0, 5.0, math.inf), (0, 1, 1, 0, 2.0, 2.0)], key)
    assert metrics.mse(pairs).first().mse == 1.0


def test_shapes_are_checked(spark):
    assert pixels.check_shape(spark.createDataFrame([(16, 16)], "width int, height int")).count() == 1
    with pytest.raises(Exception):
        pixels.check_shape(spark.createDataFrame([(16, 8)], "width int, height int")).collect()


def test_planes_keep_every_cell(spark):
    tall = rasters.events_tall(spark, "/root/testdata/sf0.001")
    assert rasters.to_tall(rasters.to_planes(tall)).exceptAll(tall.drop("cents").withColumn("v", F.col("v"))).count() == 0
