"""Sweeps code once what several points share, with the figures of coding every point by itself."""

from dataclasses import replace

import numpy as np
import pytest

from rasterlake.operators import codec, entropy, metrics
from rasterlake.operators.quantise import Params
from rasterlake.plans import sweeps

GRID = [(i, 0.35 * (i % 20) / 20, 4 - 3 * (i // 20) / 20) for i in range(400)]


def alone(image: np.ndarray, p: Params) -> dict:
    raw = codec.encode_image(image, p)
    return metrics.stats(codec.decode_image(raw), image, len(raw))


def picture(side: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).exponential(50, (3, side, side)).round(2)


def test_rates_that_return_are_not_coded_again(monkeypatch):
    """At a side of 16 one precinct is coded; the grid has ten rates of it for luma and one for chroma."""
    calls = {"arith_encode": 0, "arith_decode": 0}

    def counted(name):
        plain = getattr(entropy, name)

        def call(*args):
            calls[name] += 1
            return plain(*args)

        return call

    image, (dealt,) = picture(16), codec.deal_points(GRID, 16, Params(), 1)
    with monkeypatch.context() as m:
        for name in calls:
            m.setattr(entropy, name, counted(name))
        got = dict(codec._swept(image, [(point[0], x) for point, x in dealt]))
    assert calls == {"arith_encode": 12, "arith_decode": 12}
    assert got == {k: alone(image, Params(quality=q, attenuation=a)) for k, q, a in GRID}


@pytest.mark.parametrize("changes", [{}, {"rounding": -0.5}, {"hilbert": False, "use_rle": False}, {"min_compressed_precinct": 1}, {"min_compressed_precinct": 300}, {"threshold": 3.9}, {"image_gamma": 1, "log_space": False}])
def test_figures_are_those_of_each_point_alone(changes):
    points = [(k, q, a) for k, (q, a) in enumerate([(0.0, 4.0), (1.0, 1.0), (0.6, 2.5), (0.6, 2.0), (0.0, 1.0), (0.33, 2.5), (0.0, 4.0), (2, 2)])]
    for image in (picture(8), picture(32), np.where(np.arange(3072).reshape(3, 32, 32) == 77, np.nan, picture(32)), np.full((3, 16, 16), 7.0)):
        dealt = codec.deal_points(points, image.shape[1], Params(**changes), 3)
        got = {k: s for share in dealt for k, s in codec._swept(image, [(point[0], x) for point, x in share])}
        want = {k: alone(image, Params(**changes, quality=q, attenuation=a)) for k, q, a in points}
        assert got.keys() == want.keys()
        for k in want:
            assert list(got[k]) == list(want[k]) and np.array_equal(list(got[k].values()), list(want[k].values()), equal_nan=True)


def test_sides_and_hooks_of_a_sweep(spark):
    """Images below and above the side that is shared out, and rows that can't be coded."""
    images = {1: picture(16), 2: picture(128), 3: picture(12), 4: picture(8)}
    rows = [(i, x.shape[1], x.ravel().tolist()) for i, x in images.items()] + [(5, 16, [1.0] * 5), (6, -4, [1.0] * 48)]
    frame = spark.createDataFrame(rows, "image_id bigint, side int, pixels array<double>")
    init = lambda p, k: replace(p, hilbert=k % 2 == 0, quality=p.quality * 2)
    for on_init in (None, init):
        got = codec.sweep(frame, sweeps.grid(spark, 4), on_init=on_init, on_complete=lambda s, k: s | {"score": float(k)}).collect()
        assert sorted((r.image_id, r.iter) for r in got) == [(i, k) for i in range(1, 7) for k in range(16)]
        for r in got:
            if r.image_id in (3, 5, 6):
                assert r.error and r.compressed_size is None
                continue
            p = Params(quality=r.quality, attenuation=r.attenuation)
            want = alone(images[r.image_id], on_init(p, r.iter) if on_init else p) | {"score": float(r.iter)}
            assert r.error is None and {k: r[k] for k in want} == want


def test_a_point_that_cannot_be_coded_leaves_the_others():
    """A quality that is no number, and a precinct with too many symbols at one rate."""
    image, points = picture(16), [(0, float("nan"), 2.0), (1, 0.3, 2.0), (2, 0.9, 2.0), (3, 0.2, 2.0)]
    plain = codec._pack_precinct
    with pytest.MonkeyPatch.context() as m:
        m.setattr(codec, "_pack_precinct", lambda symbols, empty, rate, p, compat=False: plain(symbols, empty, rate, p, compat) if rate < 100 else entropy.build_model(np.arange(70000)))
        got = {k: s for share in codec.deal_points(points, 16, Params(), 2) for k, s in codec._swept(image, [(point[0], x) for point, x in share])}
    assert {k for k, s in got.items() if isinstance(s, ValueError)} == {0, 2}
    assert all(got[k] == alone(image, Params(quality=q, attenuation=2.0)) for k, q in ((1, 0.3), (3, 0.2)))


def test_coder_bytes_by_single_bits():
    """Against an encoder that shifts one bit at a time."""
    top, half, quarter, rng = (1 << 32) - 1, 1 << 31, 1 << 30, np.random.default_rng(8)
    for kinds, size in ((2, 5), (3, 400), (60, 1000), (900, 3000)):
        x = np.concatenate([rng.integers(0, kinds, size), np.full(size, 1)])
        model = entropy.build_model(x)
        spans, low, high, pending, bits = {s: (c - p, c) for s, p, c in model}, 0, top, 0, []
        for s in x.tolist():
            width = high - low
            low, high = low + (width * spans[s][0] >> 16), low + (width * spans[s][1] >> 16) - 1
            while True:
                if high < half or low >= half:
                    bit = int(low >= half)
                    bits, pending, shift = [*bits, bit, *[1 - bit] * pending], 0, half * bit
                elif low >= quarter and high < half + quarter:
                    pending, shift = pending + 1, quarter
                else:
                    break
                low, high = (low - shift) * 2, (high - shift) * 2 + 1
        bits += entropy._closing(low, high, pending)
        raw = entropy.arith_encode(x, model)
        assert raw == len(x).to_bytes(4, "little") + np.packbits(bits).tobytes() and (entropy.arith_decode(raw, model) == x).all()


def test_streams_side_by_side_are_coded_as_alone():
    """Of many lengths and models, those with one symbol, none, and long waits included."""
    rng = np.random.default_rng(5)
    streams = [rng.geometric(rng.choice([0.02, 0.3, 0.9]), n) for n in rng.integers(1, 500, 60)] + [np.empty(0, np.int64), np.full(9, 4), np.arange(3000)]
    streams += [np.r_[np.zeros(n, np.int64), 1, np.zeros(n, np.int64)] for n in (1, 30, 400, 9000)] + [np.tile([0, 1], 700)]
    models = [entropy.build_model(x) if len(x) else [] for x in streams]
    want = [entropy.arith_encode(x, m) if m else b"" for x, m in zip(streams, models, strict=True)]
    for cells in (entropy.CELLS, 20000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(entropy, "CELLS", cells)
            assert entropy.encode_all(streams, models) == want
            assert all(np.array_equal(x, y) for x, y in zip(entropy.decode_all(want, models), streams, strict=True))


def test_images_of_a_task_are_coded_side_by_side(monkeypatch):
    """No stream of four small images is left to the coder of single streams, and figures stay those of each point alone."""
    images, points = [picture(16, seed) for seed in range(4)], GRID[::57]
    (dealt,) = codec.deal_points(points, 16, Params(), 1)
    wanted = [(point[0], x) for point, x in dealt]
    ready = [codec._prepared(x, wanted) for x in images]
    with monkeypatch.context() as m:
        m.setattr(entropy, "arith_encode", None)
        m.setattr(entropy, "arith_decode", None)
        codec.code_ahead([(r, [x for _, x in some]) for _, recoders in ready for r, some in recoders])
        got = [dict(codec._figures(*x)) for x in ready]
    assert got == [{k: alone(x, Params(quality=q, attenuation=a)) for k, q, a in points} for x in images]
