"""Queries return all of what they stand for, not a part."""

import json
import math
from collections import defaultdict
from itertools import groupby

from oracle import DATA

from rasterlake.plans.catalogue import QUERIES
from rasterlake.plans.catalogue_sql import _TAPS


def test_sweeps_have_every_point(spark):
    images = QUERIES["codec_encode"](spark, str(DATA)).count()
    grid = QUERIES["param_sweep"](spark, str(DATA)).collect()
    assert len(grid) == 400 * images
    want = {(i, round(0.35 * (i % 20) / 20, 9), round(4 - 3 * (i // 20) / 20, 9)) for i in range(400)}
    assert {(r.iter, round(r.quality, 9), round(r.attenuation, 9)) for r in grid} == want and all(r.compressed_size for r in grid)
    line = QUERIES["param_line"](spark, str(DATA)).collect()
    assert len(line) == 50 * images and {r.iter for r in line} == set(range(50)) and {r.quality for r in line} == {0.0}
    assert all(abs(r.attenuation - (4 - 2 * r.iter / 50)) < 1e-9 for r in line)


def _pass(block, family):
    """One pass by loops over the SQL's taps: rows, then columns."""
    first, low, high, n = _TAPS[family][0], *map(json.loads, _TAPS[family][1:3]), len(block)

    def line(s):
        at = [[n - 1 - abs(n - 1 - abs(2 * j + first + k)) for k in range(len(low))] for j in range(n // 2)]
        return [sum(w * s[p] for w, p in zip(taps, ps, strict=True)) for taps in (low, high) for ps in at]

    return [list(r) for r in zip(*(line(list(c)) for c in zip(*map(line, block), strict=True)), strict=True)]


def test_norms_of_every_pass(spark):
    cells = defaultdict(lambda: [[0.0] * 16 for _ in range(16)])
    for r in QUERIES["pixels_tall"](spark, str(DATA)).collect():
        cells[r.image_id, r.c][r.y][r.x] = r.v
    want = {}
    for key, block in cells.items():
        for k, family in enumerate(("cdf97", "cdf97", "haar", "haar")):
            out, h = _pass(block, family), len(block) // 2
            size = lambda y, x: abs(out[y][x]) / (max(1, abs(out[y % h][x % h])) if k < 2 else 1)  # noqa: B023, E731
            want[*key, k] = max(1, *(math.log1p(size(y, x)) for y in range(2 * h) for x in range(2 * h) if y >= h or x >= h))
            block = [r[:h] for r in out[:h]]
    got = {(r.image_id, r.c, r["pass"]): r.norm for r in QUERIES["pass_norms_multilevel"](spark, str(DATA)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_block_sizes_of_the_study(spark):
    sizes, streams = [2**k for k in range(1, 12)], defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type").orderBy("event_id").collect():
        streams[r.event_id // 256].append(r.event_type)
    want = {}
    for m in sizes:
        kinds = [[(k == "view" and len(run) >= m, len(run)) for k, g in groupby(s) for run in [list(g)]] for s in streams.values()]
        blocks = sum(const or not i or ks[i - 1][0] for ks in kinds for i, (const, _) in enumerate(ks))
        want[m] = (sum(n for ks in kinds for const, n in ks if not const), blocks, sum(map(len, streams.values())))
    assert {r["size"]: (r.n_literals, r.n_blocks, r.n_input) for r in QUERIES["rle_block_size_study"](spark, str(DATA)).collect()} == want
