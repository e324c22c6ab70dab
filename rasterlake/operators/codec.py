"""The image codec: gamma and colour, normalised transform, precincts, quantiser, curve order, runs, entropy code.

Images are coded independently, in Arrow batches; nothing is shuffled. With its
parameters appended, a container decodes alone; without them the decoder is told
those that the headers lack.

Container, little-endian: image header (magic, width, height, channels; gamma,
quantiser gamma, quality, attenuation as floats; flags, precincts, bytes of a
symbol), then per channel a header (magic, u8 precincts, u8 first coded one, two
bytes of padding, number of raw values, number of norms), the raw values as halves,
a rate per precinct, the norms as floats, and from the first coded precinct on: magic,
u8 flags, a byte of padding, u16 entries of the model, bytes of code, entries of the
block table; the model as (u16 symbol, u32 share), the block table as u16, the code.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import hilbert_order
from ..functions.halves import from_half_bits, to_half_bits
from . import entropy, rle
from .metrics import STATS, fidelity, size_stats
from .pixels import RGB_TO_YUV, YUV_TO_RGB
from .quantise import MAX_SYMBOL, Params, rates
from .wavelets import PLANES_BYTES, normalised_forward, normalised_inverse, precincts

#: Magic numbers of the container's image, channel and precinct headers.
IMAGE_MAGIC, CHANNEL_MAGIC, PRECINCT_MAGIC = 0xBA45F007, 0x328AB01C, 0x176A77BB
SYMBOL_BYTES = 2
EMPTY = 1
#: The bits of the encoder's flags.
FLAGS = {"verbose": 1, "wavelet_out": 2, "debug_coder": 4, "use_rle": 8, "hilbert": 16}
IMAGE_HEAD, CHANNEL_HEAD, PRECINCT_HEAD = "IIIIffffIII", "IBBxxii", "IBxHii"


class ByteReader:
    """A cursor over bytes: clamped seeks, typed reads that refuse to pass the end."""

    def __init__(self, raw: bytes):
        self.raw, self.at = bytes(raw), 0

    def seek(self, at: int) -> None:
        self.at = min(max(0, at), len(self.raw))

    def read(self, kind: str):
        values = struct.unpack_from("<" + kind, self.raw, self.at)
        self.at += struct.calcsize("<" + kind)
        return values if len(values) != 1 else values[0]

    def array(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out


def _thresholds(rate: int, precinct: int, n: int, p: Params) -> float:
    return p.threshold / rate * p.threshold_attenuation ** (n - precinct - 1)


def _symbols(v: np.ndarray, rate: int, t: float, p: Params) -> tuple[np.ndarray, bool]:
    """Symbols, and whether nothing was left above the dead zone."""
    v = np.nan_to_num(v, nan=0.0)
    f = np.maximum(0.0, np.abs(v) ** (1 / p.quantise_gamma) - t) / (1 - t)
    q = np.trunc(p.rounding + f * rate) * np.where(v < 0, -1, 1) + rate
    return np.clip(q, 0, MAX_SYMBOL).astype(np.int64), not f.any()


def _values(symbols: np.ndarray, rate: int, t: float, p: Params) -> np.ndarray:
    q = symbols - rate
    a = np.maximum(0.0, np.abs(q) - p.rounding) / rate
    a = np.where(q != 0, t * (1 - a) + a, a)
    return a**p.quantise_gamma * np.where(q < 0, -1, 1)


def _quadrants(plane: np.ndarray, precinct: int, side: int) -> list[np.ndarray]:
    h = 1 << (precinct - 1)
    return [plane[y : y + h, x : x + h] for k, _, y, x in precincts(side) if k == precinct]


def _token(rate: int, compat: bool) -> int:
    """The symbol that runs are made of: zero's, or (compat) the one below."""
    return rate - 1 if compat else rate


@lru_cache(maxsize=64)
def _curve(side: int, hilbert: bool) -> np.ndarray:
    """The cells of a quadrant in coding order."""
    return np.argsort(hilbert_order(side)) if hilbert else np.arange(side * side)


def _precinct_symbols(c: np.ndarray, k: int, rate: int, p: Params) -> tuple[np.ndarray, bool]:
    """The symbols of precinct k of the coefficients c in coding order, and whether nothing was left above the dead zone."""
    side, order = len(c), _curve(1 << (k - 1), p.hilbert)
    t = _thresholds(rate, k, side.bit_length(), p)
    symbols, empty = zip(*(_symbols(q.ravel()[order], rate, t, p) for q in _quadrants(c, k, side)), strict=True)
    return np.concatenate(symbols), all(empty)


def _place_precinct(c: np.ndarray, k: int, symbols: np.ndarray | None, rate: int, p: Params) -> None:
    """Write what symbols stand for into precinct k of the coefficients c; None: nothing was left."""
    side, h = len(c), 1 << (k - 1)
    order, t = _curve(h, p.hilbert), _thresholds(rate, k, side.bit_length(), p)
    for j, q in enumerate(_quadrants(c, k, side)):
        flat = np.zeros(h * h)
        if symbols is not None:
            flat[order] = _values(symbols[j * h * h : (j + 1) * h * h], rate, t, p)
        q[...] = flat.reshape(h, h)


def _pack_precinct(symbols: np.ndarray, empty: bool, rate: int, p: Params, compat: bool = False) -> bytes:
    if empty:
        return struct.pack("<" + PRECINCT_HEAD, PRECINCT_MAGIC, EMPTY, 0, 0, 0)
    literals, blocks, model = _modelled(symbols, rate, p, compat)
    return _precinct_bytes(model, blocks, entropy.arith_encode(literals, model) if model else b"")


def _modelled(symbols: np.ndarray, rate: int, p: Params, compat: bool = False) -> tuple[np.ndarray, list[int], list[tuple[int, int, int]]]:
    """The symbols that are coded, the block table of those that are not, and the model."""
    literals, blocks = rle.encode(symbols, _token(rate, compat), 32) if p.use_rle else (symbols, [])
    return literals, blocks, entropy.build_model(literals) if len(literals) else []


def _precinct_bytes(model: list[tuple[int, int, int]], blocks: list[int], code: bytes) -> bytes:
    head = struct.pack("<" + PRECINCT_HEAD, PRECINCT_MAGIC, 0, len(model), len(code), len(blocks))
    return b"".join([head, *(struct.pack("<HI", s, share) for s, share, _ in model), np.array(blocks, "<u2").tobytes(), code])


def _read_precinct(r: ByteReader) -> tuple[list[tuple[int, int, int]], list[int], bytes] | None:
    """Model, block table and code, or None where nothing was left."""
    magic, flags, n_model, n_code, n_blocks = r.read(PRECINCT_HEAD)
    if magic != PRECINCT_MAGIC:
        raise ValueError("not a precinct")
    if flags & EMPTY:
        return None
    model, total = [], 0
    for _ in range(n_model):
        s, share = r.read("HI")
        total += share
        model.append((s, share, total))
    return model, r.array("<u2", n_blocks).tolist(), r.array("u1", n_code).tobytes()


def _from_literals(literals: np.ndarray, blocks: list[int], k: int, rate: int, compat: bool = False) -> np.ndarray:
    symbols = rle.decode(literals, _token(rate, compat), blocks)
    if len(symbols) != 3 << 2 * (k - 1):
        raise ValueError("precinct has a wrong number of symbols")
    return symbols


def _unpack_precinct(r: ByteReader, k: int, rate: int, compat: bool = False) -> np.ndarray | None:
    """The symbols of a coded precinct, or None where nothing was left."""
    parts = _read_precinct(r)
    if parts is None:
        return None
    model, blocks, code = parts
    return _from_literals(entropy.arith_decode(code, model) if model else np.empty(0, np.int64), blocks, k, rate, compat)


def _uncoded(c: np.ndarray, first: int) -> np.ndarray:
    """The average and the precincts below the first coded one, as they are stored."""
    side = len(c)
    return np.concatenate([c[:1, 0]] + [q.ravel() for k in range(1, min(first, side.bit_length())) for q in _quadrants(c, k, side)])


def _with_uncoded(raw: np.ndarray, side: int, first: int) -> np.ndarray:
    """Coefficients that hold the uncoded values, and zeros else."""
    c = np.zeros((side, side))
    c[0, 0], at = raw[0], 1
    for k in range(1, min(first, side.bit_length())):
        for q in _quadrants(c, k, side):
            q[...] = raw[at : at + q.size].reshape(q.shape)
            at += q.size
    return c


def _channel_parts(c: np.ndarray, norms: np.ndarray, table: list[int], p: Params, ieee: bool = True) -> tuple[bytes, bytes, bytes, bytes]:
    """What precedes the coded precincts: header, uncoded values, rates, norms."""
    raw = _uncoded(c, p.min_compressed_precinct)
    head = struct.pack("<" + CHANNEL_HEAD, CHANNEL_MAGIC, len(c).bit_length(), min(p.min_compressed_precinct, 255), len(raw), len(norms))
    return head, to_half_bits(raw, ieee).tobytes(), np.array(table, "<i4").tobytes(), norms.astype("<f4").tobytes()


def encode_channel(plane: np.ndarray, luma: bool, p: Params, compat: bool = False, ieee: bool = True) -> bytes:
    table = rates(len(plane), p, luma)
    coefficients, norms = normalised_forward(plane[None], log_space=p.log_space)
    coded = (_pack_precinct(*_precinct_symbols(coefficients[0], k, table[k], p), table[k], p, compat) for k in range(p.min_compressed_precinct, len(table)))
    return b"".join([*_channel_parts(coefficients[0], norms[0], table, p, ieee), *coded])


def decode_channel(r: ByteReader, side: int, p: Params, compat: bool = False, ieee: bool = True) -> np.ndarray:
    magic, n, first, n_raw, n_norms = r.read(CHANNEL_HEAD)
    if magic != CHANNEL_MAGIC or n != side.bit_length() or n_norms != n - 1 or n_raw < 1:
        raise ValueError("not a channel")
    raw, table = from_half_bits(r.array("<u2", n_raw), ieee).astype(float), r.array("<i4", n).tolist()
    norms = r.array("<f4", n_norms).astype(float)
    c = _with_uncoded(raw, side, first)
    for k in range(first, n):
        _place_precinct(c, k, _unpack_precinct(r, k, table[k], compat), table[k], p)
    return normalised_inverse(c[None], norms[None], log_space=p.log_space)[0]


def _check_side(side: int) -> None:
    if side & (side - 1) or side < 8:
        raise ValueError("images must have 3 channels and be square, their side a power of two of 8 or more")


def _to_yuv(rgb: np.ndarray, p: Params) -> np.ndarray:
    _check_side(rgb.shape[1] if rgb.shape == (3, rgb.shape[1], rgb.shape[1]) else 0)
    x = rgb if p.image_gamma == 1 else np.sign(rgb) * np.abs(rgb) ** (1 / p.image_gamma)
    return np.tensordot(np.array(RGB_TO_YUV), x, 1)


def _to_rgb(yuv: np.ndarray, p: Params) -> np.ndarray:
    x = np.tensordot(np.array(YUV_TO_RGB), yuv, 1)
    return x if p.image_gamma == 1 else np.sign(x) * np.abs(x) ** p.image_gamma


def _image_head(side: int, p: Params) -> bytes:
    flags = p.use_rle * FLAGS["use_rle"] + p.hilbert * FLAGS["hilbert"]
    return struct.pack("<" + IMAGE_HEAD, IMAGE_MAGIC, side, side, 3, p.image_gamma, p.quantise_gamma, p.quality, p.attenuation, flags, side.bit_length(), SYMBOL_BYTES)


def _image_tail(p: Params, compat: bool = False) -> bytes:
    tail = json.dumps(p.as_dict() | {"compat": compat}).encode()
    return tail + struct.pack("<I", len(tail))


def encode_image(rgb: np.ndarray, params: Params = Params(), compat: bool = False, bare: bool = False) -> bytes:
    """The container of an image (3, side, side) with a power of two of 8 or more as side.

    ``bare``: without its parameters appended; together with ``compat`` also with truncated halves.
    """
    p = params.clean()
    yuv = _to_yuv(rgb, p)
    body = _image_head(rgb.shape[1], p) + b"".join(encode_channel(yuv[k], k == 0, p, compat, not (compat and bare)) for k in range(3))
    return body if bare else body + _image_tail(p, compat)


def _appended(raw: bytes) -> dict | None:
    """The parameters at the end of a container, or None where there are none."""
    size = struct.unpack("<I", raw[-4:])[0] if len(raw) >= 4 else 0
    tail = raw[-4 - size : -4] if 0 < size <= len(raw) - 4 else b""
    if not (tail.startswith(b"{") and tail.endswith(b"}")):
        return None
    try:
        return json.loads(tail)
    except ValueError:
        return None


def read_header(raw: bytes, params: Params = Params(), compat: bool = False) -> tuple[int, Params, bool, ByteReader]:
    """(side, parameters, compat, a cursor at the first channel); refuses what is no container.

    ``params`` and ``compat`` are for containers without parameters of their own;
    what the header holds comes from there.
    """
    r = ByteReader(raw)
    magic, w, h, channels, gamma, quantise_gamma, quality, attenuation, flags, n, symbol = r.read(IMAGE_HEAD)
    if magic != IMAGE_MAGIC or channels != 3 or symbol != SYMBOL_BYTES or w != h or n != w.bit_length():
        raise ValueError("not an image container")
    options = _appended(raw)
    if options is not None:
        compat = options.pop("compat")
        return w, Params(**options), compat, r
    known = {"image_gamma": gamma, "quantise_gamma": quantise_gamma, "quality": quality, "attenuation": attenuation}
    return w, replace(params, **known, use_rle=bool(flags & FLAGS["use_rle"]), hilbert=bool(flags & FLAGS["hilbert"])), compat, r


def decode_image(raw: bytes, params: Params = Params(), compat: bool = False) -> np.ndarray:
    side, p, compat, r = read_header(raw, params, compat)
    ieee = not compat or _appended(raw) is not None
    return _to_rgb(np.stack([decode_channel(r, side, p, compat, ieee) for _ in range(3)]), p)


@dataclass(frozen=True)
class Plan:
    """What parameters mean for images of a side.

    ``key``: the rates of the coded precincts, finest first, of luma and chroma.
    ``others``: all parameters but quality and attenuation. Both and the image
    fix what is coded. ``end_bytes``: the container's header and parameters.
    """

    params: Params
    key: tuple[tuple[int, ...], tuple[int, ...]]
    others: tuple
    end_bytes: int


def plan(side: int, params: Params) -> Plan | ValueError:
    """The plan, or what prevents it."""
    p = params.clean()
    try:
        _check_side(side)
        key = tuple(tuple(rates(side, p, luma)[: p.min_compressed_precinct - 1 : -1]) for luma in (True, False))
    except ValueError as e:
        return e
    others = tuple(v for name, v in p.as_dict().items() if name not in ("quality", "attenuation"))
    return Plan(p, key, others, len(_image_head(side, p)) + len(_image_tail(p)))


class Recoder:
    """One image coded and decoded at parameters that differ in quality and attenuation only.

    A precinct's code depends on its coefficients and its rate, so a rate that
    returns is not coded again: of each channel the decoded coefficients are kept,
    and only precincts whose rate has changed are written. Figures are kept by
    the rates of all coded precincts. Held are a few planes and numbers, no codes.
    """

    def __init__(self, rgb: np.ndarray, params: Params):
        self.rgb, self.params = rgb, params
        self.first, self.n = self.params.min_compressed_precinct, rgb.shape[1].bit_length()
        self.coefficients, norms = normalised_forward(_to_yuv(rgb, self.params), log_space=self.params.log_space)
        blank = [0] * self.n
        parts = [_channel_parts(c, v, blank, self.params) for c, v in zip(self.coefficients, norms, strict=True)]
        self.head_bytes, self.norms = sum(len(x) for part in parts for x in part), norms.astype("<f4").astype(float)
        raw = [from_half_bits(np.frombuffer(part[1], "<u2")).astype(float) for part in parts]
        self.decoded = [_with_uncoded(v, rgb.shape[1], self.first) for v in raw]
        self.placed: list[dict[int, int]] = [{}, {}, {}]
        self.sizes: dict[tuple[int, int, int], int] = {}
        self.planes: dict[tuple, np.ndarray] = {}
        self.figures: dict[tuple, tuple[dict, int] | ValueError] = {}

    def _code(self, channel: int, k: int, rate: int) -> None:
        """Code precinct k and read it back, unless that was done at this rate, and place what it decodes to."""
        symbols, empty = _precinct_symbols(self.coefficients[channel], k, rate, self.params)
        if (channel, k, rate) not in self.sizes:
            raw = _pack_precinct(symbols, empty, rate, self.params)
            back = _unpack_precinct(ByteReader(raw), k, rate)
            if (back is None) != empty or not (empty or np.array_equal(back, symbols)):
                raise ValueError("a precinct does not decode to its symbols")
            self.sizes[channel, k, rate] = len(raw)
        _place_precinct(self.decoded[channel], k, None if empty else symbols, rate, self.params)
        self.placed[channel][k] = rate

    def _at(self, key: tuple) -> Iterator[tuple[int, int, int]]:
        """(channel, precinct, rate) of all coded precincts."""
        return ((channel, k, rate) for channel in range(3) for k, rate in zip(range(self.n - 1, self.first - 1, -1), key[min(channel, 1)], strict=True))

    def uncoded(self, plans: list[Plan]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        """(channel, precinct, rate) that the plans need, have not been coded and are not empty, with their symbols."""
        for at in dict.fromkeys(at for key in dict.fromkeys(x.key for x in plans) for at in self._at(key)):
            if at not in self.sizes:
                symbols, empty = _precinct_symbols(self.coefficients[at[0]], *at[1:], self.params)
                if not empty:
                    yield at, symbols

    def _coded(self, key: tuple) -> dict[tuple, np.ndarray]:
        """(channel, rates) and decoded coefficients of the channels that have no plane at these rates."""
        out = {}
        for channel in range(3):
            table = key[min(channel, 1)]
            if (channel, table) not in self.planes:
                for k, rate in zip(range(self.n - 1, self.first - 1, -1), table, strict=True):
                    if self.placed[channel].get(k) != rate:
                        self._code(channel, k, rate)
                out[channel, table] = self.decoded[channel].copy()
        return out

    def _find(self, keys: list[tuple]) -> None:
        """Figures of some keys, whose planes are decoded at once."""
        new, fine = {}, []
        for key in keys:
            try:
                new |= self._coded(key)
                fine.append(key)
            except ValueError as e:
                self.figures[key] = e
        if new:
            back = normalised_inverse(np.stack(list(new.values())), self.norms[[channel for channel, _ in new]], log_space=self.params.log_space)
            self.planes |= dict(zip(new, back, strict=True))
        for key in fine:
            yuv = np.stack([self.planes[channel, key[min(channel, 1)]] for channel in range(3)])
            codes = sum(self.sizes[at] for at in self._at(key))
            self.figures[key] = fidelity(_to_rgb(yuv, self.params), self.rgb), self.head_bytes + codes
        kept = {(channel, key[min(channel, 1)]) for key in fine for channel in range(3)}
        self.planes = {k: v for k, v in self.planes.items() if k in kept}

    def stats(self, plans: list[Plan]) -> Iterator[dict | ValueError]:
        """For each plan ``metrics.stats`` of what ``encode_image`` and ``decode_image`` make of the image, or what prevents it."""
        keys = [k for k in dict.fromkeys(x.key for x in plans) if k not in self.figures]
        step = max(1, PLANES_BYTES // self.coefficients.nbytes)
        for at in range(0, len(keys), step):
            self._find(keys[at : at + step])
        for x in plans:
            got = self.figures[x.key]
            yield got if isinstance(got, ValueError) else size_stats(self.rgb, x.end_bytes + got[1], got[0])


def code_ahead(images: list[tuple[Recoder, list[Plan]]]) -> None:
    """Code the precincts of several images at their plans' rates and read them back, a bounded number side by side.

    What can't be coded is left to the image's own ``Recoder``, which says why.
    """
    found = ((r, at, symbols) for r, plans in images for at, symbols in r.uncoded(plans))
    while some := _cells(found, entropy.CELLS):
        able = []
        for r, at, symbols in some:
            try:
                able.append((r, at, symbols, *_modelled(symbols, at[2], r.params)))
            except ValueError:
                continue
        codes = entropy.encode_all([x[3] for x in able], [x[5] for x in able])
        raws = [_precinct_bytes(x[5], x[4], code) for x, code in zip(able, codes, strict=True)]
        models, blocks, codes = zip(*(_read_precinct(ByteReader(raw)) for raw in raws), strict=True) if raws else ((), (), ())
        for (r, at, symbols, *_), raw, literals, table in zip(able, raws, entropy.decode_all(codes, models), blocks, strict=True):
            if np.array_equal(_from_literals(literals, table, *at[1:]), symbols):
                r.sizes[at] = len(raw)


def _cells(found: Iterator[tuple], most: int) -> list[tuple]:
    """The next of (.., symbols) until they have ``most`` symbols together."""
    out, n = [], 0
    for x in found:
        out.append(x)
        n += len(x[-1])
        if n >= most:
            break
    return out


def raw_values(raw: bytes) -> list[np.ndarray]:
    """The values that each channel holds uncoded, in their order."""
    _, _, _, r = read_header(raw)
    out = []
    for _ in range(3):
        _, n, first, n_raw, n_norms = r.read(CHANNEL_HEAD)
        out.append(from_half_bits(r.array("<u2", n_raw)))
        r.seek(r.at + 4 * n + 4 * n_norms)
        for _ in range(first, n):
            _, _, n_model, n_code, n_blocks = r.read(PRECINCT_HEAD)
            r.seek(r.at + 6 * n_model + 2 * n_blocks + n_code)
    return out


def sizes_of(raw: bytes) -> list[tuple[str, int | None, int | None, int]]:
    """(part, channel, precinct, bytes) of everything in a container; the bytes add up to its length."""
    side, _, _, r = read_header(raw)
    out = [("image header", None, None, r.at)]

    def take(part: str, channel: int, precinct: int | None, n: int) -> None:
        out.append((part, channel, precinct, n))

    for c in range(3):
        _, n, first, n_raw, n_norms = r.read(CHANNEL_HEAD)
        take("channel header", c, None, struct.calcsize("<" + CHANNEL_HEAD))
        for part, size in (("raw", 2 * n_raw), ("rates", 4 * n), ("norms", 4 * n_norms)):
            take(part, c, None, size)
            r.seek(r.at + size)
        for k in range(first, n):
            _, _, n_model, n_code, n_blocks = r.read(PRECINCT_HEAD)
            take("precinct header", c, k, struct.calcsize("<" + PRECINCT_HEAD))
            for part, size in (("model", 6 * n_model), ("blocks", 2 * n_blocks), ("code", n_code)):
                take(part, c, k, size)
                r.seek(r.at + size)
    return [*out, ("parameters", None, None, len(raw) - r.at)]


def with_flags(params: Params, flags: int) -> tuple[Params, dict[str, bool]]:
    """Parameters with the encoder's flags added to what is on already, and which of the other flags are set."""
    on = {name: bool(flags & bit) for name, bit in FLAGS.items()}
    changed = replace(params, use_rle=params.use_rle or on.pop("use_rle"), hilbert=params.hilbert or on.pop("hilbert"))
    return changed, {k: v for k, v in on.items() if k in ("verbose", "wavelet_out", "debug_coder")}


# -- DataFrames


def images(planes: DataFrame) -> DataFrame:
    """image_id, side, pixels (channel after channel) of the planes of complete images."""
    parts = F.array_sort(F.collect_list(F.struct("c", "side", "plane")))
    got = planes.groupBy("image_id").agg(parts.alias("p")).filter(F.size("p") == 3)
    return got.select("image_id", F.col("p")[0]["side"].alias("side"), F.flatten(F.transform("p", lambda x: x["plane"])).alias("pixels"))


def _cube(pixels, side: int) -> np.ndarray:
    return np.asarray(pixels, float).reshape(3, side, side)


def encode(image_rows: DataFrame, params: Params = Params(), compat: bool = False, bare: bool = False) -> DataFrame:
    """image_id, container, error: a row that can't be coded has its reason and no container."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, side, pixels in batch[["image_id", "side", "pixels"]].itertuples(index=False):
                try:
                    row = (i, encode_image(_cube(pixels, side), params, compat, bare), None)
                except ValueError as e:
                    row = (i, None, str(e))
                yield pd.DataFrame([row], columns=["image_id", "container", "error"])

    return image_rows.mapInPandas(run, "image_id bigint, container binary, error string")


def sizes(containers: DataFrame) -> DataFrame:
    """image_id, part, channel, precinct, n_bytes of (image_id, container): what each part of a container takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, raw in batch[["image_id", "container"]].itertuples(index=False):
                frame = pd.DataFrame([(i, *row) for row in sizes_of(bytes(raw))], columns=["image_id", "part", "channel", "precinct", "n_bytes"])
                yield frame.astype({"channel": "Int32", "precinct": "Int32"})

    return containers.filter("container is not null").mapInPandas(run, "image_id bigint, part string, channel int, precinct int, n_bytes bigint")


def decode(containers: DataFrame, params: Params = Params(), compat: bool = False) -> DataFrame:
    """image_id, side, pixels, error of (image_id, container); ``params`` and ``compat`` for containers without parameters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, raw in batch[["image_id", "container"]].itertuples(index=False):
                try:
                    rgb = decode_image(bytes(raw or b""), params, compat)
                    row = (i, rgb.shape[1], rgb.ravel(), None)
                except (ValueError, struct.error) as e:
                    row = (i, None, None, str(e))
                yield pd.DataFrame([row], columns=["image_id", "side", "pixels", "error"]).astype({"side": "Int32"})

    return containers.mapInPandas(run, "image_id bigint, side int, pixels array<double>, error string")


def wavelet_only(planes: DataFrame, family: str = "cdf97") -> DataFrame:
    """Planes to plain, not normalised coefficients, channel by channel."""
    from .wavelets import forward_planes, map_planes

    return map_planes(planes, lambda p: forward_planes(p, family))


#: Tasks that share an image's points, and the largest side of images that one task codes at all points.
POINT_GROUPS, ALONE = 8, 64
#: Images that a task of a sweep codes side by side, in bytes, and rows that it packs at once.
HELD_BYTES, ROWS = 1 << 18, 4096


Point = tuple[int, float, float]


def deal_points(table: list[Point], side: int, base: Params, groups: int) -> list[list[tuple[Point, Plan | ValueError]]]:
    """Each group's points (iter, quality, attenuation) with their plans: those that code alike together, in the order of their rates."""
    plans = [(point, plan(side, replace(base, quality=point[1], attenuation=point[2]))) for point in table]
    key = lambda x: () if isinstance(x, ValueError) else x.key
    place = {k: j for j, k in enumerate(sorted({key(x) for _, x in plans}))}
    out = [[] for _ in range(groups)]
    for point, x in sorted(plans, key=lambda r: place[key(r[1])]):
        out[place[key(x)] * groups // len(place)].append((point, x))
    return out


Swept = Iterator[tuple[int, dict | ValueError]]


def _prepared(rgb: np.ndarray, wanted: list[tuple[int, Plan | ValueError]]) -> tuple[dict[int, ValueError], list[tuple[Recoder, list[tuple[int, Plan]]]]]:
    """What prevents some points (iter, plan) of an image, and the others: those that differ in their rates alone share a ``Recoder``."""
    errors = {k: x for k, x in wanted if isinstance(x, ValueError)}
    alike: dict[tuple, list[tuple[int, Plan]]] = {}
    for k, x in wanted:
        if k not in errors:
            alike.setdefault(x.others, []).append((k, x))
    out = []
    for some in alike.values():
        try:
            out.append((Recoder(rgb, some[0][1].params), some))
        except ValueError as e:
            errors |= {k: e for k, _ in some}
    return errors, out


def _figures(errors: dict[int, ValueError], recoders: list[tuple[Recoder, list[tuple[int, Plan]]]]) -> Swept:
    yield from errors.items()
    for recoder, some in recoders:
        yield from zip((k for k, _ in some), recoder.stats([x for _, x in some]), strict=True)


def _swept(rgb: np.ndarray, wanted: list[tuple[int, Plan | ValueError]]) -> Swept:
    """(iter, statistics or what prevented them) of an image by plans."""
    return _figures(*_prepared(rgb, wanted))


def _pieces(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while piece := list(islice(rows, size)):
        yield piece


def sweep(image_rows: DataFrame, points: DataFrame, base: Params = Params(), groups: int = POINT_GROUPS, on_init=None, on_complete=None) -> DataFrame:
    """Code every image at every point (iter, quality, attenuation): statistics, one row each, or the error.

    ``on_init`` (parameters, iter) gives the parameters that are used instead;
    ``on_complete`` (statistics, iter) those that are returned. Both run in the tasks.

    The points are a bounded table, which is sent to all tasks; an image above
    ALONE is sent to ``groups`` of them, each of which codes it at its share of the points.
    """
    names, types = zip(*(f.split() for f in STATS.split(", ")), strict=True)
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *({"bigint": pa.int64(), "double": pa.float64()}[t] for t in types), pa.string()]
    table = sorted((r.iter, r.quality, r.attenuation) for r in points.collect())
    groups = max(1, min(groups, len(table)))

    def planned(side: int, point: Point) -> Plan | ValueError:
        k, q, a = point
        try:
            return plan(side, on_init(replace(base, quality=q, attenuation=a), k))
        except ValueError as e:
            return e

    def completed(s: dict | ValueError, k: int) -> dict | ValueError:
        try:
            return s if isinstance(s, ValueError) else on_complete(s, k)
        except ValueError as e:
            return e

    def swept(held: list[tuple]) -> Iterator[tuple]:
        """Rows of some images (image_id, side, pixels, points with their plans)."""
        images = []
        for i, side, pixels, share in held:
            wanted = [(point[0], planned(side, point) if on_init else x) for point, x in share]
            try:
                images.append((i, share, *_prepared(_cube(pixels, side), wanted)))
            except ValueError as e:
                images.append((i, share, {k: e for k, _ in wanted}, []))
        code_ahead([(r, [x for _, x in some]) for *_, recoders in images for r, some in recoders if len(r.rgb[0]) <= ALONE])
        none = (None,) * len(names)
        for i, share, *prepared in images:
            try:
                found = dict(_figures(*prepared))
            except ValueError as e:
                found = {point[0]: e for point, _ in share}
            if on_complete:
                found = {k: completed(s, k) for k, s in sorted(found.items())}
            for point, _ in share:
                s = found[point[0]]
                yield (i, *point, *none, str(s)) if isinstance(s, ValueError) else (i, *point, *(s[n] for n in names), None)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        # As from pandas: a figure that is no number is null.
        return pa.RecordBatch.from_arrays([pa.array(x, t, from_pandas=True) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", "iter", "quality", "attenuation", *names, "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt_by_side, held, n_bytes = {}, [], 0
        for batch in batches:
            for i, side, pixels, group in zip(*(batch.column(c).to_pylist() if c != "pixels" else batch.column(c) for c in ("image_id", "side", "pixels", "group")), strict=True):
                if side not in dealt_by_side:
                    dealt_by_side[side] = deal_points(table, side, base, 1 if side <= ALONE else groups)
                held.append((i, side, pixels.values, dealt_by_side[side][group]))
                n_bytes += 8 * len(pixels.values if pixels.values is not None else ())
                if n_bytes >= HELD_BYTES:
                    yield from map(packed, _pieces(swept(held), ROWS))
                    held, n_bytes = [], 0
        if held:
            yield from map(packed, _pieces(swept(held), ROWS))

    shares = F.when(F.col("side") <= ALONE, 1).otherwise(groups)
    dealt = image_rows.select("image_id", "side", "pixels", F.explode(F.sequence(F.lit(0), shares - 1)).alias("group"))
    parts = int(image_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts).mapInArrow(run, f"image_id bigint, iter int, quality double, attenuation double, {STATS}, error string")


def codec_stats(image_rows: DataFrame, params: Params = Params()) -> DataFrame:
    point = image_rows.sparkSession.createDataFrame([(0, params.quality, params.attenuation)], "iter int, quality double, attenuation double")
    return sweep(image_rows, point, params)
