"""Frequency models (DataFrames and numpy) and an arithmetic coder.

A model gives each symbol a share of MASS; symbols are in order of falling share,
then rising symbol. The coder narrows a 32-bit interval and is sequential by nature:
it runs per stream in Arrow batches.
"""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASS = 65535
TOP = (1 << 32) - 1
HALF = 1 << 31


def frequencies(df: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """keys, symbol, n: counts, combined in each task first."""
    return df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("n"))


def model(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol, n, pmf, cmf of (keys, symbol, n).

    Shares start as n * MASS div total, at least 1; what they sum to beyond MASS
    is taken from shares above 1, what is missing is given to all, both by
    rounding along the running sum. Shares then sum to MASS, or MASS - 1 if some were missing.
    """
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.desc("p"), "symbol")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    trunc = lambda a, b: F.when(a >= 0, F.floor(a / b)).otherwise(F.ceil(a / b))
    m = counts.withColumn("total", F.sum("n").over(group))
    m = m.withColumn("p", F.greatest(F.lit(1), F.floor(F.col("n") * MASS / F.col("total"))).cast("bigint"))
    m = m.withColumns({"s": F.sum("p").over(group), "g": F.sum(F.when(F.col("p") > 1, F.col("p"))).over(group), "k": F.coalesce(F.sum("p").over(before), F.lit(0))})
    d, p, k = F.col("s") - MASS, F.col("p"), F.col("k")
    taken = trunc(1 + 2 * d * (k + p), 2 * F.col("g")) - trunc(1 + 2 * d * k, 2 * F.col("g"))
    given = trunc(1 + 2 * d * k, 2 * F.col("s")) - trunc(1 + 2 * d * (k + p), 2 * F.col("s"))
    m = m.withColumn("pmf", (p + F.when((d > 0) & (p > 1), -taken).when(d < 0, given).otherwise(0)).cast("bigint"))
    final = group.orderBy(F.desc("pmf"), "symbol").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(*keys, "symbol", "n", "pmf", F.sum("pmf").over(final).alias("cmf"))


def entropy(models: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entropy (bits a symbol of the shares), bits (of a plain code), n_symbols."""
    p = F.col("pmf") / float(MASS)
    out = models.groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"), F.count(F.lit(1)).alias("n_symbols"))
    return out.withColumn("bits", F.ceil(F.log2("n_symbols")).cast("int"))


def efficiency(coded_bits, n, entropy_bits, null_bits):
    """How much of what entropy allows to save was saved."""
    return (coded_bits - n * null_bits) / (n * entropy_bits - n * null_bits)


# -- one stream, in numpy and Python


def build_model(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, pmf, cmf) as ``model`` gives them."""
    values, n = np.unique(np.asarray(symbols, np.int64), return_counts=True)
    if len(values) >= MASS - 1:
        raise ValueError("too many distinct symbols")
    p = np.maximum(1, n * MASS // n.sum())
    order = np.lexsort((values, -p))
    values, p = values[order], p[order]
    s, g, k = int(p.sum()), int(p[p > 1].sum()), np.cumsum(p) - p
    d = s - MASS
    trunc = lambda a, b: np.sign(a) * (np.abs(a) // b)
    if d > 0:
        p = np.where(p > 1, p - (trunc(1 + 2 * d * (k + p), 2 * g) - trunc(1 + 2 * d * k, 2 * g)), p)
    elif d < 0:
        p = p + trunc(1 + 2 * d * k, 2 * s) - trunc(1 + 2 * d * (k + p), 2 * s)
    if (p < 1).any():
        raise ValueError("a share fell below 1")
    order = np.lexsort((values, -p))
    values, p = values[order], p[order]
    return list(zip(values.tolist(), p.tolist(), np.cumsum(p).tolist(), strict=True))


def arith_encode(symbols: np.ndarray, table: list[tuple[int, int, int]], window: tuple[int, int] | None = None, seen: list | None = None) -> bytes:
    """u32 length, then the code's bits, highest first, closed by a set bit. One symbol only: length and 0x80.

    For debugging, ``seen`` gets (index, symbol, low, high) of the symbols whose index lies in ``window``, ends included.
    """
    head = struct.pack("<I", len(symbols))
    if len(table) == 1:
        return head + b"\x80"
    spans = {s: (c - p, c) for s, p, c in table}
    low, high, pending, done, bits, n_bits = 0, TOP, 0, [head], 0, 0
    for index, s in enumerate(np.asarray(symbols).tolist()):
        a, b = spans[s]
        width = high - low
        low, high = low + (width * a >> 16), low + (width * b >> 16) - 1
        if window and window[0] <= index <= window[1]:
            seen.append((index, s, low, high))
        # The leading bits on which both ends agree are settled, with the bits that waited for the first of them.
        n = 32 - (low ^ high).bit_length()
        if n:
            settled = low >> (32 - n)
            if pending:
                first = settled >> (n - 1)
                bits = (bits << 1 | first) << pending | (0 if first else (1 << pending) - 1)
                bits, n_bits, pending = bits << (n - 1) | settled & (1 << (n - 1)) - 1, n_bits + n + pending, 0
            else:
                bits, n_bits = bits << n | settled, n_bits + n
            low, high = low << n & TOP, high << n & TOP | (1 << n) - 1
        # The ends now differ in their first bit; bits below it that are 1 in low and 0 in high wait.
        m = 31 - (~(low & ~high) & HALF - 1).bit_length()
        if m:
            pending, low, high = pending + m, low << m & HALF - 1, high << m & HALF - 1 | HALF | (1 << m) - 1
        if n_bits >= 512:
            rest = n_bits & 7
            done.append((bits >> rest).to_bytes(n_bits >> 3, "big"))
            bits, n_bits = bits & (1 << rest) - 1, rest
    # A point inside what is left: all later bits count as 0.
    for bit in _closing(low, high, pending):
        bits, n_bits = bits << 1 | bit, n_bits + 1
    n_bytes = n_bits + 7 >> 3
    return b"".join([*done, (bits << 8 * n_bytes - n_bits).to_bytes(n_bytes, "big")])


def _closing(low: int, high: int, pending: int) -> list[int]:
    """The shortest bits, the last one set, whose continuation with zeros lies in [low, high]."""
    for n in range(1, 33):
        unit = 1 << (32 - n)
        value = -(-low // unit) * unit
        while value <= high:
            if value // unit & 1:
                out = [value >> (31 - i) & 1 for i in range(n)]
                return out[:1] + [1 - out[0]] * pending + out[1:]
            value += unit
    raise AssertionError("the interval is empty")


def arith_decode(raw: bytes, table: list[tuple[int, int, int]]) -> np.ndarray:
    (n,) = struct.unpack_from("<I", raw)
    if len(table) == 1:
        return np.full(n, table[0][0])
    code, at = int.from_bytes(raw[4:8].ljust(4, b"\0"), "big"), 8
    # Bits that were read but not used; those beyond the end are 0.
    bits, n_bits, low, high, out = 0, 0, 0, TOP, []
    names, starts, stops = [s for s, _, _ in table], [c - p for _, p, c in table], [c for _, _, c in table]
    last = len(names) - 1
    for _ in range(n):
        width = high - low
        # The share interval that holds the code: its bounds as the encoder makes them.
        k = bisect_right(stops, ((code - low) << 16) // max(1, width))
        k = min(k, last)
        start, stop = low + (width * starts[k] >> 16), low + (width * stops[k] >> 16)
        while k > 0 and start > code:
            k, stop = k - 1, start
            start = low + (width * starts[k] >> 16)
        while k < last and stop <= code:
            k, start = k + 1, stop
            stop = low + (width * stops[k] >> 16)
        out.append(names[k])
        low, high = start, stop - 1
        # The encoder's two shifts: leading bits that agree, then those that wait.
        settled = 32 - (low ^ high).bit_length()
        gone = low >> (32 - settled)
        low, high = low << settled & TOP, high << settled & TOP | (1 << settled) - 1
        waits = 31 - (~(low & ~high) & HALF - 1).bit_length()
        low, high = low << waits & HALF - 1, high << waits & HALF - 1 | HALF | (1 << waits) - 1
        shift = settled + waits
        if shift:
            if n_bits < shift:
                bits, n_bits, at = bits << 64 | int.from_bytes(raw[at : at + 8].ljust(8, b"\0"), "big"), n_bits + 64, at + 8
            n_bits -= shift
            code = ((code << settled) - (gone << 32) << waits) - HALF * ((1 << waits) - 1) + (bits >> n_bits)
            bits &= (1 << n_bits) - 1
    return np.array(out, np.int64)


# -- many streams at once, in numpy

#: Fewer streams than this are coded one by one; cells (streams times the longest) that are coded at once.
MANY, CELLS = 24, 1 << 20


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1].astype(np.int64)


def _shifts(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of settled and of waiting bits, the settled ones, and the ends without them, as ``arith_encode`` has them."""
    n = 32 - _bit_length(low ^ high)
    settled = low >> (32 - n)
    low, high = low << n & TOP, high << n & TOP | (1 << n) - 1
    m = 31 - _bit_length(~(low & ~high) & HALF - 1)
    # Where nothing waits, high starts with a set bit and low does not.
    return n, m, settled, low << m & HALF - 1, high << m & HALF - 1 | HALF | (1 << m) - 1


def _chunks(lengths: list[int]) -> list[list[int]]:
    """Streams, the longest first, a bounded number of cells together."""
    out, order = [], sorted(range(len(lengths)), key=lambda j: -lengths[j])
    while order:
        step = max(1, CELLS // max(1, lengths[order[0]]))
        out.append(order[:step])
        order = order[step:]
    return out


def encode_all(streams: list[np.ndarray], tables: list[list[tuple[int, int, int]]]) -> list[bytes]:
    """``arith_encode`` of each stream with its model: one step codes a symbol of every stream."""
    out: list[bytes] = [b""] * len(streams)
    alone = [j for j, table in enumerate(tables) if len(table) == 1]
    several = [j for j, table in enumerate(tables) if len(table) > 1]
    for chunk in _chunks([len(streams[j]) for j in several]):
        chunk = [several[j] for j in chunk]
        if len(chunk) < MANY:
            alone += chunk
            continue
        lengths = np.array([len(streams[j]) for j in chunk])
        starts, stops = (np.zeros((lengths[0], len(chunk)), np.int64) for _ in range(2))
        for at, j in enumerate(chunk):
            names, share, stop = np.array(tables[j]).T
            order = np.argsort(names)
            found = order[np.searchsorted(names, streams[j], sorter=order)]
            starts[: lengths[at], at], stops[: lengths[at], at] = (stop - share)[found], stop[found]
        low, high, pending = np.zeros(len(chunk), np.int64), np.full(len(chunk), TOP), np.zeros(len(chunk), np.int64)
        # Of each step and stream: how many bits are settled, which, and how many waited for them.
        events = np.zeros((3, *starts.shape), np.int64)
        active = (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(1).tolist()
        for t, k in enumerate(active):
            a, width = low[:k], high[:k] - low[:k]
            n, m, settled, low[:k], high[:k] = _shifts(a + (width * starts[t, :k] >> 16), a + (width * stops[t, :k] >> 16) - 1)
            events[0, t, :k], events[1, t, :k], events[2, t, :k] = n, settled, np.where(n > 0, pending[:k], 0)
            pending[:k] = np.where(n > 0, 0, pending[:k]) + m
        for at, j in enumerate(chunk):
            n, settled, waited = events[:, : lengths[at], at][:, events[0, : lengths[at], at] > 0]
            total = n + waited
            event, place = np.repeat(np.arange(len(n)), total), np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            n, settled, waited = n[event], settled[event], waited[event]
            # The first settled bit, as many of the other kind as waited for it, the rest.
            first = settled >> (n - 1) & 1
            bits = np.where(place == 0, first, np.where(place <= waited, 1 - first, settled >> np.maximum(0, n - 1 - place + waited) & 1))
            bits = np.concatenate([bits, _closing(int(low[at]), int(high[at]), int(pending[at]))]).astype(np.uint8)
            out[j] = struct.pack("<I", lengths[at]) + np.packbits(bits).tobytes()
    for j in alone:
        out[j] = arith_encode(streams[j], tables[j])
    return out


def decode_all(raws: list[bytes], tables: list[list[tuple[int, int, int]]]) -> list[np.ndarray]:
    """``arith_decode`` of what ``encode_all`` made: one step reads a symbol of every stream."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(raws)
    alone = [j for j, table in enumerate(tables) if len(table) == 1]
    several = [j for j, table in enumerate(tables) if len(table) > 1]
    for chunk in _chunks([struct.unpack_from("<I", raws[j])[0] + len(tables[j]) for j in several]):
        chunk = [several[j] for j in chunk]
        if len(chunk) < MANY:
            alone += chunk
            continue
        chunk.sort(key=lambda j: -struct.unpack_from("<I", raws[j])[0])
        lengths = np.array([struct.unpack_from("<I", raws[j])[0] for j in chunk])
        most, longest = max(len(tables[j]) for j in chunk), max(len(raws[j]) for j in chunk)
        names, starts = np.zeros((len(chunk), most), np.int64), np.full((len(chunk), most + 1), 1 << 17)
        data = np.zeros((len(chunk), longest + 16), np.uint64)
        for at, j in enumerate(chunk):
            name, share, stop = np.array(tables[j]).T
            names[at, : len(name)], starts[at, : len(name)], starts[at, len(name)] = name, stop - share, stop[-1]
            data[at, : len(raws[j]) - 4] = np.frombuffer(raws[j], np.uint8, offset=4)
        row, found = np.arange(len(chunk)), np.zeros((lengths[0], len(chunk)), np.int64)
        low, high, at_bit = np.zeros(len(chunk), np.int64), np.full(len(chunk), TOP), np.full(len(chunk), 32)
        code = (data[:, 0] << 24 | data[:, 1] << 16 | data[:, 2] << 8 | data[:, 3]).astype(np.int64)
        last = np.array([len(tables[j]) - 1 for j in chunk])
        active = (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(1).tolist()
        for t, k in enumerate(active):
            a, width, r = low[:k], high[:k] - low[:k], row[:k]
            bounds = a[:, None] + (width[:, None] * starts[:k] >> 16)
            at = np.clip((bounds <= code[:k, None]).sum(1) - 1, 0, last[:k])
            found[t, :k] = names[r, at]
            n, m, settled, low[:k], high[:k] = _shifts(bounds[r, at], bounds[r, at + 1] - 1)
            byte, window = at_bit[:k] >> 3, np.zeros(k, np.uint64)
            for step in range(8):
                window = window << 8 | data[r, np.minimum(byte + step, longest + 15)]
            skipped, shift = (at_bit[:k] & 7).astype(np.uint64), (n + m).astype(np.uint64)
            fresh = np.where(shift > 0, window << skipped >> np.minimum(63, 64 - shift), 0).astype(np.int64)
            code[:k] = ((code[:k] << n) - (settled << 32) << m) - HALF * ((1 << m) - 1) + fresh
            at_bit[:k] += n + m
        for at, j in enumerate(chunk):
            out[j] = found[: lengths[at], at]
    for j in alone:
        out[j] = arith_decode(raws[j], tables[j])
    return out
