"""Scalar functions as Spark column expressions: interpolation, 32-bit hashes, bit strings, paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 32) - 1
#: 32-bit Fowler-Noll-Vo offset and prime, the ordered 4 x 4 dither matrix, named constants.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
DITHER = [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]
CONSTANTS = {
    "pi": math.pi, "two_pi": 2 * math.pi, "four_pi": 4 * math.pi, "half_pi": math.pi / 2, "root_2": math.sqrt(2),
    "phi": (1 + math.sqrt(5)) / 2, "inv_phi": 2 / (1 + math.sqrt(5)), "ln_2": math.log(2), "float_max": 3.4028234663852886e38,
}


def _double(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


# -- arithmetic and interpolation


def sign(x: Column) -> Column:
    """1 for zero and above, -1 below (so never 0)."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def sqr(x: Column) -> Column:
    return x * x


def cub(x: Column) -> Column:
    return x * x * x


def pow4(x: Column) -> Column:
    return x * x * x * x


def comp_mod(a: Column, b) -> Column:
    """The non-negative remainder."""
    return F.pmod(a, b if isinstance(b, Column) else F.lit(b))


def heaviside(edge, t: Column) -> Column:
    return (t > edge).cast("int").cast("double")


def clamp(x: Column, low, high) -> Column:
    """The lower bound is looked at first, also where it is above the upper one."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def saturate(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def fract(x: Column) -> Column:
    """Keeps the sign."""
    return x % 1.0


def mix(a, b, t) -> Column:
    return _double(a) * (1 - _double(t)) + _double(b) * _double(t)


def smoothstep(a, b=None, t: Column | None = None) -> Column:
    """From a to b along a cubic; with one argument, that value as it is."""
    return mix(0.0, 1.0, a) if t is None else mix(a, b, t * t * (3 - 2 * t))


def trig_interpolate(t: Column) -> Column:
    return F.cos(t * math.pi + math.pi) * 0.5 + 0.5


def trig_interpolate_exp(t: Column, exponent) -> Column:
    s = F.sin(F.pow(F.abs(t * 2 - 1), _double(exponent)) * (math.pi / 2))
    return F.when(t < 0.5, (1 - s) * 0.5).otherwise(s * 0.5 + 0.5)


def sigmoid_interpolate(t: Column, sigma: float) -> Column:
    logistic = lambda z: 1 / (1 + F.exp(-z))
    edge = logistic(F.lit(float(sigma)))
    return (logistic((t * 2 - 1) * float(sigma)) - edge) / (1 - 2 * edge)


# -- hashes of unsigned 32-bit values, held in bigint


def _fnv_step(h: Column, byte: Column) -> Column:
    return (h.bitwiseXOR(byte) * FNV_PRIME).bitwiseAND(F.lit(MASK))


def fnv1a_u32(x: Column) -> Column:
    """FNV-1a over the four bytes, lowest first."""
    h = F.lit(FNV_OFFSET).cast("bigint")
    for k in range(4):
        h = _fnv_step(h, F.shiftright(x.cast("bigint"), 8 * k).bitwiseAND(F.lit(255).cast("bigint")))
    return h


def utf8_bytes(text: Column) -> Column:
    """The bytes of the UTF-8 encoding as an array of 0 to 255."""
    pairs = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(pairs) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(pairs, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.expr("cast(array() as array<bigint>)"))


def fnv1a_text(text: Column, signed: bool = False) -> Column:
    """FNV-1a over UTF-8 bytes; ``signed`` widens bytes of 128 and above with their sign, as a signed char type does."""
    wide = (lambda b: F.when(b > 127, b + (MASK - 255)).otherwise(b)) if signed else (lambda b: b)
    return F.aggregate(utf8_bytes(text), F.lit(FNV_OFFSET).cast("bigint"), lambda h, b: _fnv_step(h, wide(b)))


def _shl(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int")).bitwiseAND(F.lit(MASK))


def _shr(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n.cast("int"))


def hash_combine(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    ka, kb = a.bitwiseAND(F.lit(31).cast("bigint")), b.bitwiseAND(F.lit(31).cast("bigint"))
    left = _shl(a, 31 - kb).bitwiseOR(_shr(a, kb))
    right = _shl(b, ka).bitwiseOR(_shr(b, 31 - ka))
    return left.bitwiseXOR(right)


def hash_of(*parts: Column) -> Column:
    """FNV-1a of each part, combined from the last to the first."""
    out = fnv1a_u32(parts[-1])
    for p in reversed(parts[:-1]):
        out = hash_combine(fnv1a_u32(p), out)
    return out


def cast_bits(x: Column) -> Column:
    """The bits of a number's 32-bit float as an unsigned integer (NaN as the quiet one without sign)."""
    v = x.cast("float").cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    low = a < F.pow(F.lit(2.0), guess)
    high = a >= F.pow(F.lit(2.0), guess + 1)
    e = F.greatest(guess - low.cast("int") + high.cast("int"), F.lit(-127))
    normal = (e + 127) * (1 << 23) + (a * F.pow(F.lit(2.0), 23 - e)).cast("bigint") - (1 << 23)
    tiny = (a * 2.0**149).cast("bigint")
    size = F.when(F.isnan(v), 0x7FC00000).when(a == float("inf"), 0x7F800000).when(a < 2.0**-126, tiny).otherwise(normal)
    # 0 and -0 are equal; only their text tells them apart
    negative = ~F.isnan(v) & ((v < 0) | v.cast("string").startswith("-"))
    return (size + F.when(negative, 1 << 31).otherwise(0)).cast("bigint")


def hash_of_float(x: Column) -> Column:
    return fnv1a_u32(cast_bits(x))


def hash_combine_float(a: Column, b: Column) -> Column:
    return hash_combine(cast_bits(a), cast_bits(b))


def as_unit_float(h: Column) -> Column:
    return h.cast("double") / float(MASK)


def xor_hash8(text: Column) -> Column:
    """The first byte, exclusive-or each later byte plus 149, mod 256."""
    b = utf8_bytes(text)
    rest = F.aggregate(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), b[0], lambda h, x: h.bitwiseXOR((x + 149).bitwiseAND(F.lit(255).cast("bigint"))))
    return F.when(F.size(b) == 0, F.lit(0).cast("bigint")).otherwise(rest)


def xor_checksum(text: Column) -> Column:
    return F.aggregate(utf8_bytes(text), F.lit(0).cast("bigint"), lambda h, x: h.bitwiseXOR(x))


def ordered_dither(x: Column, y: Column) -> Column:
    cells = F.array(*(F.lit(float(v)) for v in DITHER))
    at = x.bitwiseAND(F.lit(3)) * 4 + y.bitwiseAND(F.lit(3))
    return (F.get(cells, at.cast("int")) + 0.5) / 16


def _mul32(a: Column, b: Column) -> Column:
    """The product mod 2^32 of two 32-bit values, without leaving 63 bits."""
    low = a.bitwiseAND(F.lit(65535).cast("bigint")) * b
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535).cast("bigint")), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


#: seeds' factors, and the linear congruential step.
PCG_SEED = [20219, 7243, 12547, 28573]
PCG_STEP = (1664525, 1013904223)


def pcg4(df: DataFrame, seed: str, draws: int = 1) -> DataFrame:
    """``df`` with u0 to u3, the state of a four-word generator after ``draws`` steps, and r0 to r3, it as 0 to 1."""
    names = ["u0", "u1", "u2", "u3"]
    df = df.withColumns({n: _mul32(F.col(seed).cast("bigint"), F.lit(k).cast("bigint")) for n, k in zip(names, PCG_SEED, strict=True)})
    stir = [("u0", "u1", "u3"), ("u1", "u2", "u0"), ("u2", "u0", "u1"), ("u3", "u1", "u2")]
    for _ in range(draws):
        df = df.withColumns({n: (_mul32(F.col(n), F.lit(PCG_STEP[0]).cast("bigint")) + PCG_STEP[1]).bitwiseAND(F.lit(MASK)) for n in names})
        for rows in (stir, None, stir):
            if rows is None:
                df = df.withColumns({n: F.col(n).bitwiseXOR(F.shiftright(F.col(n), 16)) for n in names})
            else:
                for out, a, b in rows:
                    df = df.withColumn(out, (F.col(out) + _mul32(F.col(a), F.col(b))).bitwiseAND(F.lit(MASK)))
    return df.withColumns({f"r{k}": as_unit_float(F.col(n)) for k, n in enumerate(names)})


# -- bits as text


def bit_string(x: Column, bits: int = 32) -> Column:
    """Highest bit first, a comma after each byte."""
    padded = F.lpad(F.bin(x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))), bits, "0")
    return F.regexp_replace(padded, r"(\d{8})(?=\d)", "$1,")


def bits_to_int(text: Column) -> Column:
    """The 32-bit value of a bit string, filled from the highest bit; other characters are skipped."""
    bits = F.substring(F.regexp_replace(text, "[^01]", ""), 1, 32)
    return F.conv(F.rpad(bits, 32, "0"), 2, 10).cast("bigint")


def packed_length(raw: Column) -> Column:
    """Bits up to the last one set in the last byte; a last byte of 0 counts nothing."""
    last = F.conv(F.substring(F.hex(raw), -2, 2), 16, 10).cast("int")
    tail = F.when(last == 0, 0).otherwise(8 - F.locate("1", F.reverse(F.bin(last))) + 1)
    return F.when(F.octet_length(raw) == 0, 0).otherwise(8 * (F.octet_length(raw) - 1) + tail)


def packed_bit_string(raw: Column, start: int = 0, end: int | None = None) -> Column:
    """The bits of bytes ``start`` to ``end``, highest first, up to the last one set in the whole; a comma before each byte but the first of all."""
    pairs = F.hex(raw)
    each = F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 1), lambda i: F.lpad(F.conv(F.substring(pairs, i * 2 + 1, F.lit(2)), 16, 2), 8, "0"))
    bits = F.substring(F.array_join(each, ""), F.lit(1), packed_length(raw))
    some = F.substring(bits, F.lit(8 * start + 1), F.lit(2**30 if end is None else 8 * (end - start)))
    commas = F.regexp_replace(some, r"([01]{8})(?=[01])", "$1,")
    return F.when(F.octet_length(raw) == 0, "").otherwise(F.concat(F.when(F.length(some) > 0, "," if start else "").otherwise(""), commas))


# -- paths


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def extension(path: Column) -> Column:
    """With its dot; empty where there is none."""
    return F.regexp_extract(filename(path), r".(\.[^.]*)$", 1)


def replace_extension(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(new))


def replace_filename(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"[^/\\]*$", ""), F.lit(new))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def parse_options(text: Column) -> Column:
    """``-k=v`` words to a map; a word without ``=`` has the empty value, of equal keys the last one counts."""
    words = F.filter(F.split(text, " "), lambda w: w.startswith("-"))
    pair = lambda w: F.struct(F.regexp_extract(w, "^-([^=]*)", 1).alias("k"), F.regexp_extract(w, "=(.*)$", 1).alias("v"))
    pairs = F.transform(words, pair)
    last = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"])
    return F.map_from_entries(F.filter(pairs, last))
