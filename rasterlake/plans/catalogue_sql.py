"""DuckDB equivalents of the catalogue's queries, written from the definitions, not from the Spark code."""

from __future__ import annotations

import math

_EV = """
ev as (
  select event_id // 768 as image_id, ((event_id % 768) // 3) // 16 as y, ((event_id % 768) // 3) % 16 as x, event_id % 3 as c,
    value as v, cast(round(value * 100) as bigint) as cents
  from events where event_id // 768 < (select (max(event_id) + 1) // 768 from events)
)"""
_ALL = _EV.replace(" where event_id // 768 < (select (max(event_id) + 1) // 768 from events)", "")
_PX = """
px as (
  select image_id, y, x, max(case when c = 0 then v end) as v0, max(case when c = 1 then v end) as v1, max(case when c = 2 then v end) as v2
  from ev group by all
)"""
_YUV = """
yuv as (
  select image_id, y, x, v0 * 0.299::double + v1 * 0.587::double + v2 * 0.114::double as v0,
    v0 * -0.14713::double + v1 * -0.28886::double + v2 * 0.436::double as v1, v0 * 0.615::double + v1 * -0.51499::double + v2 * -0.10001::double as v2 from px
)"""
_RGB = """select image_id, y, x, v0 + v2 * 1.13983::double as r, v0 + v1 * -0.394565::double + v2 * -0.5806::double as g, v0 + v1 * 2.03211::double as b from {}"""
_EMB = """
emb as (select vec_id as image_id, unnest(range(0, 64)) as i, unnest(embedding)::double as v from embeddings)"""
_SYM = """
sym as (
  select image_id, i, v, cast(least(greatest(trunc(greatest(0.0, abs(v) - 0.5 / 12) / (1 - 0.5 / 12) * 12) * (case when v < 0 then -1 else 1 end) + 12, 0), 65535) as bigint) as symbol
  from emb
)"""
_DEQ = "(case when symbol = 12 then 0.0 else (0.5 / 12 * (1 - abs(symbol - 12) / 12.0) + abs(symbol - 12) / 12.0) * (case when symbol < 12 then -1 else 1 end) end)"
_STREAMS = "st as (select event_id // 256 as stream, event_id % 256 as pos, event_type as symbol from events)"

#: Filter taps (first offset, low, high, low back, high back) of the published wavelets.
_TAPS = {
    "haar": (0, "[0.5, 0.5]", "[0.5, -0.5]", "[0.5, 0.5]", "[0.5, -0.5]"),
    "d4": (-1, *(["[(1+sqrt(3))/8, (3+sqrt(3))/8, (3-sqrt(3))/8, (1-sqrt(3))/8]", "[(1-sqrt(3))/8, -(3-sqrt(3))/8, (3+sqrt(3))/8, -(1+sqrt(3))/8]"] * 2)),
    "cdf53": (-2, "[0, 0.25, 0.5, 0.25, 0, 0]", "[0, -0.125, -0.25, 0.75, -0.25, -0.125]", "[-0.125, 0.25, 0.75, 0.25, -0.125, 0]", "[0, 0, -0.25, 0.5, -0.25, 0]"),
    "cdf97": (
        -4,
        "[0.026748757411, -0.016864118443, -0.078223266529, 0.266864118443, 0.602949018236, 0.266864118443, -0.078223266529, -0.016864118443, 0.026748757411, 0]",
        "[0, 0, 0.091271763114, -0.057543526229, -0.591271763114, 1.11508705, -0.591271763114, -0.057543526229, 0.091271763114, 0]",
        "[0, -0.091271763114/2, -0.057543526229/2, 0.591271763114/2, 1.11508705/2, 0.591271763114/2, -0.057543526229/2, -0.091271763114/2, 0, 0]",
        "[0, 0.026748757411/2, 0.016864118443/2, -0.078223266529/2, -0.266864118443/2, 0.602949018236/2, -0.266864118443/2, -0.078223266529/2, 0.016864118443/2, 0.026748757411/2]",
    ),
}


def _matrix(family: str, n: int, name: str) -> str:
    """A table (i, p, w): output i takes w times the sample at p, positions folded at the edges."""
    first, low, high, *_ = _TAPS[family]
    return f"""{name}_t as (
  select j, k, 2 * j + {first} + k as q, ({low}::double[])[k + 1] as lo, ({high}::double[])[k + 1] as hi
  from range(0, {n // 2}) a(j), range(0, len({low})) b(k)
), {name}_f as (select j, case when q < 0 then -q when q >= {n - 1} then 2 * {n - 1} - q else q end as p, lo, hi from {name}_t
), {name} as (
  select i, p, sum(w) as w from (select j as i, p, lo as w from {name}_f union all select j + {n // 2}, p, hi from {name}_f) group by i, p
)"""


def _inverse_matrix(family: str, n: int, name: str) -> str:
    first, _, _, low, high = _TAPS[family]
    taps = {"haar": 2, "d4": 4, "cdf53": 6, "cdf97": 10}[family]
    b0, b1, h = int(-(first + taps - 1) / 2), int(-(first - 1) / 2), n // 2
    return f"""{name}_t as (
  select 2 * i + s as r, i + b as q, s - 2 * b - ({first}) as k
  from range(0, {h}) x(i), range(0, 2) y(s), range({b0}, {b1 + 1}) z(b) where s - 2 * b - ({first}) between 0 and {taps - 1}
), {name} as (
  select r as i, p, sum(w) as w from (
    select r, case when q < 0 then -q when q > {h - 1} then 1 + 2 * {h - 1} - q else q end as p, 2 * ({low}::double[])[k + 1] as w from {name}_t
    union all
    select r, {h} + case when q < 0 then -q - 1 when q > {h - 1} then 2 * {h - 1} - q else q end, 2 * ({high}::double[])[k + 1] from {name}_t
  ) group by r, p
)"""


def _one_d(family: str, back: bool) -> str:
    m = (_inverse_matrix if back else _matrix)(family, 64, "m")
    return f"with {_EMB}, {m} select image_id as vec_id, m.i, round(sum(w * v), 6) as v from m join emb on emb.i = m.p group by image_id, m.i"


def _pass(source: str, out: str, matrix: str, size: int) -> str:
    """One two-dimensional pass over the top-left block of (image_id, c, y, x, v)."""
    return f"""{out}_x as (select image_id, c, y, i as x, sum(w * v) as v from {source} join {matrix} on p = x where x < {size} and y < {size} group by image_id, c, y, i
), {out}_y as (select image_id, c, i as y, x, sum(w * v) as v from {out}_x join {matrix} on p = y group by image_id, c, i, x
), {out} as materialized (select * from {out}_y union all select image_id, c, y, x, v from {source} where x >= {size} or y >= {size})"""


_EMB2 = _EMB + ", e2 as (select image_id, 0 as c, i // 8 as y, i % 8 as x, v from emb)"
_EV2 = _EV + ", e2 as (select image_id, c, y, x, v from ev)"
_HAAR3 = f"{_matrix('haar', 8, 'm8')}, {_matrix('haar', 4, 'm4')}, {_matrix('haar', 2, 'm2')}, {_pass('e2', 'a', 'm8', 8)}, {_pass('a', 'b', 'm4', 4)}, {_pass('b', 'z', 'm2', 2)}"
_PRIMARY16 = f"{_matrix('cdf97', 16, 'm16')}, {_matrix('cdf97', 8, 'm8')}, {_matrix('haar', 4, 'm4')}, {_matrix('haar', 2, 'm2')}, {_pass('e2', 'a', 'm16', 16)}, {_pass('a', 'b', 'm8', 8)}, {_pass('b', 'd', 'm4', 4)}, {_pass('d', 'z', 'm2', 2)}"
_NORM = f"""{_EV2}, {_matrix('cdf97', 16, 'm')}, {_pass('e2', 'z', 'm', 16)}, n as (
  select d.image_id, d.c, d.y, d.x, sign(d.v) * ln(1 + abs(d.v / greatest(1, abs(a.v)))) as v
  from z d join z a on a.image_id = d.image_id and a.c = d.c and a.y = d.y % 8 and a.x = d.x % 8 where d.y >= 8 or d.x >= 8
), pk as (select image_id, c, greatest(1, max(abs(v))) as norm from n group by image_id, c)"""

_LEVELS = ((0, 16, "cdf97"), (1, 8, "cdf97"), (2, 4, "haar"), (3, 2, "haar"))
_MATRICES = ", ".join(_matrix(family, size, f"m{size}") for _, size, family in _LEVELS)
_BACK = ", ".join(_inverse_matrix(family, size, f"i{size}") for _, size, family in _LEVELS)


def _normalised(source: str) -> str:
    """Every pass of 16 x 16 planes: l0 to l3 (details before their norm), n0 to n3 (norms), a4 (the last average)."""
    out, below = [], source
    for k, size, family in _LEVELS:
        half, z = size // 2, f"z{k}"
        peak = f"greatest(1, abs(b.v))" if family == "cdf97" else "1"
        out += [
            _pass(below, z, f"m{size}", size),
            f"""d{k} as (select a.image_id, a.c, a.y, a.x, a.v / {peak} as v from {z} a join {z} b on b.image_id = a.image_id and b.c = a.c and b.y = a.y % {half} and b.x = a.x % {half}
  where a.y >= {half} or a.x >= {half})""",
            f"l{k} as materialized (select image_id, c, y, x, sign(v) * ln(1 + abs(v)) as v from d{k})",
            f"n{k} as materialized (select image_id, c, greatest(1, max(abs(v))) as norm from l{k} group by image_id, c)",
            f"a{k + 1} as materialized (select * from {z} where y < {half} and x < {half})",
        ]
        below = f"a{k + 1}"
    return ", ".join(out)


_COEFFICIENTS = " union all ".join(f"select image_id, c, y, x, v / norm as v from l{k} join n{k} using (image_id, c)" for k in range(4)) + " union all select * from a4"


def _half(x: str) -> str:
    """The nearest IEEE half of a value, after the nearest float."""
    v = f"(({x})::float::double)"
    unit = f"pow(2, greatest(floor(log2(abs({v}))), -14) - 10)"
    return f"(case when abs({v}) < 1e-12 then 0.0 else round_even({v} / {unit}, 0) * {unit} end)"


_TO_YUV = """g as (select image_id, c, y, x, sign(v) * pow(abs(v), 1 / 2.2::double) as v from ev),
gp as (select image_id, y, x, max(case when c = 0 then v end) as v0, max(case when c = 1 then v end) as v1, max(case when c = 2 then v end) as v2 from g group by all),
gy as (select image_id, y, x, v0 * 0.299::double + v1 * 0.587::double + v2 * 0.114::double as v0, v0 * -0.14713::double + v1 * -0.28886::double + v2 * 0.436::double as v1,
  v0 * 0.615::double + v1 * -0.51499::double + v2 * -0.10001::double as v2 from gp),
e2 as materialized (select image_id, 0 as c, y, x, v0 as v from gy union all select image_id, 1, y, x, v1 from gy union all select image_id, 2, y, x, v2 from gy)"""


def _decoded() -> str:
    """What a container of quality 1 gives back: passes forward, the finest details quantised, the others halves, passes back."""
    out = [
        _TO_YUV,
        _normalised("e2"),
        """q0 as (select image_id, c, y, x, norm, v / norm as v, case when c = 0 then 1024.0::double else 256.0::double end as rate from l0 join n0 using (image_id, c)),
q1 as (select *, 0.5 / rate as t, trunc(greatest(0, abs(v) - 0.5 / rate) / (1 - 0.5 / rate) * rate) as q from q0),
c0 as (select image_id, c, y, x, norm::float::double as norm, case when q = 0 then 0 else (t * (1 - q / rate) + q / rate) * sign(v) end as v from q1)""",
        *(f"c{k} as (select image_id, c, y, x, norm::float::double as norm, {_half('v / norm')} as v from l{k} join n{k} using (image_id, c))" for k in (1, 2, 3)),
        f"r4 as materialized (select image_id, c, y, x, {_half('v')} as v from a4)",
    ]
    for k, size, family in reversed(_LEVELS):
        half = size // 2
        peak = "greatest(1, abs(b.v))" if family == "cdf97" else "1"
        out += [
            f"""w{k} as materialized (select * from r{k + 1} union all
  select a.image_id, a.c, a.y, a.x, sign(a.v) * (exp(abs(a.v * a.norm)) - 1) * {peak} from c{k} a join r{k + 1} b on b.image_id = a.image_id and b.c = a.c and b.y = a.y % {half} and b.x = a.x % {half})""",
            _pass(f"w{k}", f"r{k}", f"i{size}", size),
        ]
    out += [
        "yp as (select image_id, y, x, max(case when c = 0 then v end) as v0, max(case when c = 1 then v end) as v1, max(case when c = 2 then v end) as v2 from r0 group by all)",
        f"bk as ({_RGB.format('yp')})",
        "bt as (select image_id, 0 as c, y, x, r as v from bk union all select image_id, 1, y, x, g from bk union all select image_id, 2, y, x, b from bk)",
    ]
    return f"with {_EV}, {_MATRICES}, {_BACK}, {', '.join(out)} select image_id, c, y, x, round(sign(v) * pow(abs(v), 2.2::double), 3) as v from bt"


_BLOCKS = """
blk as (
  select image_id, c, y // 2 as y, x // 2 as x, sum(cents) as ll, sum(cents * (1 - 2 * (x % 2))) as hl, sum(cents * (1 - 2 * (y % 2))) as lh,
    sum(cents * (1 - 2 * (x % 2)) * (1 - 2 * (y % 2))) as hh
  from ev group by image_id, c, y // 2, x // 2
)"""


def _hilbert(side_bits: int, cells: str) -> str:
    """(x, y, t) of the cells by walking down the quadrants; s: 1 reversed, 2 exchanged."""
    return f"""
h(x, y, k, s, d) as (
  select x, y, {side_bits - 1}, 0, 0 from ({cells})
  union all
  select x, y, k - 1, case when ry = 1 then s when rx = 1 then xor(s, 3) else xor(s, 2) end, d * 4 + xor(3 * rx, ry)
  from (
    select x, y, k, s, d, xor(case when s & 2 > 0 then (y >> k) & 1 else (x >> k) & 1 end, s & 1) as rx, xor(case when s & 2 > 0 then (x >> k) & 1 else (y >> k) & 1 end, s & 1) as ry
    from h where k >= 0
  )
), curve as (select x, y, d as t from h where k = -1)"""


_GRID16 = "select cast(i % 16 as bigint) as x, cast(i // 16 as bigint) as y from range(0, 256) r(i)"
_GRID8 = "select cast(i % 8 as bigint) as x, cast(i // 8 as bigint) as y from range(0, 64) r(i)"

_COUNTS = "f as (select l_returnflag, cast(trunc(l_quantity) as bigint) as symbol, count(*) as n from lineitem group by 1, 2)"
_MODEL = f"""{_COUNTS}, p0 as (
  select *, greatest(1, n * 65535 // sum(n) over (partition by l_returnflag)) as p from f
), p1 as (
  select l_returnflag, symbol, n, cast(p as hugeint) as p, sum(p) over (partition by l_returnflag) as s, sum(case when p > 1 then p end) over (partition by l_returnflag) as g,
    coalesce(sum(p) over (partition by l_returnflag order by p desc, symbol rows between unbounded preceding and 1 preceding), 0) as k
  from p0
), p2 as (select *, s - 65535 as d from p1
), p3 as (
  select l_returnflag, symbol, n, cast(p + case
    when d > 0 and p > 1 then -((1 + 2 * d * (k + p)) // (2 * g) - (1 + 2 * d * k) // (2 * g))
    when d < 0 then cast(trunc((1 + 2 * d * k) / (2 * s)) - trunc((1 + 2 * d * (k + p)) / (2 * s)) as hugeint)
    else 0 end as bigint) as pmf
  from p2
), model as (select *, cast(sum(pmf) over (partition by l_returnflag order by pmf desc, symbol rows unbounded preceding) as bigint) as cmf from p3)"""

_RLE = f"""{_STREAMS}, ch as (
  select *, case when lag(symbol) over (partition by stream order by pos) = symbol then 0 else 1 end as change from st
), rn as (select *, sum(change) over (partition by stream order by pos) as run from ch
), ru as (select stream, run, min(symbol) as symbol, min(pos) as start, count(*) as len from rn group by stream, run)"""


def _rle_blocks(minimum: str, source: str = "ru", extra: str = "") -> str:
    keys = "stream" + extra
    return f"""cn as (select {keys}, run, symbol = 'view' and len >= {minimum} as is_const, start, len from {source}
), nb as (
  select *, case when lag(is_const) over (partition by {keys} order by run) is null or is_const or lag(is_const) over (partition by {keys} order by run) then 1 else 0 end as fresh from cn
), bl as (select *, sum(fresh) over (partition by {keys} order by run) as block from nb
), tb as (select {keys}, cast(block as bigint) as block, bool_or(is_const) as is_const, min(start) as start, cast(sum(len) as bigint) as len from bl group by {keys}, block)"""


_PAIR = _EV + ", pr as (select image_id, y, x, c, floor(v / 10) * 10 as a, v as r from ev)"


_LUMA = _EV + """, lum as (
  select image_id, y, x, sum(v * w) as r, sum(floor(v / 10) * 10 * w) as a
  from ev join (values (0, 0.17691::double), (1, 0.8124::double), (2, 0.01063::double)) k(c, w) using (c) group by image_id, y, x
)"""


def _similarity(source: str, name: str, reach: int, limit: int) -> str:
    return f"""{name}_o as (select a.d as dy, b.d as dx from range({-reach}, {reach + 1}) a(d), range({-reach}, {reach + 1}) b(d)
), {name}_m as (
  select image_id, y + dy as cy, x + dx as cx, avg(a) as a, avg(r) as r, var_pop(a) as va, var_pop(r) as vr, covar_pop(a, r) as cv
  from {source}, {name}_o where y + dy between 0 and {limit - 1} and x + dx between 0 and {limit - 1} group by all
), {name} as (select image_id, avg((2 * a * r + 1e-10) * (2 * cv + 9e-10) / ((a * a + r * r + 1e-10) * (va + vr + 9e-10))) as ssim from {name}_m group by image_id)"""


def _ssim(limit: int) -> str:
    return f"with {_LUMA}, {_similarity('lum', 's', 2, limit)} select image_id, round(ssim, 6) as ssim from s"


_MS_SSIM = f"""with {_LUMA}, hl as (select image_id, y // 2 as y, x // 2 as x, avg(a) as a, avg(r) as r from lum group by image_id, y // 2, x // 2
), {_similarity('lum', 's', 1, 16)}, {_similarity('hl', 'h', 1, 8)} select image_id, round((s.ssim + h.ssim) / 2, 6) as ms_ssim from s join h using (image_id)"""


def _float_bits(x: str) -> str:
    return f"cast('0b' || (({x})::float::bit::varchar) as bigint)"


_HALF_COMPAT = f"""with {_EMB}, b as (select image_id, i, {_float_bits('v')} as u from emb
), h as (
  select image_id, i, case when u = 0 then 0 else ((u >> 16) & 32768) | ((u >> 13) & 1023) | (case when ((u >> 23) & 255) < 112 then 0 when ((u >> 23) & 255) > 143 then 31 else ((u >> 23) & 255) - 112 end << 10) end as h from b
) select image_id, i, cast(h as bigint) as bits, case when h = 0 then 0.0::double else (case when h & 32768 > 0 then -1 else 1 end) * pow(2.0::double, ((h >> 10) & 31) + 112 - 127) * (1 + (h & 1023) / 1024.0::double) end as v from h"""

_SPOILT = f"""{_STREAMS}, sp as (
  select stream, pos, case when stream % 3 = 0 and pos = stream % 100 + 20 then 'other' else symbol end as symbol from st where stream % 5 <> 0 or pos < 90
), sd as (
  select coalesce(a.stream, b.stream) as stream, coalesce(a.pos, b.pos) as pos, a.symbol as "left", b.symbol as "right", a.stream is null or b.stream is null or a.symbol is distinct from b.symbol as differs
  from st a full join sp b on a.stream = b.stream and a.pos = b.pos
)"""


def _fnv(x: str) -> str:
    h = "2166136261"
    for k in range(4):
        h = f"(xor({h}, ({x} >> {8 * k}) & 255) * 16777619 & 4294967295)"
    return h


def _combine(a: str, b: str) -> str:
    return f"xor((({a} << (31 - ({b} & 31))) & 4294967295) | ({a} >> ({b} & 31)), (({b} << ({a} & 31)) & 4294967295) | ({b} >> (31 - ({a} & 31))))"


_BYTES = "list_transform(range(0, octet_length(encode(url))), lambda i: cast('0x' || substr(hex(encode(url)), 2 * i + 1, 2) as bigint))"


def _pcg(draws: int) -> str:
    """Each step as a query over the one before, in 128-bit integers."""
    u = ["u0", "u1", "u2", "u3"]
    steps = ["s0 as (select seed, " + ", ".join(f"(seed * {k}) & 4294967295 as {n}" for n, k in zip(u, (20219, 7243, 12547, 28573), strict=True)) + " from (select cast(i as hugeint) as seed from range(1, 1001) r(i)))"]

    def step(changes: dict[str, str]) -> None:
        at = len(steps)
        steps.append(f"s{at} as (select seed, " + ", ".join(f"({changes.get(n, n)}) & 4294967295 as {n}" for n in u) + f" from s{at - 1})")

    for _ in range(draws):
        step({n: f"{n} * 1664525 + 1013904223" for n in u})
        for turn in range(2):
            for n, a, b in (("u0", "u1", "u3"), ("u1", "u2", "u0"), ("u2", "u0", "u1"), ("u3", "u1", "u2")):
                step({n: f"{n} + {a} * {b}"})
            if not turn:
                step({n: f"xor({n}, {n} >> 16)" for n in u})
    return "with " + ", ".join(steps) + f" select cast(seed as bigint) as seed, {', '.join(f'cast({n} as bigint) as {n}' for n in u)}, round(cast(u0 as double) / 4294967295, 9) as r0 from s{len(steps) - 1}"


_PTS = "pts as (select image_id, c, k, (k * 7 % 11) / 10.0::double as u, (k * 3 % 7) / 6.0::double as w from (select distinct image_id from ev), range(0, 3) a(c), range(0, 10) b(k))"
_PATH = "pp as (select page_id, regexp_extract(url, '^[^?#]*') as p from pages)"
_P, _T = "(value - 100)", "((event_id % 101) / 100.0::double)"

ORACLE_SQL = {
    "pixels_tall": f"with {_ALL} select image_id, y, x, c, v from ev",
    "planes_roundtrip": f"with {_EV} select image_id, y, x, c, v from ev",
    "extract_channel": f"with {_ALL} select image_id, y, x, v from ev where c = 1",
    "emplace_channel": f"with {_EV} select image_id, y, x, c, case when c = 0 then 2 * (select v from ev o where o.image_id = ev.image_id and o.y = ev.y and o.x = ev.x and o.c = 1) else v end as v from ev",
    "luminance": f"with {_EV}, {_PX} select image_id, y, x, round(v0 * 0.17691::double + v1 * 0.8124::double + v2 * 0.01063::double, 9) as v from px",
    "rgb_to_yuv": f"with {_EV}, {_PX}, {_YUV} select image_id, y, x, round(v0, 9) as v0, round(v1, 9) as v1, round(v2, 9) as v2 from yuv",
    "yuv_to_rgb": f"with {_EV}, {_PX} select image_id, y, x, round(r, 9) as v0, round(g, 9) as v1, round(b, 9) as v2 from ({_RGB.format('px')})",
    "yuv_roundtrip_error": f"with {_EV}, {_PX}, {_YUV}, bk as ({_RGB.format('yuv')}) select image_id, round(max(greatest(abs(v0 - r), abs(v1 - g), abs(v2 - b))), 6) as max_error from px join bk using (image_id, y, x) group by image_id",
    "apply_gamma": f"with {_ALL} select image_id, y, x, c, round(pow(v, 1 / 2.2::double), 6) as v from ev",
    "populate_erase": f"with {_EV} select image_id, y, x, c, cast(image_id + 10 * x + 100 * y + 1000 * c as double) as v, 0.0::double as erased from (select distinct image_id from ev), range(0, 8) a(y), range(0, 8) b(x), range(0, 3) d(c)",
    "bilinear_sample": f"""with {_EV}, {_PTS}, q as (
  select *, least(floor(u * 15), 14) as ix, least(floor(w * 15), 14) as iy from pts
), z as (select *, u * 15 - ix as dx, w * 15 - iy as dy from q)
select z.image_id, z.c, k, round(sum(v * (case when ev.x = ix then 1 - dx else dx end) * (case when ev.y = iy then 1 - dy else dy end)), 6) as sample
from z join ev on ev.image_id = z.image_id and ev.c = z.c and ev.x in (ix, ix + 1) and ev.y in (iy, iy + 1) group by z.image_id, z.c, k""",
    "nearest_sample": f"with {_EV}, {_PTS} select pts.image_id, pts.c, k, v as sample from pts join ev on ev.image_id = pts.image_id and ev.c = pts.c and ev.x = trunc(u * 15) and ev.y = trunc(w * 15)",
    "downsample_2x": f"with {_EV} select image_id, y // 2 as y, x // 2 as x, c, sum(cents) / (100 * count(*)) as v from ev group by image_id, y // 2, x // 2, c",
    "diagnostic_image": f"with {_EMB}, {_SYM} select image_id, i, round(pow(abs((symbol - 12) / 12.0::double), 2.2::double), 6) as v from sym",
    **{f"{f}_1d_forward": _one_d(f, False) for f in _TAPS},
    **{f"{f}_1d_inverse": _one_d(f, True) for f in _TAPS},
    "wavelet_tap_sums": " union all ".join(f"select '{f}' as family, '{r}' as role, round(list_sum({t}::double[]), 6) as total, round(list_sum(list_transform({t}::double[], lambda x: abs(x))), 6) as total_abs" for f, (_, *ts) in _TAPS.items() for r, t in zip(("low", "high", "low_back", "high_back"), ts, strict=True)),
    "haar_2d_level1": f"with {_EV}, {_BLOCKS} select image_id, c, y, x, ll / 400 as ll, hl / 400 as hl, lh / 400 as lh, hh / 400 as hh from blk",
    "subband_energy": f'with {_EV}, {_BLOCKS} select count(distinct image_id) as images, count(*) as cells, sum(ll * ll) / 160000 as "LL", sum(hl * hl) / 160000 as "HL", sum(lh * lh) / 160000 as "LH", sum(hh * hh) / 160000 as "HH" from blk',
    "cdf97_2d_level1": f"with {_EMB2}, {_matrix('cdf97', 8, 'm')}, {_pass('e2', 'z', 'm', 8)} select image_id, y, x, round(v, 6) as v from z",
    "cdf53_2d_level1": f"with {_EV2}, {_matrix('cdf53', 16, 'm')}, {_pass('e2', 'z', 'm', 16)} select image_id, c, y, x, round(v, 9) as v from z",
    "dwt_multilevel": f"with {_EMB2}, {_HAAR3} select image_id, y, x, round(v, 6) as v from z",
    "wavelet_only_encode": f"with {_EV2}, {_PRIMARY16} select image_id, c, y, x, round(v, 4) as v from z",
    "dwt_roundtrip": f"with {_EV} select image_id, c, y, x, round(v, 2) as v from ev",
    "normalised_roundtrip": f"with {_EV} select image_id, c, y, x, round(v, 2) as v from ev",
    "normalised_dwt_multilevel": f"with {_EV2}, {_MATRICES}, {_normalised('e2')}, z as ({_COEFFICIENTS}) select image_id, c, y, x, round(v, 6) as v from z",
    "pass_norms_multilevel": f"with {_EV2}, {_MATRICES}, {_normalised('e2')} " + " union all ".join(f"select image_id, c, {k}::bigint as pass, round(norm, 6) as norm from n{k}" for k in range(4)),
    "local_peaks": f"with {_EV} select a.image_id, a.c, a.y, a.x, greatest(1, max(abs(b.v)))::double as v from ev a join ev b on a.image_id = b.image_id and a.c = b.c and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by all",
    "normalised_dwt_level1": f"with {_NORM} select image_id, c, y, x, round(v / norm, 6) as v from n join pk using (image_id, c)",
    "pass_norms": f"with {_NORM} select image_id, c, 0::bigint as pass, round(norm, 6) as norm from pk",
    "quant_rates": """select side, channel_kind, p as precinct, cast(least(32767, base * pow(2, cast(round(log2(side)) as bigint) - p)) as bigint) as rate
from (select unnest([8, 16, 64, 256, 1024, 4096]) as side), (values ('Y', 12), ('UV', 4)) k(channel_kind, base), range(0, 13) r(p) where p <= round(log2(side))""",
    "precinct_thresholds": """select side, channel_kind, p as precinct, round(0.5 / least(32767, base * pow(2, cast(round(log2(side)) as bigint) - p)) * pow(0.5, round(log2(side)) - p), 9) as threshold
from (select unnest([8, 16, 64]) as side), (values ('Y', 12), ('UV', 4)) k(channel_kind, base), range(0, 13) r(p) where p <= round(log2(side))""",
    "quantise_symbols": f"with {_EMB}, {_SYM} select image_id, i, symbol from sym",
    "dequantise_symbols": f"with {_EMB}, {_SYM} select image_id, i, round({_DEQ}, 6) as v from sym",
    "quant_error": f"with {_EMB}, {_SYM} select image_id, round(max(abs(v - {_DEQ})), 6) as max_error from sym group by image_id",
    "precinct_rows": f"""with {_EMB2}, q as (select *, case when greatest(y, x) = 0 then 0 when greatest(y, x) = 1 then 1 when greatest(y, x) < 4 then 2 else 3 end as precinct from e2
), h as (select *, case when precinct = 0 then 1 else 1 << (precinct - 1) end as half from q)
select image_id, precinct, case when precinct = 0 then 0 when y < half then 0 when x < half then 1 else 2 end as quad, y % half as y, x % half as x, round(v, 6) as v from h""",
    "precinct_emptiness": f"""with {_EMB2} select image_id, case when greatest(y, x) = 0 then 0 when greatest(y, x) = 1 then 1 when greatest(y, x) < 4 then 2 else 3 end as precinct, bool_and(abs(v) <= 0.2) as is_empty from e2 group by 1, 2""",
    "hilbert_to_curve": f"with recursive {_hilbert(4, _GRID16)} select x, y, t from curve",
    "hilbert_from_curve": f"with recursive {_hilbert(4, _GRID16)} select t, x, y from curve",
    "hilbert_order_symbols": f"with recursive {_hilbert(3, _GRID8)}, {_EMB}, {_SYM} select image_id, string_agg(symbol::varchar, ',' order by t) as symbols from sym join curve on x = i % 8 and y = i // 8 group by image_id",
    "symbol_frequency": f"with {_COUNTS} select * from f",
    "model_pmf": f"with {_MODEL} select l_returnflag, symbol, pmf from model",
    "model_cmf": f"with {_MODEL} select l_returnflag, symbol, cmf from model",
    "shannon_entropy": f"with {_MODEL} select l_returnflag, round(-sum(pmf / 65535.0::double * log2(pmf / 65535.0::double)), 6) as entropy from model group by 1",
    "bits_per_symbol": f"with {_COUNTS} select l_returnflag, count(*) as n_symbols, cast(ceil(log2(count(*))) as bigint) as bits from f group by 1",
    "rle_blocks": f"with {_RLE}, {_rle_blocks('2')} select stream, block, is_const, start, len from tb",
    "rle_expand": f"with {_STREAMS} select stream, pos, symbol from st",
    "rle_roundtrip": f"with {_STREAMS} select size::bigint as size, stream, pos, symbol from st, (select unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) as size)",
    "rle_best_block_size": f"""with {_RLE}, rs as (select ru.*, size from ru, (select unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) as size)), {_rle_blocks('size', 'rs', ', size')}, co as (
  select stream, size, sum(case when is_const then 0 else len end) + count(*) as coded from tb group by stream, size
) select stream, cast(arg_min(size, coded * 10000 + size) as bigint) as size from co group by stream""",
    "rle_block_size_study": f"with {_RLE}, rs as (select ru.*, size from ru, (select unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) as size)), {_rle_blocks('size', 'rs', ', size')} select size, cast(sum(case when is_const then 0 else len end) as bigint) as n_literals, count(*) as n_blocks, cast(sum(len) as bigint) as n_input from tb group by size",
    "rle_encoded_length": f"with {_STREAMS} select stream, count(*) as n from st group by stream",
    "rle_ratio": f"with {_RLE}, {_rle_blocks('2')}, s as (select stream, cast(sum(len) as bigint) as n_input, cast(sum(case when is_const then 0 else len end) as bigint) as n_literals, count(*) as n_blocks from tb group by stream) select *, round((n_literals + n_blocks) / n_input, 6) as ratio from s",
    "rle_block_size_sweep": f"with {_RLE}, rs as (select ru.*, size from ru, (select unnest([2, 3, 4, 8]) as size)), {_rle_blocks('size', 'rs', ', size')} select size, cast(sum(case when is_const then 0 else len end) as bigint) as n_literals, count(*) as n_blocks, cast(sum(len) as bigint) as n_input from tb group by size",
    "arith_roundtrip": f"with {_STREAMS}, k as (select stream, count(*) as n, count(distinct symbol) as n_symbols from st group by stream) select stream, n, n_symbols, pos, symbol from st join k using (stream)",
    "finite_mse": f"with {_PAIR} select image_id, round(sum(case when x = 3 or y = 5 then 0 else (a - r) * (a - r) end) / count(*), 4) as mse from pr group by image_id",
    "resized": f"with {_EV} select image_id, y, x, c, v from ev where image_id % 2 = 0 union all select image_id, y, x, c, 0.0::double from (select distinct image_id, c from ev where image_id % 2 = 1), range(0, 4) a(y), range(0, 4) b(x)",
    "shape_guard": "select w as width, h as height, bit_count(w)::bigint as bits, w = h and bit_count(w) = 1 as fits from (select i as w, i as h from range(1, 71) r(i) union all select 16, 8)",
    "pass_counts": """with f as (select * from (values ('haar', 0, 1), ('d4', -1, 2), ('cdf53', -2, 3), ('cdf97', -4, 5)) t(family, first, last)), m as (
  select family, 2 * greatest(1 - cast(trunc(-last / 2) as bigint), 1 - cast(trunc(-(first - 1) / 2) as bigint)) as min_size from f
) select family, min_size, 1 << k as side, cast(floor(log2((1 << k) // 2)) as bigint) + 1 as passes, cast(floor(log2((1 << k) // min_size)) as bigint) + 1 as primary_passes from m, range(3, 13) r(k)""",
    "clean_params": "select k, least(greatest(k / 2, 0), 1)::double as quality, round(least(greatest(pow(10.0::double, 2 * k), 1e-3), 100), 9) as image_gamma, greatest(k / 4, 0)::double as threshold, least(greatest(k / 2, 1e-3), 1)::double as threshold_attenuation, greatest(k, 1)::bigint as min_compressed_precinct from range(-3, 4) r(k)",
    "raw_precincts": f"""with {_EV}, {_MATRICES}, {_TO_YUV}, {_normalised('e2')}, k as (
  select image_id, c, y, x, v, 0 as p from a4 union all select image_id, c, y, x, v / norm, 1 from l3 join n3 using (image_id, c)
  union all select image_id, c, y, x, v / norm, 2 from l2 join n2 using (image_id, c) union all select image_id, c, y, x, v / norm, 3 from l1 join n1 using (image_id, c)
), h as (select *, case when p = 0 then 1 else 1 << (p - 1) end as half from k
) select image_id, c, row_number() over (partition by image_id, c order by p, case when p = 0 then 0 when y < half then 0 when x < half then 1 else 2 end, y, x) - 1 as i, round({_half('v')}, 6) as v from h""",
    "pair_mse": f"with {_PAIR} select image_id, round(avg((a - r) * (a - r)), 4) as mse from pr group by image_id",
    "mse": f"with {_PAIR.replace(_EV, _ALL)} select image_id, round(avg((a - r) * (a - r)), 4) as mse from pr group by image_id",
    "psnr": f"with {_PAIR}, q as (select image_id, c, 20 * log10(max(r)) - 10 * log10(avg((a - r) * (a - r))) as l from pr group by image_id, c) select image_id, round(sum(l), 5) as psnr_sum, round(avg(l), 5) as psnr from q group by image_id",
    "ssim": _ssim(16),
    "ssim_compat": _ssim(4),
    "ssim_patches": _ssim(16),
    "ms_ssim": _MS_SSIM,
    "half_roundtrip": _HALF_COMPAT,
    "hash_float": f"with h as (select event_id, {_float_bits('value')} as b, {_float_bits('event_id')} as a from events) select event_id, {_fnv('b')} as h, {_combine('a', 'b')} as combined, b as bits from h",
    "packed_bits": """with p as (select page_id, coalesce(substr(url, 1, 12), '') as t from pages), b as (
  select page_id, t, list_aggregate(list_transform(range(0, octet_length(encode(t))), lambda i: lpad(format('{:b}', cast('0x' || substr(hex(encode(t)), 2 * i + 1, 2) as bigint)), 8, '0')), 'string_agg', ',') as s from p
) select page_id, regexp_replace(s, '0*$', '') as bits from b""",
    "constants": "select * from (values ('pi', pi()), ('two_pi', 2 * pi()), ('four_pi', 4 * pi()), ('half_pi', pi() / 2), ('root_2', sqrt(2)), ('phi', (1 + sqrt(5)) / 2), ('inv_phi', 2 / (1 + sqrt(5))), ('ln_2', ln(2)), ('float_max', 3.4028234663852886e38::double)) t(name, value)",
    "stream_mismatch": f"with {_SPOILT} select stream, coalesce(min(case when differs then pos end), -1) as pos from sd group by stream",
    "stream_differences": f'with {_SPOILT} select stream, pos, "left", "right" from sd where differs',
    "math_functions": f"""select event_id, case when {_P} < 0 then -1.0 else 1.0 end::double as sign, round({_P} * {_P}, 4) as sqr, round({_P} * {_P} * {_P}, 3) as cub, round(({_P} / 100) * ({_P} / 100) * ({_P} / 100) * ({_P} / 100), 6) as pow4,
  ((event_id - 500) % 7 + 7) % 7 as comp_mod, case when {_P} > 50 then 1.0 else 0.0 end::double as heaviside, least(greatest({_P}, -20), 30)::double as clamp, round(least(greatest({_P} / 100, 0), 1), 6)::double as saturate,
  round({_P} % 1.0, 6) as fract, round(1 * (1 - {_P} / 100) + 5 * ({_P} / 100), 6) as mix, round(radians({_P}), 6) as rad, round(degrees({_P} / 100), 5) as deg from events""",
    "interp_curves": f"""select event_id, round(2 * (1 - {_T} * {_T} * (3 - 2 * {_T})) + 5 * ({_T} * {_T} * (3 - 2 * {_T})), 6) as smooth, round({_T}, 6) as smooth_unit, round(cos({_T} * {math.pi!r} + {math.pi!r}) * 0.5 + 0.5, 6) as trig,
  round(case when {_T} < 0.5 then 0.5 - 0.5 * sin(pow(abs({_T} * 2 - 1), 2) * {math.pi / 2!r}) else 0.5 + 0.5 * sin(pow(abs({_T} * 2 - 1), 2) * {math.pi / 2!r}) end, 6) as trig_exp,
  round((1 / (1 + exp(-({_T} * 2 - 1) * 4)) - 1 / (1 + exp(-4.0::double))) / (1 - 2 / (1 + exp(-4.0::double))), 6) as sigmoid from events""",
    "fnv1a_u32": f"select event_id, {_fnv('event_id')} as h from events",
    "fnv1a_text": f"select page_id, list_reduce({_BYTES}, lambda h, b: xor(h, b) * 16777619 & 4294967295, 2166136261::bigint) as h from pages",
    "hash_combine": f"with h as (select event_id, event_id as a, user_id as b, {_fnv('event_id')} as fa, {_fnv('user_id')} as fb from events) select event_id, {_combine('a', 'b')} as h, {_combine('fa', 'fb')} as pack from h",
    "hash_as_float": f"select event_id, round({_fnv('event_id')} / 4294967295.0::double, 9) as f from events",
    "xor_hash8": f"with b as (select page_id, {_BYTES} as b from pages) select page_id, list_reduce(b[2:], lambda h, x: xor(h, (x + 149) & 255), b[1]) as h, list_reduce(b, lambda h, x: xor(h, x), 0::bigint) as checksum from b",
    "ordered_dither": "select event_id, (([[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]])[event_id % 4 + 1][(event_id // 16) % 4 + 1] + 0.5::double) / 16 as dither from events",
    "pcg_random": _pcg(2),
    "bit_string": """with b as (select event_id, lpad(format('{:b}', event_id), 32, '0') as b from events) select event_id, substr(b, 1, 8) || ',' || substr(b, 9, 8) || ',' || substr(b, 17, 8) || ',' || substr(b, 25, 8) as bits, event_id as back,
  24 + case when event_id % 256 = 0 then 0 else 8 - cast(log2((event_id & 255) & -(event_id & 255)) as bigint) end as packed_bits from b""",
    "path_parts": rf"""with {_PATH}, f as (select *, regexp_extract(p, '[^/\\]*$') as filename from pp)
select page_id, filename, regexp_replace(p, '[/\\]?[^/\\]*$', '') as parent, case when filename like '_%.%' then regexp_extract(filename, '.(\.[^.]*)$', 1) else '' end as extension,
  case when filename like '_%.%' then regexp_replace(p, '\.[^./\\]*$', '') else p end || '.exr' as as_exr, regexp_replace(p, '[^/\\]*$', '') || 'x' as renamed, lower(p) as lower from f""",
    "command_options": "select page_id, coalesce(url, '') as source, '0.5' as quality, '' as flag, 3::bigint as n from pages",
    "first_mismatch": f"with {_PAIR} select image_id, c, coalesce(min(case when a <> r then y * 16 + x end), -1) as first_mismatch from pr group by image_id, c",
    "codec_decode": _decoded(),
}


def _plain_zeros(sql: str) -> str:
    """``sql`` with 0 added to each rounded value, so that no negative zero is left."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, end = 0, k + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out.append(f"{sql[at:k]}(round({_plain_zeros(sql[k + 6 : end - 1])}) + 0)")
        at = end
    return "".join(out) + sql[at:]


ORACLE_SQL = {name: _plain_zeros(sql) for name, sql in ORACLE_SQL.items()}
