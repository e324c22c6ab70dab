"""Quantisation rates, dead zone, quantiser and its inverse as column expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RATE, MAX_SYMBOL, TOP_BASE = 32767, 65535, 1024


@dataclass(frozen=True)
class Params:
    """Encoder parameters; ``clean`` brings them into range."""

    quality: float = 0.3
    attenuation: float = 2.0
    image_gamma: float = 2.2
    quantise_gamma: float = 1.0
    threshold: float = 0.5
    threshold_attenuation: float = 1.0
    min_compressed_precinct: int = 4
    min_quant: int = 4
    rounding: float = 0.0
    log_space: bool = True
    use_rle: bool = True
    hilbert: bool = True

    def clean(self) -> Params:
        bound = lambda v, a, b: min(max(v, a), b)
        return replace(
            self, quality=bound(self.quality, 0.0, 1.0), min_compressed_precinct=max(1, self.min_compressed_precinct), image_gamma=bound(self.image_gamma, 1e-3, 100.0),
            threshold=max(0.0, self.threshold), threshold_attenuation=bound(self.threshold_attenuation, 1e-3, 1.0),
        )

    def as_dict(self) -> dict:
        return asdict(self)


def base_rates(quality: float, min_quant: int = 4) -> tuple[int, int]:
    """Rates of the finest precinct for luma and chroma."""
    q = min(max(quality, 0.0), 1.0) ** 4
    luma = int(min_quant * (1 - q) + TOP_BASE * q + 0.5)
    return luma, max(min_quant, luma // 4)


def rates(side: int, params: Params, luma: bool = True) -> list[int]:
    """The rate of each precinct: the finest has the base, each coarser one ``attenuation`` times as much, up to MAX_RATE."""
    n = side.bit_length()
    value, out = float(base_rates(params.quality, params.min_quant)[0 if luma else 1]), []
    for _ in range(n):
        out.append(int(value))
        value = min(float(MAX_RATE), value * params.attenuation)
    return out[::-1]


def rate_table(spark: SparkSession, sides: list[int], params: Params) -> DataFrame:
    """side, channel_kind (Y, UV), precinct, rate."""
    rows = [(s, kind, p, r) for s in sides for kind in ("Y", "UV") for p, r in enumerate(rates(s, params, kind == "Y"))]
    return spark.createDataFrame(rows, "side int, channel_kind string, precinct int, rate int")


def threshold(rate: Column, precinct: Column, n_precincts: Column, params: Params) -> Column:
    return params.threshold / rate * F.pow(F.lit(params.threshold_attenuation), n_precincts - precinct - 1)


def dead_zone(a: Column, t: Column) -> Column:
    """Values up to t become 0, those up to 1 are stretched back; NaN becomes 0."""
    return F.nanvl(F.greatest(F.lit(0.0), a - t), F.lit(0.0)) / (1 - t)


def quantise(v: Column, rate: Column, t: Column, params: Params) -> Column:
    """Symbols around ``rate``, which stands for zero. NaN counts as zero."""
    side = F.when(v < 0, -1).otherwise(1)
    f = dead_zone(F.pow(F.abs(F.nanvl(v, F.lit(0.0))), F.lit(1 / params.quantise_gamma)), t)
    return F.least(F.greatest((params.rounding + f * rate).cast("int") * side + rate, F.lit(0)), F.lit(MAX_SYMBOL)).cast("int")


def dequantise(symbol: Column, rate: Column, t: Column, params: Params) -> Column:
    q = symbol - rate
    a = F.greatest(F.lit(0.0), F.abs(q) - params.rounding) / rate
    a = F.when(q != 0, t * (1 - a) + a).otherwise(a)
    return F.pow(a, F.lit(params.quantise_gamma)) * F.when(q < 0, -1.0).otherwise(1.0)


def empty_precincts(coefficients: DataFrame, t: Column, params: Params) -> DataFrame:
    """image_id, c, precinct, is_empty: nothing is left above the dead zone."""
    left = dead_zone(F.pow(F.abs("v"), F.lit(1 / params.quantise_gamma)), t)
    return coefficients.groupBy("image_id", "c", "precinct").agg(F.bool_and(left == 0).alias("is_empty"))
