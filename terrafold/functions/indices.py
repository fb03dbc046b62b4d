"""Spectral indices, encodings and rounding helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.text import stars


def ratio_index(a: Column, b: Column) -> Column:
    """Normalised difference; null where both bands are zero."""
    return F.try_divide(a - b, F.nullif(a + b, F.lit(0)))


def swir_ratio(b12: Column, b11: Column) -> Column:
    return F.try_divide(b12, F.nullif(b11, F.lit(0)))


def with_indices(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "ndvi": ratio_index(c("s2_B08"), c("s2_B04")),
            "swir_ratio": swir_ratio(c("s2_B12"), c("s2_B11")),
            "ndsi": ratio_index(c("s2_B03"), c("s2_B11")),
        }
    )


def cyclic_day(doy: Column) -> tuple[Column, Column]:
    a = F.lit(2 * math.pi) * doy / 365
    return F.sin(a), F.cos(a)


def cyclic_aspect(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def round_to(v: Column, step: int, how: str = "near") -> Column:
    """Multiple of ``step``: below, above, or nearest with ties to even."""
    fn = {"down": F.floor, "up": F.ceil, "near": F.bround}[how]
    return (fn(v / step) * step).cast("long")


def clip(v: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = v
    if lo is not None:
        out = F.when(v.isNotNull(), F.greatest(out, F.lit(float(lo))))
    if hi is not None:
        out = F.when(v.isNotNull(), F.least(out, F.lit(float(hi))))
    return out


def derived_features(base: list[str]) -> list[str]:
    """Feature names with aspect and day of year replaced by their encodings."""
    out: list[str] = []
    for f in base:
        new = {"aspect": ["aspect_sin", "aspect_cos"], "doy": ["doy_sin", "doy_cos"]}.get(f, [f])
        out += [n for n in new if n not in out]
    return out


def with_derived(df: DataFrame, keys: list[str], base: list[str]) -> DataFrame:
    """The keys and the features that a model is given for ``base``: angles as sine and cosine, each name once."""
    made: dict[str, Column] = {}
    for name, encode in (("aspect", cyclic_aspect), ("doy", cyclic_day)):
        if name in base:
            made |= dict(zip((f"{name}_sin", f"{name}_cos"), encode(F.col(name))))
    return df.select(*keys, *[made[f].alias(f) if f in made else F.col(f) for f in derived_features(base)])


def scalar_demo(orders: DataFrame) -> DataFrame:
    """The scalar expressions above on the order table."""
    c = F.col
    v = c("o_totalprice")
    ds, dc = cyclic_day(F.dayofyear("o_orderdate"))
    as_, ac = cyclic_aspect(F.pmod("o_custkey", F.lit(360)))
    k = c("o_custkey")
    return orders.select(
        "o_orderkey", F.exp(-0.05 * v / 1e4).alias("slr"), ds.alias("doy_sin"), dc.alias("doy_cos"),
        as_.alias("asp_sin"), ac.alias("asp_cos"), F.log1p(v).alias("log_ei"), F.expm1(F.log1p(v)).alias("back"),
        round_to(k, 10, "down").alias("dn"), round_to(k, 10, "up").alias("up"), round_to(k, 10).alias("near"),
        stars(v / 5e6).alias("star"),
    )
