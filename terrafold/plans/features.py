"""Feature tables for the erosivity model, composed of grid and climate operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import indices
from terrafold.functions import timeparts as tp
from terrafold.operators.rain import group_fraction


def outer_feature_join(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Fold feature tables by full outer join on shared keys."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), parts)


def month_from_daily_join(daily: DataFrame, monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Daily rows with the features of the month their day falls in."""
    d = daily.withColumn("month", tp.month_of_doy(F.col("doy")))
    return d.join(monthly, [*keys, "month"], "left")


def target_join(features: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return features.join(target, [*keys, "doy"], "inner")


def derived(df: DataFrame, keys: list[str], fraction: bool = True) -> DataFrame:
    """Cyclic encodings and, with ``fraction``, the day's share of the annual precipitation, whose totals make all rows twice."""
    ds, dc = indices.cyclic_day(F.col("doy"))
    as_, ac = indices.cyclic_aspect(F.col("aspect"))
    x = df.withColumns({"sin_doy": ds, "cos_doy": dc, "aspect_sin": as_, "aspect_cos": ac})
    return group_fraction(x, keys, "prec_daily_avg", "prec_daily_fraction") if fraction else x


def feature_table(
    static: DataFrame, daily: DataFrame, monthly: list[DataFrame], keys: list[str], target: DataFrame | None = None, fraction: bool = True
) -> DataFrame:
    """Static, daily, monthly and derived features per (cell, day of year)."""
    f = month_from_daily_join(daily, outer_feature_join(monthly, [*keys, "month"]), keys).join(static, keys, "left")
    if target is not None:
        f = target_join(f, target, keys)
    return derived(f, keys, fraction)
