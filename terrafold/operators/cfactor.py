"""Cover factor per pixel, parcel, crop and field, and the calibration of its exponent."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.plans.ordered import spread
from terrafold.session import cut_lineage

from terrafold.functions import timeparts as tp

BETA = 0.033
BETA_BOUNDS = (1e-4, 0.1)


def slr(fc: Column, beta: float) -> Column:
    """Soil loss ratio of a cover percentage."""
    return F.exp(-F.lit(float(beta)) * fc)


def grid_cell(x: Column, offset: float, resolution: float) -> Column:
    """Nearest grid index, ties to even; an integer so that joins never compare floats."""
    return F.bround((x - F.lit(float(offset))) / F.lit(float(resolution))).cast("long")


def grid_snap_join(
    fc: DataFrame, ei: DataFrame, x_off: float, y_off: float, resolution: float = 100.0, fold_leap: bool = True
) -> DataFrame:
    """Left-join daily erosivity of the nearest grid cell onto cover observations."""
    doy = tp.doy365(F.col("time")) if fold_leap else F.dayofyear("time")
    left = fc.withColumns(
        {"gx": grid_cell(F.col("x"), x_off, resolution), "gy": grid_cell(F.col("y"), y_off, resolution), "doy": doy}
    )
    right = ei.select(
        grid_cell(F.col("x"), x_off, resolution).alias("gx"),
        grid_cell(F.col("y"), y_off, resolution).alias("gy"), "doy", "ei",
    )
    return left.join(right, ["gx", "gy", "doy"], "left")


def cfactor(df: DataFrame, keys: list[str], beta: float = BETA, fc: str = "fc_total", ei: str = "ei") -> DataFrame:
    """Erosivity-weighted mean soil loss ratio per group; null when no erosivity."""
    v = df.where(F.col(fc).isNotNull() & F.col(ei).isNotNull())
    num, den = F.sum(slr(F.col(fc), beta) * F.col(ei)), F.sum(ei)
    return v.groupBy(*keys).agg(F.when(den > 0, num / den).alias("C"))


def crop_mean(pixel_c: DataFrame, crop: str = "lnf_code") -> DataFrame:
    return pixel_c.where(F.col("C").isNotNull()).groupBy(crop).agg(F.avg("C").alias("C_predicted"))


def parcel_cfactor(pixel_c: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Mean, sample sd and count of pixel values per parcel; worst quality flag."""
    aggs = [F.avg("C").alias("C_new"), F.stddev_samp("C").alias("C_new_sd"), F.count("C").alias("n_pixels")]
    if flag:
        aggs.append(F.max(flag).alias(flag))
    return pixel_c.groupBy(*keys).agg(*aggs)


def field_time_stats(df: DataFrame, keys: list[str], value: str = "fc_total") -> DataFrame:
    """Mean and population sd of cover per field and time.

    Fields may straddle tiles; partial and final aggregation merge the pieces.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("fc_mean"), F.stddev_pop(value).alias("fc_std"), F.count(value).alias("n_pix")
    )


def cfactor_timeseries(stats: DataFrame, beta: float = BETA, fc: str = "fc_mean", ei: str = "ei") -> DataFrame:
    """Soil loss ratio and its product with erosivity per (field, time)."""
    s = slr(F.col(fc), beta)
    return stats.withColumns({"slr": s, "slr_ei": s * F.col(ei)})


def annual_cfactor(series: DataFrame, keys: list[str]) -> DataFrame:
    ok = series.where(F.col("slr_ei").isNotNull())
    return ok.groupBy(*keys).agg(
        F.when(F.sum("ei") > 0, F.sum("slr_ei") / F.sum("ei")).alias("C_annual"), F.count(F.lit(1)).alias("n_times")
    )


def agronomic_year(df: DataFrame, time: str = "time", year: str = "yr") -> DataFrame:
    """Rows of the agronomic year ``year``: 1 July before to 30 June of it.

    Adds total cover in percent.
    """
    d = F.to_date(time)
    y = F.col(year).cast("int")
    lo = F.make_date(y - 1, F.lit(7), F.lit(1))
    hi = F.make_date(y, F.lit(6), F.lit(30))
    return df.where(d.between(lo, hi)).withColumn("fc_total", (F.col("pv") + F.col("npv")) * 100)


def erosion_risk(df: DataFrame, c: dict[str, str], potential: str, p_factor: str) -> DataFrame:
    """Cover factor times potential erosion times practice factor, per variant."""
    return df.withColumns({f"ers_risk_{k}": F.col(v) * F.col(potential) * F.col(p_factor) for k, v in c.items()})


def area_weights(ref: DataFrame, area: str = "area_ha", out: str = "weight") -> DataFrame:
    """Normalise areas to weights: null is 0, negatives 0, all zero means equal."""
    w = F.greatest(F.coalesce(F.col(area), F.lit(0.0)), F.lit(0.0))
    total, n = ref.agg(F.sum(w)).scalar(), ref.agg(F.count(F.lit(1))).scalar()
    return ref.withColumn(out, F.when(total > 0, w / total).otherwise(F.lit(1.0) / n))


def beta_grid(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def crop_c_by_beta(
    df: DataFrame, keys: list[str], betas: list[float], crop: str = "lnf_code", fc: str = "fc_total", ei: str = "ei"
) -> DataFrame:
    """Crop mean for every candidate exponent, from one pass over the data.

    The candidates are aggregate columns of one group-by, so the rows are
    neither multiplied nor re-read; only the crop-level result is unpivoted.
    Rows move before they get a column for each candidate: a pixel has few, so
    partial sums would be as many as the rows and far wider.
    """
    v = spread(df.where(F.col(fc).isNotNull() & F.col(ei).isNotNull()).select(*dict.fromkeys([*keys, crop, fc, ei])), *keys)
    nums = [F.sum(slr(F.col(fc), b) * F.col(ei)).alias(f"_n{i}") for i, b in enumerate(betas)]
    px = v.groupBy(*keys).agg(F.sum(ei).alias("_d"), *nums).where(F.col("_d") > 0)
    means = px.groupBy(crop).agg(*[F.avg(F.col(f"_n{i}") / F.col("_d")).alias(f"_c{i}") for i in range(len(betas))])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("beta"), F.col(f"_c{i}").alias("C_predicted")) for i, b in enumerate(betas)])
    return means.select(crop, F.explode(pairs).alias("_p")).select(crop, "_p.beta", "_p.C_predicted")


def beta_sensitivity(
    df: DataFrame, ref: DataFrame, keys: list[str], betas: list[float], crop: str = "lnf_code"
) -> DataFrame:
    """Absolute error per crop and exponent, with the weight of the crop."""
    return _errors(crop_c_by_beta(df, keys, betas, crop), ref, crop)


def _errors(c: DataFrame, ref: DataFrame, crop: str) -> DataFrame:
    return c.join(area_weights(ref), crop, "inner").select(
        crop, "beta", "C_predicted", "C_ref", F.abs(F.col("C_predicted") - F.col("C_ref")).alias("abs_error"), "weight"
    )


#: Nodes of a crop's curve. Over the bounds the curve is a mean of exp(-beta fc), fc up to 100, which so many nodes give to 1e-13.
NODES = 24


def chebyshev_nodes(lo: float, hi: float, n: int = NODES) -> list[float]:
    return [(lo + hi) / 2 + (hi - lo) / 2 * math.cos(math.pi * (i + 0.5) / n) for i in range(n)]


def node_weights(nodes: list[float], at: float) -> list[float]:
    """What each node's value counts in the polynomial through the nodes at ``at`` (barycentric form)."""
    if at in nodes:
        return [float(x == at) for x in nodes]
    terms = [(-1) ** i * math.sin(math.pi * (i + 0.5) / len(nodes)) / (at - x) for i, x in enumerate(nodes)]
    return [t / sum(terms) for t in terms]


def crop_curves(df: DataFrame, keys: list[str], bounds: tuple[float, float], crop: str = "lnf_code") -> tuple[list[float], DataFrame]:
    """Nodes within the bounds, and each crop's mean C at them as an array, from one pass over the data."""
    nodes = chebyshev_nodes(*bounds)
    rows = crop_c_by_beta(df, keys, nodes, crop)
    # by falling node, as the nodes are
    curve = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("beta")).alias("b"), F.col("C_predicted").alias("c")))), lambda p: p["c"])
    return nodes, cut_lineage(rows.groupBy(crop).agg(curve.alias("_curve")))


def on_curves(nodes: list[float], curves: DataFrame, betas: list[float], crop: str = "lnf_code") -> DataFrame:
    """``crop_c_by_beta`` at any exponents within the bounds, from the curves alone."""

    def value(b: float) -> Column:
        weights = F.array(*map(F.lit, node_weights(nodes, b)))
        return F.aggregate(F.zip_with("_curve", weights, lambda c, w: c * w), F.lit(0.0), lambda t, v: t + v)

    told = F.array(*[F.struct(F.lit(float(b)).alias("beta"), value(b).alias("C_predicted")) for b in betas])
    return curves.select(crop, F.explode(told).alias("_p")).select(crop, "_p.beta", "_p.C_predicted")


def beta_loss(sens: DataFrame) -> DataFrame:
    """Weighted mean absolute error per exponent, weights renormalised over matched crops."""
    w, e = F.sum("weight"), F.sum(F.col("weight") * F.col("abs_error"))
    return sens.groupBy("beta").agg(
        F.when(w > 0, e / w).otherwise(F.avg("abs_error")).alias("mae"), F.avg("abs_error").alias("mae_equal")
    )


def calibrate_beta(
    df: DataFrame, ref: DataFrame, keys: list[str], bounds: tuple[float, float] = BETA_BOUNDS,
    points: int = 41, rounds: int = 3,
) -> tuple[float, DataFrame]:
    """Exponent minimising the crop error, by shrinking grids.

    One pass over the data gives each crop's curve over the exponents; the grids
    look at the curves, a few numbers a crop. Only the winning exponent (one
    row) returns to the driver.
    """
    nodes, curves = crop_curves(df, keys, bounds)
    lo, hi = bounds
    best, table = lo, None
    for _ in range(rounds):
        table = beta_loss(_errors(on_curves(nodes, curves, beta_grid(lo, hi, points)), ref, "lnf_code"))
        best = table.agg(F.min_by("beta", F.struct("mae", "beta")).alias("b")).first()["b"]
        step = (hi - lo) / (points - 1)
        lo, hi = max(bounds[0], best - step), min(bounds[1], best + step)
    return best, table
