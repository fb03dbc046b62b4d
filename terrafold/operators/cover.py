"""Cover fractions: normalisation, dominance, and statistics per pixel and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_fractions(
    df: DataFrame, cols: list[str], suffix: str = "_norm", upper: float | None = None, zero_sum: float | None = None
) -> DataFrame:
    """Clip fractions at 0 (and at ``upper``) and divide by their sum.

    A zero sum gives ``zero_sum`` (null by default). With an empty suffix the
    columns are replaced.
    """

    def clip(c: str) -> Column:
        v = F.greatest(F.col(c), F.lit(0.0))
        v = v if upper is None else F.least(v, F.lit(float(upper)))
        return F.when(F.col(c).isNotNull(), v)

    parts = {c: clip(c) for c in cols}
    total = sum(parts.values(), F.lit(0.0))
    if zero_sum is None and (upper is None or upper >= 0):
        # filters copy these expressions whole, and methods over 8 KB are not compiled: the sum is told once a column
        return df.withColumns({f"{c}{suffix}": F.try_divide(parts[c], total) for c in cols})
    fallback = F.lit(zero_sum).cast("double")
    return df.withColumns(
        {
            f"{c}{suffix}": F.when(total > 0, parts[c] / total).when(total.isNotNull(), fallback)
            for c in cols
        }
    )


def dominant_class(
    df: DataFrame, pv: str, npv: str, soil: str, suffix: str,
    soil_threshold: float | None = None, npv_threshold: float | None = None,
) -> DataFrame:
    """Flag NPV- and soil-dominant rows (1/0, null kept); PV dominance is neither."""
    p, n, s = F.col(pv), F.col(npv), F.col(soil)
    known = p.isNotNull() & n.isNotNull() & s.isNotNull()
    one = lambda cond: cond.cast("int")
    npv_flag = (
        F.when(known, one((n > p) & (n > s))) if npv_threshold is None else one(n > npv_threshold)
    )
    soil_flag = (
        F.when(known, one((s > p) & (s > n))) if soil_threshold is None else one(s > soil_threshold)
    )
    return df.withColumns({f"npv_dominant_{suffix}": npv_flag, f"soil_dominant_{suffix}": soil_flag})


def drop_border_rows(df: DataFrame, cols: list[str], how: str = "any") -> DataFrame:
    """Drop rows whose fractions are all 0, or any/all null."""
    zero = F.lit(True)
    for c in cols:
        zero = zero & F.coalesce(F.col(c) == 0, F.lit(False))
    return df.dropna(how=how, subset=cols).where(~zero)


def dedupe_mean(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Average duplicate rows of a (pixel, time) key."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def combine_models(glob: DataFrame, soil: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Global and group-specific predictions side by side; the latter may be absent."""
    g = glob.select(*keys, *[F.col(v).alias(f"{v}_global") for v in values])
    s = soil.select(*keys, *[F.col(v).alias(f"{v}_soil") for v in values])
    return g.join(s, keys, "left")


def pixel_period_stats(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, population sd and valid count of each fraction per pixel and period."""
    aggs = []
    for v in values:
        aggs += [
            F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def region_stats(
    pixels: DataFrame, region_area: DataFrame, region: str, pixel_keys: list[str], values: list[str],
    pixel_area: float = 100.0, min_share: float = 0.0, min_area: float = 300.0, stat: str = "mean",
) -> DataFrame:
    """Statistics of pixel means per region, for regions with enough coverage.

    ``region_area`` gives the area that could hold data; regions at or under
    ``min_area`` and regions whose covered share is not above ``min_share``
    are left out. ``count_norm`` scales counts by the largest region. ``stat``
    is what stands for a pixel's values over time: their mean or their median.
    A pixel has one value per date, so its median is a bounded aggregate.
    """
    if stat not in ("mean", "median"):
        raise ValueError("stat must be mean or median")
    over_time = F.avg if stat == "mean" else (lambda v: F.percentile(v, F.lit(0.5)))
    px = pixels.dropna(how="all", subset=values).groupBy(region, *pixel_keys).agg(
        *[over_time(v).alias(v) for v in values]
    )
    aggs = [F.count(F.lit(1)).alias("n_pixels")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count")]
    stats = px.groupBy(region).agg(*aggs)
    area = region_area.where(F.col("total_valid_area") > min_area)
    out = stats.join(area, region, "inner").withColumn(
        "fraction_area", F.try_divide(F.col("n_pixels") * F.lit(pixel_area), F.col("total_valid_area"))
    )
    out = out.where(F.col("fraction_area") > min_share)
    peak = out.agg(F.max(f"{values[0]}_count")).scalar()
    return out.withColumn("count_norm", F.try_divide(F.col(f"{values[0]}_count"), peak))


def bare_share(df: DataFrame, region: str, pixel_keys: list[str], soil: str, threshold: float = 0.5) -> DataFrame:
    """Share of a region's pixels whose mean soil fraction exceeds ``threshold``."""
    px = df.groupBy(region, *pixel_keys).agg(F.avg(soil).alias("_s")).where(F.col("_s").isNotNull())
    return px.groupBy(region).agg(
        F.count_if(F.col("_s") > threshold).alias("n_bare"),
        F.count(F.lit(1)).alias("n_pixels"),
        F.try_divide(F.count_if(F.col("_s") > threshold), F.count(F.lit(1))).alias("bare_share"),
    )


def bare_days(
    df: DataFrame, region: str, pixel_keys: list[str], period: str, soil: str, n_periods: int,
    threshold: float = 0.5, days: int = 7, min_valid: float = 0.5,
) -> DataFrame:
    """Mean number of bare days per region.

    A pixel-period is bare when its mean soil fraction exceeds the threshold.
    Pixels with fewer valid periods than ``min_valid`` of all do not count.
    """
    pw = df.groupBy(region, *pixel_keys, period).agg(F.avg(soil).alias("_s"))
    px = pw.groupBy(region, *pixel_keys).agg(
        F.count("_s").alias("_valid"), (F.count_if(F.col("_s") > threshold) * F.lit(days)).alias("_days")
    )
    keep = F.when(F.col("_valid") >= F.lit(min_valid * n_periods), F.col("_days"))
    return px.groupBy(region).agg(F.avg(keep).alias("bare_days"), F.count(keep).alias("n_pixels"))


def field_mean_series(raw: DataFrame, clean: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean fraction per field and date before and after cleaning, with counts."""
    a = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"), *[F.avg(v).alias(f"{v}_raw") for v in values])
    b = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clean"), *[F.avg(v).alias(f"{v}_clean") for v in values])
    return a.join(b, keys, "left").withColumn("n_clean", F.coalesce("n_clean", F.lit(0)))


def hex_mean(df: DataFrame, a: str, b: str, value: str, width: float) -> DataFrame:
    """Mean of a value per hexagonal bin of two coordinates.

    Two interleaved rectangular lattices; each point belongs to the nearer
    lattice point, the second lattice winning ties.
    """
    sx, sy = F.col(a) / width, F.col(b) / (width * 3 ** 0.5)
    i1, j1 = F.bround(sx), F.bround(sy)
    i2, j2 = F.floor(sx), F.floor(sy)
    d1 = (sx - i1) ** 2 + 3 * (sy - j1) ** 2
    d2 = (sx - i2 - 0.5) ** 2 + 3 * (sy - j2 - 0.5) ** 2
    first = d1 < d2
    hx = F.when(first, i1).otherwise(i2 + 0.5)
    hy = F.when(first, j1).otherwise(j2 + 0.5)
    return (
        df.where(sx.isNotNull() & sy.isNotNull())
        .groupBy((hx * width).alias("hex_x"), (hy * (width * 3 ** 0.5)).alias("hex_y"))
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    )
