"""Validity, cloud, shadow and snow masking of satellite pixel observations.

Columns follow the pixel table: bands ``s2_B..``, provider mask ``s2_mask``
(1 cloud, 2 shadow, 3 snow, 4 no data) and scene class ``s2_SCL``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = 65535
# fixed class codes of the scene classification
SCL_CLOUD, SCL_SHADOW, SCL_SNOW, SCL_CIRRUS = (8, 9, 10), 3, 11, 10


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _sure(c: Column) -> Column:
    """Unknown counts as not masked."""
    return F.coalesce(c, F.lit(False))


def nodata_to_null(df: DataFrame, cols: list[str], sentinel: int = NODATA) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def drop_all_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(_any([F.coalesce(F.col(c) != 0, F.lit(True)) for c in cols]))


def scale_reflectance(df: DataFrame, cols: list[str], factor: float = 10000.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(factor) for c in cols})


def cloud() -> Column:
    return _sure((F.col("s2_mask") == 1) | F.col("s2_SCL").isin(*SCL_CLOUD))


def shadow() -> Column:
    return _sure((F.col("s2_mask") == 2) | (F.col("s2_SCL") == SCL_SHADOW))


def snow() -> Column:
    return _sure((F.col("s2_mask") == 3) | (F.col("s2_SCL") == SCL_SNOW))


def ndsi(eps: float = 0.0) -> Column:
    g, w = F.col("s2_B03") / 10000, F.col("s2_B11") / 10000
    return F.try_divide(g - w, g + w + F.lit(eps))


def masked(bands: list[str], cirrus: float = 1000.0, nodata: int | None = NODATA) -> Column:
    """True where a pixel is missing, cloud, shadow, snow or bright cirrus."""
    missing = _all([F.col(b).isNull() for b in bands])
    if nodata is not None:
        missing = missing | _sure(_all([F.col(b) == nodata for b in bands]))
    bright = _sure((F.col("s2_SCL") == SCL_CIRRUS) & (F.col("s2_B02") > cirrus))
    return _any([missing, cloud(), shadow(), snow(), bright])


def pixel_mask(df: DataFrame, bands: list[str], cirrus: float = 1000.0) -> DataFrame:
    return df.where(~masked(bands, cirrus))


def fractions_missing(cols: list[str]) -> Column:
    """Mask for tables that carry fractions only."""
    return _all([F.col(c).isNull() for c in cols])


def scene_quality(df: DataFrame, scene: list[str], bands: list[str]) -> DataFrame:
    """Counts per scene that the scene filters test; one combinable pass."""
    valid = F.col("s2_mask") != 4
    n_if = lambda c: F.count_if(c)
    return df.groupBy(*scene).agg(
        F.count(F.lit(1)).alias("n"), n_if(_sure(valid)).alias("n_valid"),
        n_if(cloud()).alias("n_cloud"), n_if(shadow()).alias("n_shadow"), n_if(snow()).alias("n_snow"),
        n_if(_sure((ndsi() > 0.4) & valid)).alias("n_ndsi"),
        n_if(_sure((ndsi(1e-9) > 0.4) & valid)).alias("n_ndsi_eps"),
        F.avg(F.when(F.col("s2_SCL") == SCL_CIRRUS, F.col("s2_B02"))).alias("cirrus_b02"),
        _any([F.count_if(_sure(F.col(b) == NODATA)) == F.count(F.lit(1)) for b in bands]).alias("band_empty"),
    )


def scene_filter(
    df: DataFrame, scene: list[str], bands: list[str], cloud_max: float = 0.1, shadow_max: float = 0.1,
    snow_max: float = 0.1, cirrus_max: float = 1000.0, valid_only: bool = False, guarded: bool = False,
) -> DataFrame:
    """Keep scenes whose shares of bad pixels stay within the limits.

    By default shares are over all pixels and snow is classified. With
    ``valid_only`` they are over pixels not marked as no data and snow is
    NDSI above 0.4; ``guarded`` counts an empty scene as one pixel and keeps
    scenes with an all-nodata band.
    """
    q = scene_quality(df, scene, bands)
    if not valid_only:
        base, snow_n = F.col("n"), F.col("n_snow")
    elif guarded:
        base, snow_n = F.greatest("n_valid", F.lit(1)), F.col("n_ndsi_eps")
    else:
        base, snow_n = F.col("n_valid"), F.col("n_ndsi")
    # counts against limit * base: a zero base drops a scene with any hit
    bad = _any(
        [
            F.col("n_cloud") > base * cloud_max, F.col("n_shadow") > base * shadow_max,
            snow_n > base * snow_max, _sure(F.col("cirrus_b02") > cirrus_max),
        ]
        + ([] if guarded else [F.col("band_empty")])
    )
    return df.join(q.where(~bad).select(*scene), scene, "left_semi")


def field_date_filter(df: DataFrame, keys: list[str], mask: Column, max_masked: float = 0.05) -> DataFrame:
    """Keep a field's date when at most ``max_masked`` of its pixels are masked."""
    ok = df.groupBy(*keys).agg(F.avg(mask.cast("int")).alias("_share")).where(F.col("_share") <= max_masked)
    return df.join(ok.select(*keys), keys, "left_semi")


def drop_stats(raw: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after cleaning per field."""
    a = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    b = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_kept"))
    j = a.join(b, keys, "full_outer").na.fill(0, ["n_total", "n_kept"])
    return j.withColumns(
        {
            "n_dropped": F.col("n_total") - F.col("n_kept"),
            "drop_fraction": F.try_divide(F.col("n_total") - F.col("n_kept"), F.col("n_total")),
        }
    )


def field_keep(raw: DataFrame, clean: DataFrame, keys: list[str], max_drop: float = 0.7) -> DataFrame:
    """Cleaned rows of fields that lost no more than ``max_drop`` of their rows."""
    ok = drop_stats(raw, clean, keys).where(F.col("drop_fraction") <= max_drop)
    return clean.join(ok.select(*keys), keys, "left_semi")


def semi_by_key(df: DataFrame, survivors: DataFrame, keys: list[str]) -> DataFrame:
    """Observations whose key survived a cleaning step elsewhere."""
    return df.join(survivors.select(*keys).distinct(), keys, "left_semi")


def mosaic_merge(
    df: DataFrame, slice_keys: list[str], cell_keys: list[str], extent: list[str], values: list[str], nodata: int = NODATA
) -> DataFrame:
    """One mosaic per slice key from overlapping pieces, absent cells as nodata.

    ``extent`` are the columns within which all slices share one set of cells.
    Where pieces overlap the smallest valid value wins, so that the result does
    not depend on row order.
    """
    keys = list(dict.fromkeys([*extent, *slice_keys, *cell_keys]))
    merged = df.groupBy(*keys).agg(
        *[F.min(F.nullif(F.col(v), F.lit(nodata))).alias(v) for v in values]
    )
    slices = df.select(*dict.fromkeys([*extent, *slice_keys])).distinct()
    cells = df.select(*dict.fromkeys([*extent, *cell_keys])).distinct()
    dense = slices.join(cells, extent)
    return dense.join(merged, keys, "left").withColumns({v: F.coalesce(F.col(v), F.lit(nodata)) for v in values})
