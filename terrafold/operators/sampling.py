"""Ranking, repeatable sampling and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.hashing import key_digest, unit_hash
from terrafold.operators.grid import grid_id
from terrafold.plans.ordered import first_per_key, running_sum, top_n


def top_crops(labels: DataFrame, name: str, year_cols: list[str], n: int = 20, ignore: list[str] | None = None) -> DataFrame:
    """Union over years of the ``n`` largest crops, without ignored names."""
    long = labels.unpivot([name], year_cols, "_year", "_area").where(F.col("_area").isNotNull())
    best = top_n(long, ["_year"], [F.col("_area").desc(), F.col(name)], n).select(name).distinct()
    return best.where(~F.col(name).isin(*ignore)) if ignore else best


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows; ``order`` must break all ties."""
    return df.orderBy(*order).limit(k)


def best_and_worst(df: DataFrame, metric: str, tie: str, count: str, min_n: int, k: int) -> DataFrame:
    """Best and worst ``k`` groups by a metric among groups of at least ``min_n``."""
    ok = df.where((F.col(count) >= min_n) & F.col(metric).isNotNull())
    best = top_k(ok, [F.col(metric), F.col(tie)], k).withColumn("side", F.lit("best"))
    worst = top_k(ok, [F.col(metric).desc(), F.col(tie)], k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def ordered_output(df: DataFrame, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie))


def sample_per_group(df: DataFrame, group: list[str], row: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group, all if fewer; fixed by the row key and the seed."""
    d = key_digest(*[F.col(c) for c in row], seed=seed)
    return top_n(df, group, [d, *[F.col(c) for c in row]], n)


def weighted_key(row: list[str], weight: str, seed: int, draw: Column | None = None) -> Column:
    """Exponential race key: the smallest keys are a weighted sample (Efraimidis and Spirakis 2006)."""
    parts = [F.col(c) for c in row] + ([] if draw is None else [draw])
    u = F.greatest(unit_hash(*parts, seed=seed), F.lit(2.0 ** -33))
    return -F.log(u) / F.col(weight)


def sample_weighted(
    df: DataFrame, group: list[str], row: list[str], weight: str, n: int, seed: int = 0, replace: bool = False
) -> DataFrame:
    """Weighted sample of ``n`` rows per group.

    With replacement each draw is a hashed position along the group's summed
    weights and takes the row that covers it. Rows and draws meet in ranges of
    those weights, one for each draw, so rows are not copied for every draw.
    """
    ok = df.where(F.col(weight) > 0)
    if not replace:
        return top_n(ok, group, [weighted_key(row, weight, seed), *[F.col(c) for c in row]], n)
    h = ok.withColumn("_h", key_digest(*[F.col(c) for c in row], seed=seed)).withColumn("_chunk", F.substring("_h", 1, 2))
    r = running_sum(h, group, "_chunk", "_h", {"_to": F.col(weight).cast("double")})
    r = r.withColumn("_from", F.col("_to") - F.col(weight))
    totals = r.groupBy(*group).agg(F.max("_to").alias("_total"))
    at = lambda c: F.floor(c / F.col("_total") * n).cast("long")
    u = unit_hash(*[F.col(c) for c in group], F.col("draw"), seed=seed)
    draws = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_pos", u * F.col("_total"))
    draws = draws.select(*[F.col(c).alias(f"_k_{c}") for c in group], "draw", "_pos", at(F.col("_pos")).alias("_range"))
    spans = r.join(totals, group).withColumn("_range", F.explode(F.sequence(at(F.col("_from")), at(F.col("_to")))))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in group], spans["_range"] == draws["_range"])
    hit = spans.join(draws, same & (F.col("_from") <= F.col("_pos")) & (F.col("_pos") < F.col("_to")))
    return first_per_key(hit.select(*df.columns, "draw"), [*group, "draw"], F.struct(*row))


def aoi_samples(parcels: DataFrame, years: list[int]) -> DataFrame:
    """Every parcel in every year with its centroid."""
    from terrafold.functions import geometry as g

    return parcels.withColumns({"x": g.centroid_x(), "y": g.centroid_y()}).withColumn(
        "yr", F.explode(F.array(*[F.lit(y) for y in years]))
    )


def extreme_pick(df: DataFrame, sample: list[str], time: str, ndvi: str = "ndvi", swir: str = "swir_ratio") -> DataFrame:
    """Purest vegetation, residue and soil observation per sample location.

    Vegetation has the lowest SWIR ratio among NDVI at or above its 70 %
    quantile; residue the lowest and soil the highest among NDVI at or below
    the 30 % quantile, residue only from 1 June to 15 November. Samples whose
    NDVI never exceeds 0.1 are left out. A sample's series is bounded by its
    dates, so its quantiles are plain aggregates.
    """
    ok = df.where(F.col(ndvi).isNotNull() & F.col(swir).isNotNull())
    q = ok.groupBy(*sample).agg(
        F.percentile(ndvi, F.lit(0.7)).alias("_hi"), F.percentile(ndvi, F.lit(0.3)).alias("_lo"), F.max(ndvi).alias("_top")
    ).where(F.col("_top") > 0.1)
    j = ok.join(q, sample)
    rest = [c for c in df.columns if c not in sample]
    row = F.struct(*rest)
    green, brown = F.col(ndvi) >= F.col("_hi"), F.col(ndvi) <= F.col("_lo")
    md = F.month(time) * 100 + F.dayofmonth(time)
    season = brown & md.between(601, 1115)
    low, high = F.struct(swir, time), F.struct(-F.col(swir), F.col(time))
    picks = j.groupBy(*sample).agg(
        F.min_by(row, F.when(green, low)).alias("pv"), F.min_by(row, F.when(season, low)).alias("npv"),
        F.min_by(row, F.when(brown, high)).alias("soil"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("r")) for k in ("pv", "npv", "soil")])
    return (
        picks.select(*sample, F.explode(kinds).alias("_k")).where(F.col("_k.r").isNotNull())
        .select(*sample, F.col("_k.kind").alias("kind"), *[F.col(f"_k.r.{c}").alias(c) for c in rest])
    )


def sample_cells(df: DataFrame, cell: list[str], n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` distinct cells."""
    d = key_digest(*[F.col(c) for c in cell], seed=seed)
    pick = df.select(*cell).distinct().orderBy(d, *cell).limit(n)
    return df.join(pick, cell, "left_semi")


def shuffled_index(df: DataFrame, keys: list[str], row: list[str], seed: int, out: str = "idx") -> DataFrame:
    """0-based position of each row in a repeatable shuffle of its key.

    The digest is uniform, so its first byte cuts a key into 256 even chunks;
    without keys only the 256 chunk totals meet in one task.
    """
    h = df.withColumn("_h", key_digest(*[F.col(c) for c in row], seed=seed)).withColumn("_chunk", F.substring("_h", 1, 2))
    if not keys:
        h = h.withColumn("_all", F.lit(1))
    part = keys or ["_all"]
    r = running_sum(h, part, "_chunk", "_h", {"_pos": F.lit(1).cast("long")})
    return r.withColumn(out, F.col("_pos") - 1).select(*df.columns, out)


def spatial_split(
    df: DataFrame, station: str, x: str, y: str, train: float = 0.7, val: float = 0.15, size: float = 25_000.0, seed: int = 42
) -> DataFrame:
    """Split whole coarse cells, so that neighbouring stations share a side."""
    st = grid_id(df.select(station, x, y).distinct(), x, y, size)
    cells = st.select("grid_x", "grid_y").distinct()
    n = cells.agg(F.count(F.lit(1))).scalar()
    idx = shuffled_index(cells, [], ["grid_x", "grid_y"], seed, "_i")
    a, b = F.floor(n * train), F.floor(n * val)
    side = F.when(F.col("_i") < a, "train").when(F.col("_i") < a + b, "val").otherwise("test")
    named = idx.select("grid_x", "grid_y", side.alias("split"))
    return st.join(named, ["grid_x", "grid_y"]).select(station, "grid_x", "grid_y", "split").distinct()


def random_split(df: DataFrame, row: list[str], test: float = 0.2, seed: int = 0) -> DataFrame:
    """Mark rows train or test by their key's hash."""
    u = unit_hash(*[F.col(c) for c in row], seed=seed)
    return df.withColumn("split", F.when(u < test, "test").otherwise("train"))


def intersect_except(valid: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return valid.join(excluded.select(*keys).distinct(), keys, "left_anti")


def complete_cells(df: DataFrame, cell: list[str], value: str, n: int = 12) -> DataFrame:
    """Rows of cells with a value in every one of ``n`` months."""
    ok = df.groupBy(*cell).agg(F.count(value).alias("_n")).where(F.col("_n") == n).select(*cell)
    return df.join(ok, cell, "left_semi")


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
