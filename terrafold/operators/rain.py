"""Rain gauge series to erosivity events and to a daily climatology.

Times are epoch minutes (``minute``). Series operators work on the regular
axis built by ``regularize``: one row per step, with the ``chunk`` column that
bounds every window and the span of the series (``t_first``, ``t_last``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import timeparts as tp
from terrafold.plans.ordered import carry, dealt, running_sum, spread, top_n, with_halo, with_totals
from terrafold.session import cut_lineage

STEP = 10  # minutes per row
CHUNK_STEPS = 30 * 144  # rows per chunk: 30 days
SMALL_GAP, LARGE_GAP = 30, 180  # minutes
DRY_STEPS = 36  # six hours
MIN_EVENT_MM = 12.7


def clean_columns(df: DataFrame, time: str = "time", rename: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Strip quotes and blanks from column names, rename, and require columns."""
    rename = rename or {}
    names = [c.strip().strip("\"'").strip() for c in df.columns]
    out = df.toDF(*[rename.get(n, n) for n in names])
    missing = [c for c in (time, *required) if c not in out.columns]
    if missing:
        raise ValueError(f"required columns absent: {missing}")
    return out


def span_of(df: DataFrame, key: str = "station", time: str = "minute", value: str = "rain", step: int = STEP) -> tuple[DataFrame, int]:
    """First and last time of each series, one row each, and how many rows their axes have together."""
    span = cut_lineage(df.groupBy(key).agg(F.min(time).alias("t_first"), F.max(time).alias("t_last")))
    return span, int(span.agg(F.sum((F.col("t_last") - F.col("t_first")) / step + 1)).first()[0] or 0)


def regularize(
    df: DataFrame, key: str = "station", time: str = "minute", value: str = "rain", step: int = STEP, known: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """One row per step between the first and the last time of each series.

    Equal times keep their largest value; times off the axis are dropped. The
    axis is generated chunk by chunk on the executors, then merged with the
    observations in the same shuffle that arranges rows by (key, chunk). Its
    tasks follow from the axes' rows (``known``, or else ``span_of``), since a
    regular axis compresses to next to nothing.
    """
    span, rows = known or span_of(df, key, time, value, step)
    size = step * CHUNK_STEPS
    chunk = lambda m: F.floor(m / size)
    chunks = span.withColumn("chunk", F.explode(F.sequence(chunk(F.col("t_first")), chunk(F.col("t_last")))))
    begin = F.greatest(
        F.col("t_first"), F.col("t_first") + F.ceil((F.col("chunk") * size - F.col("t_first")) / step) * step
    )
    end = F.least(F.col("t_last"), (F.col("chunk") + 1) * size - 1)
    axis = (
        spread(chunks, key, "chunk").where(begin <= end)
        .withColumn(time, F.explode(F.sequence(begin, end, F.lit(step).cast("long"))))
        .select(key, "chunk", time, F.lit(None).cast("double").alias(value), "t_first", "t_last")
    )
    nothing = F.lit(None).cast("long")
    obs = df.select(key, chunk(F.col(time)).alias("chunk"), time, value, nothing.alias("t_first"), nothing.alias("t_last"))
    both = dealt(axis.unionByName(obs), rows, key, "chunk", wide=True)
    return (
        both.groupBy(key, "chunk", time)
        .agg(F.max(value).alias(value), F.max("t_first").alias("t_first"), F.max("t_last").alias("t_last"))
        .where(F.col("t_first").isNotNull())
    )


def _run_minutes(last_other: Column, next_other: Column, step: int) -> Column:
    """Minutes of the run a row lies in, from the nearest rows outside the run."""
    lo = F.coalesce(last_other, F.col("t_first") - step)
    hi = F.coalesce(next_other, F.col("t_last") + step)
    return hi - lo - step


def run_length(axis: DataFrame, flag: Column, out: str, key: str = "station", time: str = "minute", step: int = STEP) -> DataFrame:
    """Length in rows of the run of equal ``flag`` values each row belongs to."""
    t = F.col(time)
    on, off = F.when(flag, t), F.when(~flag, t)
    c = carry(axis.withColumn("_flag", flag), [key], "chunk", time,
              back={"_lon": on, "_loff": off}, forward={"_non": on, "_noff": off})
    n = F.when(
        F.col("_flag"), _run_minutes(F.col("_loff"), F.col("_noff"), step)
    ).otherwise(_run_minutes(F.col("_lon"), F.col("_non"), step)) / step
    return c.withColumn(out, n.cast("long")).drop("_flag", "_lon", "_loff", "_non", "_noff")


def _flags(axis: DataFrame, key: str, time: str, value: str, step: int) -> DataFrame:
    t, r = F.col(time), F.col(value)
    valid, wet = F.when(r.isNotNull(), t), F.when(r > 0, t)
    c = carry(axis, [key], "chunk", time, back={"_lv": valid, "_lw": wet}, forward={"_nv": valid, "_nw": wet})
    return c.withColumns(
        {
            "gap_minutes": F.when(r.isNull(), _run_minutes(F.col("_lv"), F.col("_nv"), step)),
            "_dry_minutes": F.when(~F.coalesce(r > 0, F.lit(False)), _run_minutes(F.col("_lw"), F.col("_nw"), step)),
            "_raw": r,
        }
    ).drop("_lv", "_lw", "_nv", "_nw")


def _gaps(flagged: DataFrame, value: str, small: int, large: int) -> DataFrame:
    gap = F.coalesce(F.col("gap_minutes"), F.lit(0))
    return flagged.withColumns(
        {
            "medium_gap": ((gap > small) & (gap < large)).cast("int"),
            "large_gap": (gap >= large).cast("int"),
            value: F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)),
        }
    )


def gap_policy(
    axis: DataFrame, key: str = "station", time: str = "minute", value: str = "rain", step: int = STEP,
    small: int = SMALL_GAP, large: int = LARGE_GAP,
) -> DataFrame:
    """Fill missing rain with 0 and flag medium and large gaps, which break events."""
    return _gaps(_flags(axis, key, time, value, step), value, small, large).drop("_dry_minutes", "_raw")


def rain_events(
    axis: DataFrame, key: str = "station", time: str = "minute", value: str = "rain", step: int = STEP,
    small: int = SMALL_GAP, large: int = LARGE_GAP, dry_steps: int = DRY_STEPS,
) -> DataFrame:
    """Number events: a dry run of six hours or a medium/large gap breaks them.

    Every row of such a run is a break, so the id is the running count of
    breaks; the rows left inside events are those after the last break.
    """
    g = _gaps(_flags(axis, key, time, value, step), value, small, large)
    dry = (F.col(value) == 0) & (F.col("_dry_minutes") >= dry_steps * step)
    brk = (dry | (F.col("medium_gap") == 1) | (F.col("large_gap") == 1)).cast("int")
    g = g.withColumn("event_break", brk)
    return running_sum(g, [key], "chunk", time, {"event_id": F.col("event_break")}).drop("_dry_minutes", "_raw")


def unit_energy(rain: Column, step: int = STEP) -> Column:
    """Unit rain energy (Brown and Foster 1987) of a step's rain."""
    intensity = rain * (60 / step)
    return F.when(rain >= 0.1, 0.29 * (1 - 0.72 * F.exp(-0.05 * intensity))).otherwise(F.lit(0.0))


def i30(events: DataFrame, key: str = "station", time: str = "minute", value: str = "rain", step: int = STEP, rows: int = 0) -> DataFrame:
    """Peak 30-minute intensity ending at each row, not reaching into another event."""
    n = max(1, 30 // step)
    size = step * CHUNK_STEPS
    h = with_halo(events, [key], "chunk", F.floor((F.col(time) + (n - 1) * step) / size), rows=rows)
    w = Window.partitionBy(key, "_halo", "event_id").orderBy(time).rowsBetween(-(n - 1), 0)
    return (
        h.withColumn("I30", F.sum(value).over(w) * 2)
        .where(F.col("_halo") == F.col("chunk")).drop("_halo")
        .withColumn("energy", unit_energy(F.col(value), step) * F.col(value))
    )


def event_stats(rows: DataFrame, key: str = "station", time: str = "minute", value: str = "rain", min_total: float = MIN_EVENT_MM) -> DataFrame:
    """Totals, peak intensity, rainy span and erosivity of each event."""
    wet = F.when(F.col(value) > 0, F.col(time))
    e = rows.groupBy(key, "event_id").agg(
        F.min(wet).alias("start_min"), F.max(wet).alias("end_min"),
        F.sum(value).alias("total_precipitation"), F.sum("energy").alias("E"), F.max("I30").alias("I30"),
    )
    e = e.where(F.col("total_precipitation") >= min_total)
    return e.select(
        key, "event_id", "start_min", "end_min", "total_precipitation", "I30", (F.col("E") * F.col("I30")).alias("EI30")
    )


def events_from_series(obs: DataFrame, **kw) -> DataFrame:
    """Series to event table, in one chain once the series' spans are known."""
    known = span_of(obs, **kw)
    return event_stats(i30(rain_events(regularize(obs, **kw, known=known), **kw), **kw, rows=known[1]), **kw)


def ei_daily(events: DataFrame, key: str = "station") -> DataFrame:
    """Split each event over the days it touches by duration, and sum per day."""
    day = 1440
    a, b = F.col("start_min"), F.col("end_min")
    d0, d1 = F.floor(a / day), F.floor(b / day)
    x = events.withColumn("_d", F.explode(F.sequence(d0, d1)))
    overlap = F.least(b, (F.col("_d") + 1) * day) - F.greatest(a, F.col("_d") * day)
    share = F.when(d0 == d1, F.col("EI30")).otherwise(F.col("EI30") * overlap / (b - a))
    return x.groupBy(key, F.date_from_unix_date(F.col("_d").cast("int")).alias("day")).agg(F.sum(share).alias("EI_daily"))


def station_screen(
    daily: DataFrame, key: str = "station", n_top: int = 3, max_fraction: float = 0.2, min_years: int = 3
) -> DataFrame:
    """Drop stations ruled by a few extreme days on rarely observed days of year.

    Dropped when the top days hold more than ``max_fraction`` of the total and
    one of their days of year has values in fewer than ``min_years`` years.
    """
    d = daily.withColumns({"_doy": tp.doy365(F.col("day")), "_yr": F.year("day")})
    top = top_n(d, [key], [F.col("EI_daily").desc(), F.col("day")], n_top)
    share = top.groupBy(key).agg(F.sum("EI_daily").alias("_top")).join(
        d.groupBy(key).agg(F.sum("EI_daily").alias("_all")), key
    ).where(F.col("_top") > max_fraction * F.col("_all"))
    years = d.groupBy(key, "_doy").agg(F.count_distinct("_yr").alias("_years"))
    thin = years.where(F.col("_years") < min_years).join(top.select(key, "_doy").distinct(), [key, "_doy"], "left_semi")
    bad = share.join(thin.select(key).distinct(), key, "left_semi").select(key)
    return daily.join(bad, key, "left_anti")


def ei_climatology(daily: DataFrame, key: str = "station") -> DataFrame:
    """Mean daily erosivity for days 1..365 over the calendar years of the record."""
    years = daily.groupBy(key).agg((F.max(F.year("day")) - F.min(F.year("day")) + 1).alias("_n"))
    sums = daily.groupBy(key, tp.doy365(F.col("day")).alias("doy")).agg(F.sum("EI_daily").alias("_s"))
    axis = years.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365))))
    return axis.join(sums, [key, "doy"], "left").select(
        key, "doy", F.coalesce(F.col("_s") / F.col("_n"), F.lit(0.0)).alias("EI_daily_avg")
    )


def cumulative_percent(df: DataFrame, keys: list[str], value: str = "EI_daily_avg", order: str = "doy", prefix: str = "EI_daily") -> DataFrame:
    """Percent of the group total and its running sum; a zero total gives 0.

    A group is a climatology curve: at most one row per day of year, so the
    window is bounded by construction.
    """
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    pct = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value), total) * 100)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{prefix}_percent", pct).withColumn(f"{prefix}_cumsum", F.sum(f"{prefix}_percent").over(run))


def renormalise_percent(df: DataFrame, keys: list[str], percent: str, order: str = "doy", out: str = "EI_daily") -> DataFrame:
    """The same from a percent column: floor at 0, rescale to 100, null becomes 0."""
    w = Window.partitionBy(*keys)
    floored = F.greatest(F.col(percent), F.lit(0.0))
    total = F.sum(floored).over(w)
    pct = F.coalesce(F.try_divide(floored, F.nullif(total, F.lit(0.0))) * 100, F.lit(0.0))
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{out}_percent", pct).withColumn(f"{out}_cumsum", F.sum(f"{out}_percent").over(run))


def group_fraction(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Value over group total; zero total is null."""
    t = with_totals(df, keys, [F.sum(value).alias("_total")])
    return t.withColumn(out, F.try_divide(F.col(value), F.nullif(F.col("_total"), F.lit(0.0)))).drop("_total")


def monthly_ei(curve: DataFrame, keys: list[str], value: str = "EI_daily_avg", attrs: list[str] | None = None) -> DataFrame:
    """Monthly sums of a daily curve; attributes keep one value per group."""
    return curve.groupBy(*keys, tp.month_of_doy(F.col("doy")).alias("month")).agg(
        F.sum(value).alias("EI_month"), *[F.min(a).alias(a) for a in attrs or []]
    )


def monthly_spread(monthly: DataFrame) -> DataFrame:
    """Mean and sd over stations per month."""
    return monthly.groupBy("month").agg(
        F.avg("EI_month").alias("EI_mean"), F.stddev_samp("EI_month").alias("EI_std"), F.count(F.lit(1)).alias("n")
    )


def doy_climatology(df: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """Mean over years per day of a 365-day year; 29 February is dropped."""
    d = df.withColumn("doy", tp.doy_leap_shift(F.col(day))).where(F.col("doy").isNotNull())
    return d.groupBy(*keys, "doy").agg(F.avg(value).alias(value))


def month_climatology(df: DataFrame, keys: list[str], value: str, reduce: str | list[str] = "sum", day: str = "day") -> DataFrame:
    """Reduce within each month, then average the months over the years.

    With ``min`` or ``max`` this is the mean of yearly extremes. Several
    reductions give a column each.
    """
    fns = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}
    names = [reduce] if isinstance(reduce, str) else reduce
    per = df.groupBy(*keys, F.year(day).alias("_y"), F.month(day).alias("month")).agg(*[fns[n](value).alias(f"_{n}") for n in names])
    return per.groupBy(*keys, "month").agg(*[F.avg(f"_{n}").alias(f"monthly_{n}") for n in names])


def month_expand(df: DataFrame, month: str = "month") -> DataFrame:
    """One row per day of the month from month rows."""
    m = F.col(month)
    return df.withColumn("doy", F.explode(F.sequence(tp.first_doy(m), tp.last_doy(m))))


def coverage_stats(df: DataFrame, key: str = "station", time: str = "minute", value: str = "rain") -> DataFrame:
    """First and last time, row count and share of missing values per station."""
    return df.groupBy(key).agg(
        F.min(time).alias("t_min"), F.max(time).alias("t_max"), F.count(F.lit(1)).alias("n"),
        F.avg(F.col(value).isNull().cast("double")).alias("missing_share"),
    )
