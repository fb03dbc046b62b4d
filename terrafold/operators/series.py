"""Gap filling, smoothing, spike removal and filtering of cover time series.

Series are first reduced to one row per (series, day) (``daily_series``), so
a series holds at most as many rows as its record has days, however many
observations fed it. That bound is what lets the operators below order a whole
series in one window or one array.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.hashing import key_digest
from terrafold.operators.filters import CHUNK_DAYS, Trend, Walk, filtered
from terrafold.plans.runs import map_runs

EPS = 1e-6


def daily_series(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Daily means per series; days without a complete set of values are left out."""
    ok = df.dropna(subset=values)
    return ok.groupBy(*keys, F.to_date(time).alias("day")).agg(*[F.avg(v).alias(v) for v in values])


def _w(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("day")


def alr(pv: Column, npv: Column, soil: Column) -> tuple[Column, Column]:
    """Additive log-ratios against soil, fractions kept off 0 and 1."""
    c = lambda v: F.least(F.greatest(v, F.lit(EPS)), F.lit(1 - EPS))
    return F.log(c(pv) / c(soil)), F.log(c(npv) / c(soil))


def alr_inverse(a: Column, b: Column) -> tuple[Column, Column, Column]:
    ea, eb = F.exp(a), F.exp(b)
    d = 1 + ea + eb
    return ea / d, eb / d, 1 / d


def season_phase(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Days since the series' first day, as years and as a yearly phase."""
    first = df.groupBy(*keys).agg(F.min(day).alias("_t0"))
    t = F.datediff(day, "_t0")
    a = F.lit(2 * np.pi) * (t % 365) / 365
    return df.join(first, keys).withColumns(
        {"t": t, "t_years": t / 365, "t_sin": F.sin(a), "t_cos": F.cos(a)}
    ).drop("_t0")


def periods(years: DataFrame, year: str, freq: str = "month") -> DataFrame:
    """Numbered months or Monday-to-Sunday weeks of each year, clipped to it."""
    y = F.col(year).cast("int")
    lo, hi = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))
    first = F.trunc(lo, freq)
    step = F.expr("interval 1 month") if freq == "month" else F.expr("interval 7 days")
    p = years.select(year, F.posexplode(F.sequence(first, hi, step)).alias("_i", "_s"))
    end = F.last_day("_s") if freq == "month" else F.date_add("_s", 6)
    return p.select(
        year, (F.col("_i") + 1).alias("idx"), F.greatest(F.col("_s"), lo).alias("start"), F.least(end, hi).alias("end")
    )


# --- filling -----------------------------------------------------------------


def fill_dates(series: DataFrame, keys: list[str], max_gap: int = 15) -> DataFrame:
    """Synthetic days every ``max_gap`` days strictly inside longer gaps."""
    d = series.select(*keys, "day").distinct().withColumn("_n", F.lead("day").over(_w(keys)))
    gap = d.where(F.datediff("_n", "day") > max_gap)
    steps = F.sequence(F.date_add("day", max_gap), F.date_sub("_n", 1), F.expr(f"interval {max_gap} days"))
    return gap.select(*keys, F.explode(steps).alias("day"))


def gapfill_linear(series: DataFrame, keys: list[str], values: list[str], max_gap: int = 15) -> DataFrame:
    """Observations plus linearly interpolated rows at the fill days, renormalised to sum 1."""
    w = _w(keys)
    nxt = series.withColumns({"_n": F.lead("day").over(w), **{f"_n_{v}": F.lead(v).over(w) for v in values}})
    gap = nxt.where(F.datediff("_n", "day") > max_gap)
    steps = F.sequence(F.date_add("day", max_gap), F.date_sub("_n", 1), F.expr(f"interval {max_gap} days"))
    f = gap.withColumn("_d", F.explode(steps))
    frac = F.datediff("_d", "day") / F.datediff("_n", "day")
    at = {v: F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * frac for v in values}
    total = F.nullif(sum(at.values(), F.lit(0.0)), F.lit(0.0))
    filled = f.select(
        *keys, F.col("_d").alias("day"), *[F.try_divide(e, total).alias(v) for v, e in at.items()], F.lit(1).alias("is_gapfilled")
    )
    return series.select(*keys, "day", *values, F.lit(0).alias("is_gapfilled")).unionByName(filled)


def nearest_date(wanted: DataFrame, available: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Exact day if present, else the nearest day before and after."""
    both = wanted.select(*keys, day, F.lit(1).alias("_w")).unionByName(
        available.select(*keys, day, F.lit(0).alias("_w"))
    ).groupBy(*keys, day).agg(F.max("_w").alias("_w"), F.min("_w").alias("_a"))
    have = F.when(F.col("_a") == 0, F.col(day))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    r = Window.partitionBy(*keys).orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"before": F.last(have, True).over(w), "after": F.last(have, True).over(r)})
    return out.where(F.col("_w") == 1).select(*keys, day, "before", "after")


# --- spikes ------------------------------------------------------------------


def despike(series: DataFrame, keys: list[str], value: str, max_days: int = 10, threshold: float = 0.1) -> DataFrame:
    """Flag points that jump and revert; the point after a removed one is compared with nothing.

    A removed value no longer serves as the previous value, so within a run of
    candidate points every second one is removed: the first, third, and so on.
    """
    w = _w(keys)
    v, p, n = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    up = ((v - p) / p > threshold) & ((v - n) / v > threshold)
    down = ((p - v) / p > threshold) & ((n - v) / v > threshold)
    near = F.datediff(F.lead("day").over(w), "day") <= max_days / 2
    hit = F.when((p != 0) & (v != 0), near & (up | down))
    s = series.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_rn": F.row_number().over(w)})
    # rows since the last non-candidate give the place in the run
    last_calm = F.last(F.when(~F.col("_hit"), F.col("_rn")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_rn") - F.coalesce(last_calm, F.lit(0))
    removed = (F.col("_hit") & (place % 2 == 1)).cast("int")
    return s.withColumn("removed", removed).drop("_hit", "_rn")


def despike_zscore(series: DataFrame, keys: list[str], value: str, rows: int = 10, z_max: float = 3.0) -> DataFrame:
    """Flag points far from a centred rolling mean whose successor is near and calm."""
    w = _w(keys)
    win = w.rowsBetween(-(rows // 2), (rows - 1) // 2)
    full = F.count(value).over(win) == rows
    z = F.when(full, F.try_divide(F.col(value) - F.avg(value).over(win), F.nullif(F.stddev_pop(value).over(win), F.lit(0.0))))
    s = series.withColumn("z", z)
    near = F.datediff(F.lead("day").over(w), "day") <= rows / 2
    calm = F.abs(F.lead("z").over(w)) < z_max
    hit = (F.abs("z") > z_max) & near & calm & F.lag("day").over(w).isNotNull()
    return s.withColumn("removed", F.coalesce(hit, F.lit(False)).cast("int"))


# --- smoothing ---------------------------------------------------------------


def savgol_weights(window: int, order: int) -> list[list[float]]:
    """Row p holds the weights that give the fitted polynomial at position p."""
    x = np.arange(window) - window // 2
    a = np.vander(x, order + 1, increasing=True).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def savgol_window(window: int, order: int, n: int) -> int:
    """The largest odd length within the wish and the series, but one that the order can be fitted to."""
    longest, needed = min(window, n), order + 2
    return max(longest - 1 + longest % 2, needed + 1 - needed % 2)


def savgol(series: DataFrame, keys: list[str], values: list[str], window: int = 7, order: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing by row position, edges from the edge polynomial.

    Each row is a weighted sum of its neighbours; the weights depend on the
    series' length and on the row's distance from both ends. All series of a
    batch are smoothed together (``savgol_fit``). The fractions are
    renormalised afterwards. Series shorter than any usable window keep their
    values.
    """
    new = {v: f"_{v}" for v in values}

    def fit(c: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        s = _whole(savgol_fit(np.column_stack([c[v] for v in values]), starts, window, order))
        return {new[v]: s[:, j] for j, v in enumerate(values)}

    rows = series.select(*keys, "day", *[F.col(v).cast("double").alias(v) for v in values])
    out = map_runs(rows, keys, ["day"], values, fit, dict.fromkeys(new.values(), "double"), together=True)
    return out.select(*keys, "day", *[F.nanvl(n, F.lit(None)).alias(v) for v, n in new.items()])


def savgol_fit(y: np.ndarray, starts: np.ndarray, window: int, order: int) -> np.ndarray:
    """Smoothed rows of the series that begin at ``starts``; a column for each value."""
    length = np.diff(np.append(starts, len(y)))
    size = np.array([savgol_window(window, order, n) for n in range(window + 1)])[np.minimum(length, window)]
    n, k, start = (np.repeat(a, length) for a in (length, size, starts))
    at = np.arange(len(y)) - start
    first = np.clip(at - k // 2, 0, np.maximum(n - k, 0))
    out = y.copy()
    for w in np.unique(size):
        rows = np.flatnonzero((k == w) & (n >= k))
        weights = np.array(savgol_weights(int(w), order))[(at - first)[rows]]
        out[rows] = sum((weights[:, [j]] * y[(start + first)[rows] + j] for j in range(w)), np.zeros((1, 1)))
    return out


#: Entries of the arrays that a fit holds at a time.
SLICE = 1_000_000


def nearest_window(x: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` points nearest to each point of ascending ``x`` begin; both ends move along with the point."""
    if k >= len(x):
        return np.zeros(len(x), np.int64)
    # a window may move on while the point that it would gain is nearer than the one it would lose
    return np.searchsorted(x[:-k] + x[k:], 2 * x, side="left")


def lowess_fit(x: np.ndarray, y: np.ndarray, frac: float, times: np.ndarray | None = None) -> np.ndarray:
    """Local tricube-weighted lines through the ``frac`` nearest points; no robustness rounds.

    ``x`` ascends. ``times`` (draws, points) repeats the fit with each point counted so
    often, over the same windows and distances; where no counted point has
    weight the draw is NaN. The result has a row for each draw then. Memory is
    the window's, however long the series.
    """
    n, k = len(x), int(frac * len(x) + 1e-10)
    if k < 2:
        return y.copy() if times is None else np.where(times[:, :, None] > 0, y, np.nan)
    draws = None if times is None else len(times)
    start = nearest_window(x, k)
    out = np.empty((*(() if draws is None else (draws,)), *y.shape))
    step = max(1, SLICE // (k * (draws or 1)))
    for a in range(0, n, step):
        at = start[a : a + step, None] + np.arange(k)
        dx = x[at] - x[a : a + step, None]
        d = np.abs(dx)
        h = d.max(axis=1, keepdims=True)
        u = np.divide(d, h, out=np.ones_like(d), where=h > 0)
        w = np.where(u < 1, (1 - u**3) ** 3, 0.0)
        if times is not None:
            out[:, a : a + step] = _drawn(w, dx, times[:, at], y[at])
            continue
        sw = w.sum(-1)
        some = np.where(sw > 0, sw, 1.0)
        near = y[at]  # point, neighbour, value
        mx = (w * dx).sum(-1) / some
        my = np.einsum("...ik,ikv->...iv", w, near) / some[..., None]
        from_mean = dx - mx[..., None]
        sxx = (w * from_mean * from_mean).sum(-1)
        sxy = np.einsum("...ik,ikv->...iv", w * from_mean, near)
        flat = sxx <= 1e-9
        slope = np.where(flat[..., None], 0.0, sxy / np.where(flat, 1.0, sxx)[..., None])
        fit = my - slope * mx[..., None]
        out[a : a + step] = np.where(sw[..., None] > 0, fit, y[a : a + step])
    return out


def _drawn(w: np.ndarray, dx: np.ndarray, times: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The fits of ``lowess_fit`` for draws: weighted sums over a point's neighbours for all draws and moments by one product."""
    moments = np.concatenate([np.ones_like(dx)[..., None], dx[..., None], (dx * dx)[..., None], near, dx[..., None] * near], axis=-1)
    sums = times.transpose(1, 0, 2).astype(float) @ (w[..., None] * moments)  # point, draw, moment
    v = near.shape[-1]
    sw, sx, sxx, sy, sxy = sums[..., 0], sums[..., 1], sums[..., 2], sums[..., 3 : 3 + v], sums[..., 3 + v :]
    some = np.where(sw > 0, sw, 1.0)
    mx, my = sx / some, sy / some[..., None]
    spread = sxx - sx * mx
    flat = spread <= 1e-9
    slope = np.where(flat[..., None], 0.0, (sxy - mx[..., None] * sy) / np.where(flat, 1.0, spread)[..., None])
    fit = np.where(sw[..., None] > 0, my - slope * mx[..., None], np.nan)
    return fit.transpose(1, 0, 2)


def _whole(s: np.ndarray) -> np.ndarray:
    """Fractions with a sum of 1; NaN where the sum is 0."""
    total = s.sum(-1, keepdims=True)
    return np.divide(s, total, out=np.full_like(s, np.nan), where=total != 0)


def loess(series: DataFrame, keys: list[str], values: list[str], frac: float = 0.3) -> DataFrame:
    """Locally weighted regression per series, fractions renormalised. Days are rows of their own."""
    new = {v: f"_{v}" for v in values}

    def fit(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = c["day"].astype(float)
        s = _whole(lowess_fit(x - x[0], np.column_stack([c[v] for v in values]), frac))
        return {new[v]: s[:, j] for j, v in enumerate(values)}

    rows = series.select(*keys, "day", *[F.col(v).cast("double").alias(v) for v in values])
    out = map_runs(rows, keys, ["day"], ["day", *values], fit, dict.fromkeys(new.values(), "double"))
    return out.select(*keys, "day", *[F.nanvl(n, F.lit(None)).alias(v) for v, n in new.items()])


def nan_quantiles(a: np.ndarray, probs: tuple[float, ...]) -> list[np.ndarray]:
    """Linearly interpolated quantiles along the first axis of what is not NaN; NaN where nothing is left."""
    s = np.sort(a, axis=0)  # NaNs go last
    last = np.maximum((~np.isnan(s)).sum(axis=0) - 1, 0)
    out = []
    for p in probs:
        at = last * p
        lo = np.floor(at).astype(np.int64)
        low, high = (np.take_along_axis(s, i[None], axis=0)[0] for i in (lo, np.minimum(lo + 1, last)))
        out.append(low + (high - low) * (at - lo))
    return out


#: How many of 256 byte values give a count of 0, of up to 1, of up to 2 and so on: a Poisson law of mean 1.
COUNTS = np.array([94, 188, 235, 251, 255])
#: Bytes, and so draws, of a digest.
DIGEST = 16


def loess_band(series: DataFrame, keys: list[str], values: list[str], frac: float = 0.3, draws: int = 48, seed: int = 42) -> DataFrame:
    """Mean and 5/95 % band of LOESS over bootstrap draws, normalised per draw.

    A draw counts each day of the series 0, 1, 2 or more times, by a byte of a
    digest of the series, the day and the draw (``COUNTS``), so all draws share
    one window a day, a retried task repeats them and SQL can. Draws in which
    none of a day's neighbours count say nothing about that day.
    """
    cols = [f"{v}_{q}" for v in values for q in ("mean", "q05", "q95")]
    rows = series.select(*keys, "day", *[F.col(v).cast("double").alias(v) for v in values])
    digests = [F.unhex(key_digest(*[F.col(k) for k in keys], F.unix_date("day"), F.lit(i), seed=seed)) for i in range(-(-draws // DIGEST))]
    rows = rows.withColumn("_draws", F.concat(*digests))

    def fit(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        raw = np.frombuffer(b"".join(c["_draws"]), np.uint8).reshape(len(c["day"]), -1)[:, :draws]
        times = np.searchsorted(COUNTS, raw.T, side="right")
        x = c["day"].astype(float)
        fits = _whole(lowess_fit(x - x[0], np.column_stack([c[v] for v in values]), frac, times))
        out = {}
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore")  # a day without any draw is NaN
            low, high = nan_quantiles(fits, (0.05, 0.95))
            mean = np.nanmean(fits, axis=0)
        for j, v in enumerate(values):
            out |= {f"{v}_mean": mean[:, j], f"{v}_q05": low[:, j], f"{v}_q95": high[:, j]}
        return out

    out = map_runs(rows, keys, ["day"], ["day", "_draws", *values], fit, dict.fromkeys(cols, "double"))
    return out.select(*keys, "day", *[F.nanvl(c, F.lit(None)).alias(c) for c in cols])


def interpolate_at(smooth: DataFrame, keys: list[str], values: list[str], at: DataFrame) -> DataFrame:
    """A smoothed series at the days ``at`` (keys, day), renormalised.

    Between two days of the series linearly, beyond its ends with the end's
    values; days of the series itself keep theirs. Series without any day in
    ``smooth`` have no result.
    """
    rows = smooth.select(*keys, "day", *[F.col(v).cast("double").alias(v) for v in values], F.lit(0.0).alias("_at"))
    rows = rows.unionByName(at.select(*keys, "day", F.lit(1.0).alias("_at")), allowMissingColumns=True)
    new = {v: f"_{v}" for v in values}

    def fit(c: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        wanted, s = _between(c["day"], c["_at"] == 1, np.column_stack([c[v] for v in values]), starts)
        return {"_wanted": wanted} | {new[v]: s[:, j] for j, v in enumerate(values)}

    # a day of the series comes before the same day of ``at``
    told = {"_wanted": "boolean"} | dict.fromkeys(new.values(), "double")
    out = map_runs(rows, keys, ["day", "_at"], ["day", "_at", *values], fit, told, together=True)
    return out.where("_wanted").select(*keys, "day", *[F.nanvl(n, F.lit(None)).alias(v) for v, n in new.items()])


def _between(day: np.ndarray, asked: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their day that is ``asked`` for, and their values from the rows around them that are not."""
    n, place = len(day), np.arange(len(day))
    start = np.repeat(starts, np.diff(np.append(starts, n)))
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    before = np.maximum.accumulate(np.where(asked, -1, place))
    after = np.minimum.accumulate(np.where(asked, n, place)[::-1])[::-1]
    has, more = before >= start, after < end
    after = np.where(more & ~(has & (day[before] == day)), after, before)
    before = np.where(has, before, after)
    again = (place > start) & (day == np.roll(day, 1)) & np.roll(asked, 1)
    wanted = asked & ~again & (has | more)
    p, q, d = before[wanted], after[wanted], day[wanted]
    span = day[q] - day[p]
    share = np.where(span > 0, (d - day[p]) / np.where(span > 0, span, 1), 0.0)[:, None]
    out = np.full(y.shape, np.nan)
    out[wanted] = _whole(y[p] + share * (y[q] - y[p]))
    return wanted, out


# --- Kalman filters ----------------------------------------------------------


def kalman_rw(
    series: DataFrame, keys: list[str], value: str, sd: str, at: DataFrame | None = None, q: float = 1e-5, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Random-walk filter on the daily axis with a variance per observation."""
    out = filtered(series, keys, [(value, sd)], at, Walk(q), chunk_days)
    return out.select(*keys, "day", F.col(f"{value}.x").alias("level"), F.sqrt(f"{value}.p").alias("level_sd"))


def kalman_llt(
    series: DataFrame, keys: list[str], value: str, sd: str, at: DataFrame | None = None, q: float = 1e-6, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """Level-and-trend filter on the daily axis with a variance per observation."""
    out = filtered(series, keys, [(value, sd)], at, Trend(q), chunk_days)
    return out.select(
        *keys, "day", F.col(f"{value}.x").alias("level"), F.col(f"{value}.v").alias("trend"), F.sqrt(f"{value}.p00").alias("level_sd")
    )


def kalman_fractions(
    series: DataFrame, keys: list[str], values: list[str], sds: list[str], at: DataFrame | None = None, q: float = 1e-6
) -> DataFrame:
    """Filter the three fractions, clip to 0..1 and renormalise."""
    out = filtered(series, keys, list(zip(values, sds)), at, Trend(q))
    clip = {v: F.least(F.greatest(F.col(f"{v}.x"), F.lit(0.0)), F.lit(1.0)) for v in values}
    total = F.nullif(sum(clip.values(), F.lit(0.0)), F.lit(0.0))
    return out.select(
        *keys, "day", *[F.try_divide(e, total).alias(v) for v, e in clip.items()], *[F.sqrt(f"{v}.p00").alias(f"{v}_sd") for v in values]
    )


def combine_uncertainty(filtered: DataFrame, ensemble: DataFrame, keys: list[str], filter_sd: str, ensemble_sd: str, out: str) -> DataFrame:
    """Total sd from filter and ensemble; days without an ensemble add nothing."""
    j = filtered.join(ensemble.select(*keys, "day", ensemble_sd), [*keys, "day"], "left")
    e = F.coalesce(F.col(ensemble_sd), F.lit(0.0))
    return j.withColumn(out, F.sqrt(F.col(filter_sd) ** 2 + e * e)).drop(ensemble_sd)


def lagged_features(df: DataFrame, keys: list[str], value: str, weeks: int = 12) -> DataFrame:
    """Weekly means with lags of 1, 4 and ``weeks`` weeks and rolling means up to them.

    Lags are by calendar week: absent weeks give nulls, not the previous row.
    """
    monday = F.trunc("day", "week")
    wk = df.groupBy(*keys, (F.floor((F.unix_date(monday) - 4) / 7)).cast("long").alias("week")).agg(F.avg(value).alias(value))
    w = Window.partitionBy(*keys).orderBy("week")
    lag = lambda n: F.max(value).over(w.rangeBetween(-n, -n))
    roll = lambda n: F.avg(value).over(w.rangeBetween(-(n - 1), 0))
    spans = sorted({1, 4, weeks})
    return wk.withColumns(
        {**{f"lag_{n}": lag(n) for n in spans}, **{f"mean_{n}": roll(n) for n in spans if n > 1}}
    )
