"""Gaussian-process gap filling with fixed kernels, one field per fit, on all rows.

Series of one value per day are solved exactly: rows with equal inputs are
merged into their mean first, with the noise divided by their number, so a fit
holds a day once, however many rows there are. Fits over space as well use a
basis: the kernel at points chosen from the field's own days and positions until
the prior variance that they leave unexplained is below a tolerance. Their normal
equations are sums over rows, so every row counts, partial sums are all that is
shuffled, and what a prediction needs of a field is one small matrix.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.series import EPS, alr, alr_inverse, fill_dates
from terrafold.plans.ordered import exact_quantiles, spread, with_totals
from terrafold.plans.runs import map_runs
from terrafold.session import cut_lineage

#: Rows that meet a field's basis together, and how many kernel rows are held at a time.
BLOCK_ROWS, SLICE_ROWS = 20_000, 2000
#: Share of the prior variance that the basis may leave unexplained at any of its candidates. Predictions are within
#: about 0.02 of the exact ones on the mean (in sd of the values, root mean square).
TOLERANCE = 0.02
#: A field's distinct inputs up to which all are candidates; of more, its places (merged to 1/8 of a unit) times its days.
CANDIDATES = 2000
#: Points of a basis at most. A field that needs more keeps the tolerance that these reach.
MOST_POINTS = 1500
#: Rows and points of a field together up to which one task fits it whole, as arrays.
SMALL = 500
#: Rows of a field, raw and clean, up to which one task takes all of them for its median series; some 50 bytes each, a few times over.
WHOLE = 200_000
# Noise of the log-ratios as a share of their variance, and its limits.
NOISE_SHARE, NOISE_LIMITS = 0.05, (1e-4, 0.5)


def matern15(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = np.sqrt(3.0) * np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1), 0.0))
    return (1.0 + r) * np.exp(-r)


def rbf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


def gp_predict(
    x: np.ndarray, y: np.ndarray, noise: np.ndarray, at: np.ndarray, kernel=matern15,
    scale: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sd at ``at`` for each column of ``y``; inputs already scaled by length.

    ``noise`` is the variance per row on the standardised scale, which
    ``scale`` (mean, sd) gives where rows stand for several.
    """
    m, s = scale or (y.mean(0), y.std(0))
    s = np.where(s > 1e-12, s, 1.0)
    k = kernel(x, x) + np.diag(noise + 1e-10)
    ks = kernel(x, at)
    # one factorisation serves the mean and the variance
    sol = np.linalg.solve(k, np.column_stack([(y - m) / s, ks]))
    mean = ks.T @ sol[:, : y.shape[1]]
    var = np.maximum(1.0 - (ks * sol[:, y.shape[1]:]).sum(0), 0.0)
    return mean * s + m, np.sqrt(var)[:, None] * s


def pivots(points: np.ndarray, kernel, tolerance: float, most: int = MOST_POINTS) -> np.ndarray:
    """Which of the points to take: each time the one whose prior variance the others explain least (pivoted Cholesky)."""
    left, rows = np.ones(len(points)), np.zeros((0, len(points)))
    whole = kernel(points, points) if len(points) <= SMALL else None
    out: list[int] = []
    while len(out) < min(most, len(points)):
        i = int(left.argmax())
        if left[i] <= tolerance:
            break
        if len(out) == len(rows):
            rows = np.vstack([rows, np.zeros((max(16, len(rows)), len(points)))])
        known = rows[: len(out)]
        row = kernel(points[i : i + 1], points)[0] if whole is None else whole[i]
        rows[len(out)] = (row - known[:, i] @ known) / np.sqrt(left[i])
        left = left - rows[len(out)] ** 2
        left[i] = 0.0
        out.append(i)
    return np.array(out, np.int64)


class Basis:
    """The kernel at fixed points, in place of the kernel at every row.

    With the rows' own places as points it is the exact solution.
    """

    def __init__(self, points: np.ndarray, kernel):
        self.points, self.kernel = points, kernel

    def sums(self, x: np.ndarray, y: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What rows add to the normal equations; ``y`` is standardised."""
        k = self.kernel(x, self.points) / np.sqrt(noise)[:, None]
        return k.T @ k, k.T @ (y / np.sqrt(noise)[:, None])

    def solve(self, square: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients, and the matrix that turns basis values into how far the variance falls."""
        own = self.kernel(self.points, self.points) + 1e-8 * np.eye(len(self.points))
        both = np.linalg.inv(own + square)
        return both @ right, np.linalg.inv(own) - both

    def predict(self, coefficients: np.ndarray, fall: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kernel(at, self.points)
        return k @ coefficients, np.sqrt(np.maximum(1.0 - ((k @ fall) * k).sum(1), 0.0))


def _by_blocks(solved: DataFrame, points: DataFrame, field: list[str], fit, schema: str, by: list[str]) -> DataFrame:
    """Run ``fit(solved, points)`` per field and block of points; ``solved`` is bounded for each field."""
    n = with_totals(points, field, [F.count(F.lit(1)).alias("_n")])
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS)
    pts = n.withColumn("_block", F.pmod(F.xxhash64(*by), blocks)).drop("_n")
    copies = pts.select(*field, "_block").distinct().join(solved, field)
    # fresh column identities: both sides descend from the same table
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)  # no other empty column turns into arrays
        return fit(a, b.reset_index(drop=True))

    g = [*field, "_block"]
    return spread(copies, *g).groupBy(*g).cogroup(spread(pts, *g).groupBy(*g)).applyInPandas(run, schema)


def _days(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return pd.to_datetime(pdf[col]).to_numpy().astype("datetime64[D]").astype(np.int64).astype(float)


def _seasonal(day: np.ndarray, t0: float, xy: np.ndarray) -> np.ndarray:
    """Years since the first day, place in the year, and scaled position."""
    t = day - t0
    a = 2 * np.pi * (t % 365) / 365
    return np.column_stack([t / 365, np.sin(a), np.cos(a), xy])


def _chosen(days: np.ndarray, places: np.ndarray, inputs, kernel, tolerance: float, paired: bool) -> np.ndarray:
    """Points of the basis, as inputs; ``paired`` days and places belong together, others are combined."""
    if not paired:
        at = pivots(inputs(np.full(len(places), days[0]), places), kernel, tolerance)
        on = pivots(inputs(days, np.repeat(places[:1], len(days), axis=0)), kernel, tolerance)
        days, places = np.repeat(days[on], len(at)), np.tile(places[at], (len(on), 1))
    points = inputs(days, places)
    return points[pivots(points, kernel, tolerance)]


def _space_time(
    rows: DataFrame, points: DataFrame, field: list[str], space: list[str], groups: list[list[str]], kernel, noise_for,
    features, least_rows: int = 3, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Prediction (mean and sd of each value) at ``points`` (field, space, day) from all ``rows``.

    The values of one of the ``groups`` share inputs and noise and are solved
    together. ``noise_for(info, value)`` gives the noise variance, by the first
    value of the group, ``features(info, value, day, xy)`` the inputs; ``info``
    has the field's first and last day and the mean and sd of each coordinate
    and value, taken over all its rows.
    """
    values = [v for g in groups for v in g]
    cols = [*space, *values]
    at_types = dict(points.dtypes)
    as_double = lambda names: [F.col(c).cast("double").alias(c) for c in names]
    rows = rows.select(*field, "day", *as_double(cols), F.lit(False).alias("_at"))
    both = cut_lineage(rows.unionByName(points.select(*field, "day", *as_double(space), F.lit(True).alias("_at")), allowMissingColumns=True))
    both = both.dropna(subset=field)  # equal to nothing, so no field
    large = cut_lineage(both.groupBy(*field).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > SMALL).select(*field))
    fit = _fit_of_arrays(space, groups, kernel, noise_for, features, least_rows, tolerance)
    told = dict.fromkeys(["_fitted", *[c for v in values for c in (v, f"{v}_sd")]], "double")
    small = both.join(large, field, "left_anti").withColumnsRenamed({v: f"_y_{v}" for v in values})
    done = map_runs(small, field, ["_at", "day", *space], ["_at", "day", *space, *[f"_y_{v}" for v in values]], fit, told)
    result = [*field, *[F.col(c).cast(at_types[c]).alias(c) for c in space], "day", *[c for c in told if c != "_fitted"]]
    done = done.where(F.col("_fitted") == 1).select(*result)
    if large.isEmpty():
        return done
    rest = both.join(large, field, "left_semi")
    far = _space_time_by_blocks(
        rest.where("not _at").drop("_at"), rest.where("_at").select(*field, *space, "day"), field, space, groups, kernel, noise_for, features, least_rows, tolerance
    )
    return done.unionByName(far.select(*result))


def _fit_of_arrays(space: list[str], groups: list[list[str]], kernel, noise_for, features, least_rows: int, tolerance: float):
    """What ``_space_time_by_blocks`` does, for one field of few rows and points."""

    def fit(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = c["_at"].astype(bool)
        out = {k: np.full(len(at), np.nan) for g in groups for v in g for k in (v, f"{v}_sd")} | {"_fitted": np.zeros(len(at))}
        if (~at).sum() < least_rows or not at.any():
            return out
        day, xy = c["day"].astype(float), np.column_stack([c[s] for s in space])
        middle, spread_ = xy[~at].mean(0), xy[~at].std(0)
        xy = (xy - middle) / np.where(spread_ > 1e-9, spread_, 1.0)
        y = {v: c[f"_y_{v}"][~at] for g in groups for v in g}
        mean, sd = {v: a.mean() for v, a in y.items()}, {v: a.std() for v, a in y.items()}
        r = SimpleNamespace(_t0=day[~at].min(), _t1=day[~at].max(), **{f"_mean_{v}": m for v, m in mean.items()}, **{f"_sd_{v}": d for v, d in sd.items()})
        # rows come ordered, so equal inputs follow each other
        step = np.column_stack([day, xy])[~at]
        first = np.append(True, (step[1:] != step[:-1]).any(1))
        for g in groups:
            x = features(r, g[0], day[~at], xy[~at])
            basis = Basis(x[first][pivots(x[first], kernel, tolerance)], kernel)
            m, d = np.array([mean[v] for v in g]), np.array([sd[v] if sd[v] > 1e-12 else 1.0 for v in g])
            standard = (np.column_stack([y[v] for v in g]) - m) / d
            solved = basis.solve(*basis.sums(x, standard, np.full(len(x), noise_for(r, g[0]))))
            told, dev = basis.predict(*solved, features(r, g[0], day[at], xy[at]))
            for k, v in enumerate(g):
                out[v][at], out[f"{v}_sd"][at] = told[:, k] * d[k] + m[k], dev * d[k]
        out["_fitted"][at] = 1.0
        return out

    return fit


def _space_time_by_blocks(
    rows: DataFrame, points: DataFrame, field: list[str], space: list[str], groups: list[list[str]], kernel, noise_for,
    features, least_rows: int, tolerance: float,
) -> DataFrame:
    """``_space_time`` for fields of any size: their rows and points are dealt to tasks in blocks."""
    values = [v for g in groups for v in g]
    lead = {g[0]: g for g in groups}
    cols = [*space, *values]
    info = rows.groupBy(*field).agg(
        F.min("day").alias("_t0"), F.max("day").alias("_t1"), F.count(F.lit(1)).alias("_n"),
        *[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    ).where(F.col("_n") >= least_rows)
    names = [c for c in info.columns if c not in field]
    info = cut_lineage(info)
    types = dict(rows.dtypes)
    keyed = ", ".join(f"{c} {types[c]}" for c in field)
    meta = ", ".join(f"{c} {t}" for c, t in info.dtypes if c not in field)

    def scaled(r, pdf: pd.DataFrame) -> np.ndarray:
        sd = np.array([getattr(r, f"_sd_{c}") for c in space], float)
        return (pdf[space].to_numpy(float) - np.array([getattr(r, f"_mean_{c}") for c in space], float)) / np.where(sd > 1e-9, sd, 1.0)

    def scales(r, g: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sd = np.array([getattr(r, f"_sd_{v}") for v in g])
        return np.array([getattr(r, f"_mean_{v}") for v in g]), np.where(sd > 1e-12, sd, 1.0)

    # candidates: a field's distinct inputs, or its merged places and its days
    inputs = cut_lineage(rows.select(*field, "day", *space).distinct().join(info.select(*field), field))
    many = inputs.groupBy(*field).agg(F.count(F.lit(1)).alias("_inputs"))
    sized = inputs.join(many, field)
    large = sized.where(F.col("_inputs") > CANDIDATES).join(info, field)
    cell = [F.round(8 * F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}"))).alias(f"_c_{c}") for c in space]
    places = large.groupBy(*field, *cell).agg(F.min(F.struct(*space)).alias("_s")).select(*field, F.lit("place").alias("_kind"), F.lit(None).cast("date").alias("day"), *[F.col(f"_s.{c}").alias(c) for c in space])
    days = large.select(*field, "day").distinct().select(*field, F.lit("day").alias("_kind"), "day", *[F.lit(0.0).alias(c) for c in space])
    paired = sized.where(F.col("_inputs") <= CANDIDATES).select(*field, F.lit("both").alias("_kind"), "day", *space)
    candidates = paired.unionByName(places).unionByName(days).join(info, field)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_kind", "day", *space], ignore_index=True)
        r = _Info(dict(zip(pdf.columns, pdf.iloc[0])))
        both = pdf["_kind"].iloc[0] == "both"
        at = pdf if both else pdf[pdf["_kind"] == "place"]
        on = pdf if both else pdf[pdf["_kind"] == "day"]
        out = []
        for v in lead:
            p = _chosen(_days(on, "day"), scaled(r, at), lambda day, xy: features(r, v, day, xy), kernel, tolerance, both)
            out.append((*[pdf.iloc[0][n] for n in [*field, *names]], v, p.shape[1], p.ravel()))
        return pd.DataFrame(out, columns=[*field, *names, "_v", "_dims", "_p"])

    based = f"{keyed}, {meta}, _v string, _dims int, _p array<double>"
    chosen = cut_lineage(spread(candidates, *field).groupBy(*field).applyInPandas(choose, based))

    def basis_of(own) -> Basis:
        return Basis(np.array(own["_p"], float).reshape(-1, int(own["_dims"])), kernel)

    def partial(bases: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        """What a block of rows adds to its field's sums."""
        out = []
        for _, own in bases.iterrows():
            r, v, basis = _Info(own.to_dict()), own["_v"], basis_of(own)
            mean, sd = scales(r, lead[v])
            x, y = features(r, v, _days(pdf, "day"), scaled(r, pdf)), (pdf[lead[v]].to_numpy(float) - mean) / sd
            noise, total = noise_for(r, v), None
            for i in range(0, len(x), SLICE_ROWS):
                more = basis.sums(x[i : i + SLICE_ROWS], y[i : i + SLICE_ROWS], np.full(len(x[i : i + SLICE_ROWS]), noise))
                total = more if total is None else tuple(map(np.add, total, more))
            out.append((*[own[c] for c in field], v, total[0].ravel(), total[1].ravel()))
        return pd.DataFrame(out, columns=[*field, "_v", "_a", "_b"])

    sums = f"{keyed}, _v string, _a array<double>, _b array<double>"
    parts = _by_blocks(chosen, rows, field, partial, sums, ["day", *space])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v, all_ in pdf.groupby("_v"):
            own = all_.iloc[0]
            b = np.sum(all_["_b"].tolist(), axis=0).reshape(-1, len(lead[v]))
            a = np.sum(all_["_a"].tolist(), axis=0).reshape(len(b), len(b))
            c, fall = basis_of(own).solve(a, b)
            out.append((*[own[n] for n in [*field, *names]], v, own["_dims"], own["_p"], c.ravel(), fall.ravel()))
        return pd.DataFrame(out, columns=[*field, *names, "_v", "_dims", "_p", "_c", "_f"])

    solved = spread(parts.join(chosen, [*field, "_v"]), *field).groupBy(*field).applyInPandas(solve, f"{based}, _c array<double>, _f array<double>")
    at_types = dict(points.dtypes)
    schema = ", ".join(f"{c} {at_types[c]}" for c in [*field, *space, "day"]) + ", " + ", ".join(f"{v} double, {v}_sd double" for v in values)

    def predict(fits: pd.DataFrame, pt: pd.DataFrame) -> pd.DataFrame:
        out = pt[[*field, *space, "day"]].copy()
        for _, own in fits.iterrows():
            r, v = _Info(own.to_dict()), own["_v"]
            g, basis = lead[v], basis_of(own)
            c = np.array(own["_c"]).reshape(-1, len(g))
            fall = np.array(own["_f"]).reshape(len(c), len(c))
            x = features(r, v, _days(pt, "day"), scaled(r, pt))
            told = [basis.predict(c, fall, x[i : i + SLICE_ROWS]) for i in range(0, len(x), SLICE_ROWS)]
            mean, sd = (np.concatenate(t) for t in zip(*told))
            for k, (name, middle, scale) in enumerate(zip(g, *scales(r, g))):
                out[name], out[f"{name}_sd"] = mean[:, k] * scale + middle, sd * scale
        return out[[*field, *space, "day", *[c for v in values for c in (v, f"{v}_sd")]]]

    return _by_blocks(cut_lineage(solved), points, field, predict, schema, [*space, "day"])


class _Info:
    """A field's numbers by name; days as day counts."""

    def __init__(self, values: dict):
        for k, v in values.items():
            setattr(self, k, v)
        for k in ("_t0", "_t1"):
            setattr(self, k, float(pd.Timestamp(values[k]).to_numpy().astype("datetime64[D]").astype(np.int64)))


def quality_flag(df: DataFrame, field: list[str], unc: str, out: str = "fc_quality_flag") -> DataFrame:
    """1 above the 80 % and 2 above the 95 % quantile of the uncertainty of all of a field's rows."""
    q = exact_quantiles(df, field, unc, {"_p80": 0.8, "_p95": 0.95})
    u = F.col(unc)
    j = df.join(q, field, "left")
    return j.withColumn(out, F.when(u > F.col("_p95"), 2).when(u > F.col("_p80"), 1).otherwise(0)).drop("_p80", "_p95")


def gapfill_gp(
    clean: DataFrame, field: list[str], pixel: list[str], targets: DataFrame | None = None, max_gap: int = 15,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Observations plus GP rows at the fill days, in log-ratio space.

    Trained on all clean rows of a field over time, season and position;
    predicted for the ``targets`` pixels, or for every pixel. Columns: keys,
    ``day``, pv, npv, soil. Fields of fewer than three rows get no fill rows.
    ``tolerance`` is the share of prior variance that a field's basis may leave
    unexplained; a smaller one takes more points.
    """
    a, b = alr(F.col("pv"), F.col("npv"), F.col("soil"))
    rows = clean.select(*field, *pixel, "day", a.alias("_a"), b.alias("_b"))
    mine = clean if targets is None else clean.join(targets.select(*field, *pixel).distinct(), [*field, *pixel], "left_semi")
    fills = fill_dates(mine, [*field, *pixel], max_gap)

    def noise_for(r: _Info, _: str) -> float:
        spread_ = (r._sd__a**2 + r._sd__b**2) / 2
        return 2 * float(np.clip(NOISE_SHARE * spread_, *NOISE_LIMITS))

    features = lambda r, _, day, xy: _seasonal(day, r._t0, xy)
    pred = _space_time(rows, fills, field, pixel, [["_a", "_b"]], matern15, noise_for, features, tolerance=tolerance)
    pred = cut_lineage(pred.withColumn("_unc", F.sqrt(F.col("_a_sd") ** 2 + F.col("_b_sd") ** 2)))
    pred = quality_flag(pred, field, "_unc")
    p, n, so = alr_inverse(F.col("_a"), F.col("_b"))
    filled = pred.select(
        *field, *pixel, "day", p.alias("pv"), n.alias("npv"), so.alias("soil"), F.lit(True).alias("is_gapfilled"), "fc_quality_flag"
    )
    kept = mine.select(
        *field, *pixel, "day", "pv", "npv", "soil", F.lit(False).alias("is_gapfilled"), F.lit(0).alias("fc_quality_flag")
    )
    return kept.unionByName(filled)


def _merged(series: DataFrame, keys: list[str], axis: Column, values: list[str], noise: dict[str, Column]) -> DataFrame:
    """Rows of equal inputs as one: their mean by precision, their number, sum and sum of squares."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for v in values:
        w = 1 / noise[v]
        aggs += [
            (F.sum(F.col(v) * w) / F.sum(w)).alias(v), (1 / F.sum(w)).alias(f"_r_{v}"),
            F.sum(v).alias(f"_s_{v}"), F.sum(F.col(v) * F.col(v)).alias(f"_q_{v}"),
        ]
    return series.groupBy(*keys, axis.cast("double").alias("_x")).agg(*aggs)


def _by_series(rows: DataFrame, points: DataFrame, keys: list[str], fit, values: list[str]) -> DataFrame:
    """(keys, day, each value and its sd) at the points: ``fit(x, means, noise, stats, at)`` on each series of merged rows.

    ``stats`` has the mean and sd of each value over all raw rows. Series of fewer than three raw rows have no result.
    """
    cols = [f"_{p}_{v}" for v in values for p in "rsq"]
    told = {f"_{v}_{n}": "double" for v in values for n in ("m", "d")}
    both = rows.withColumn("_at", F.lit(False)).unionByName(points.select(*keys, "day", "_x", F.lit(True).alias("_at")), allowMissingColumns=True)

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = c["_at"].astype(bool)
        out = {k: np.full(len(at), np.nan) for k in told}
        n = c["_n"][~at].sum()
        if n < 3 or not at.any():
            return out
        for v in values:
            m = c[f"_s_{v}"][~at].sum() / n
            sd = float(np.sqrt(max(c[f"_q_{v}"][~at].sum() / n - m * m, 0.0)))
            out[f"_{v}_m"][at], out[f"_{v}_d"][at] = fit(c["_x"][~at], c[v][~at], c[f"_r_{v}"][~at], (m, sd), c["_x"][at])
        return out

    done = map_runs(both, keys, ["_at", "_x"], ["_at", "_x", "_n", *values, *cols], run, told).where("_at")
    some = done.where(~F.isnan(f"_{values[0]}_d"))
    return some.select(*keys, "day", *[F.col(f"_{v}_{n}").alias(o) for v in values for n, o in (("m", v), ("d", f"{v}_sd"))])


def weighted_quantiles(values: np.ndarray, times: np.ndarray, probs: tuple[float, ...]) -> np.ndarray:
    """Linearly interpolated quantiles of values that each count ``times`` times."""
    order = np.argsort(values)
    upto = np.cumsum(times[order])
    at = (upto[-1] - 1) * np.array(probs)
    low, high = (values[order][np.searchsorted(upto, i, side="right")] for i in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def gapfill_gp_median(raw: DataFrame, clean: DataFrame | None, field: list[str], pixel: list[str], whole: int = WHOLE) -> DataFrame:
    """GP on the field's median series plus each pixel's mean log-ratio offset.

    Predicts every raw (pixel, day) from the ``clean`` rows, or, without them, from
    the raw ones, which are then made once; log-ratios are clamped to the median
    series' range widened by half on both sides. Fields of up to ``whole`` rows, raw and
    clean ones counted, move once and are fitted by one task as arrays, larger ones by groupings and joins.
    """
    V = ["pv", "npv", "soil"]
    keys = [*field, *pixel, "day"]
    at, known = F.lit(True).alias("_at"), F.lit(True).alias("_known")
    if clean is None:
        both = raw.select(*keys, *V, at, known)
    else:
        rows = raw.select(*keys, *[F.lit(None).cast("double").alias(v) for v in V], at, F.lit(False).alias("_known"))
        both = rows.unionByName(clean.select(*keys, *[F.col(v).cast("double").alias(v) for v in V], F.lit(False).alias("_at"), known))
    both = cut_lineage(both.dropna(subset=[*field, "day"]))  # equal to nothing, so in no field and on no day
    large = cut_lineage(both.groupBy(*field).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > whole).select(*field))
    # arrays hold nulls as NaN; what is NaN itself is above all values, to the median and to the log-ratios, and so is infinity
    small = both.join(large, field, "left_anti").select(
        *keys, "_at", "_known", *[F.nanvl(v, F.lit(float("inf"))).alias(v) for v in V],
        F.xxhash64(F.lit(0), *pixel).alias("_pixel"), reduce(Column.__or__, [F.col(c).isNull() for c in pixel], F.lit(False)).alias("_nowhere"),
    )
    told = dict.fromkeys(["_ca", "_cb", "fc_quality_flag"], "double")
    done = map_runs(small, field, ["day"], ["day", "_pixel", "_nowhere", "_at", "_known", *V], _median_fit, told).where("_at")
    done = done.where(~F.isnan("_ca"))
    p, n, so = alr_inverse(F.col("_ca"), F.col("_cb"))
    result = [*keys, p.alias("pv"), n.alias("npv"), so.alias("soil"), F.col("fc_quality_flag").cast("int").alias("fc_quality_flag")]
    done = done.select(*result)
    if large.isEmpty():
        return done
    rest = both.join(large, field, "left_semi")
    return done.unionByName(_median_by_joins(rest.where("_at"), rest.where("_known"), field, pixel).select(*done.columns))


def _median_fit(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What ``_median_by_joins`` does, for one field's rows as they are ordered by day."""
    n = len(c["day"])
    out = {k: np.full(n, np.nan) for k in ("_ca", "_cb", "fc_quality_flag")}
    at, known = c["_at"].astype(bool), c["_known"].astype(bool)
    values = np.column_stack([c[v] for v in ("pv", "npv", "soil")])
    valid = known & ~np.isnan(values).all(1)
    days, day = np.unique(c["day"], return_inverse=True)
    medians = np.column_stack([_medians(values[valid, k], day[valid], len(days)) for k in range(3)])
    seen = np.bincount(day[valid], minlength=len(days)) > 0
    rows = np.bincount(day[at], minlength=len(days))
    if seen.sum() < 3 or not at.any():
        return out
    y = _ratios(medians[seen])
    t = days.astype(float)[:, None]
    m, s = t[seen].mean(), max(t[seen].std(), 1.0)
    told = rows > 0
    mean, sd = gp_predict((t[seen] - m) / s, y, np.full(len(y), 0.05), (t[told] - m) / s, rbf)
    # quantiles over rows: a day counts once per pixel observed on it
    unc = np.sqrt((sd * sd).sum(1))
    flag = np.full(len(days), np.nan)
    flag[told] = (unc[:, None] > weighted_quantiles(unc, rows[told], (0.8, 0.95))).sum(1)
    series = np.full((len(days), 2), np.nan)
    series[told] = mean
    # a pixel's mean distance from the medians of its own days
    off = known & seen[day] & ~c["_nowhere"].astype(bool)
    from_median = np.full((len(days), 2), np.nan)
    from_median[seen] = y
    pixels, pixel = np.unique(c["_pixel"], return_inverse=True)
    apart = _ratios(values[off]) - from_median[day[off]]
    times = np.maximum(np.bincount(pixel[off], minlength=len(pixels)), 1)
    offset = np.column_stack([np.bincount(pixel[off], apart[:, k], len(pixels)) for k in range(2)]) / times[:, None]
    offset = np.where(c["_nowhere"].astype(bool)[:, None], 0.0, offset[pixel])
    low, high = y.min(0), y.max(0)
    ratio = np.clip(series[day] + offset, low - 0.5 * (high - low), high + 0.5 * (high - low))
    out["_ca"][at], out["_cb"][at] = ratio[at].T
    out["fc_quality_flag"][at] = flag[day[at]]
    return out


def _ratios(values: np.ndarray) -> np.ndarray:
    """``alr`` of columns pv, npv, soil; a missing fraction counts as the least one, as it does there."""
    v = np.where(np.isnan(values), EPS, np.clip(values, EPS, 1 - EPS))
    return np.log(v[:, :2] / v[:, 2:])


def _medians(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of each of ``n`` groups' values that are not missing, NaN where there is none."""
    some = ~np.isnan(values)
    values, group = values[some], group[some]
    values = values[np.lexsort((values, group))]
    size = np.bincount(group, minlength=n)
    end = np.cumsum(size)
    out, full = np.full(n, np.nan), size > 0
    start, size = (end - size)[full], size[full]
    out[full] = 0.5 * values[start + (size - 1) // 2] + 0.5 * values[start + size // 2]
    return out


def _median_by_joins(raw: DataFrame, clean: DataFrame, field: list[str], pixel: list[str]) -> DataFrame:
    """``gapfill_gp_median`` for fields of any size: only their days and their pixels' offsets are held whole."""
    V = ["pv", "npv", "soil"]
    a, b = alr(F.col("pv"), F.col("npv"), F.col("soil"))
    # a group is a field's pixels on one day, so its values may meet in one buffer
    med = clean.where(F.coalesce(*V).isNotNull()).groupBy(*field, "day").agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in V])
    med = med.select(*field, "day", a.alias("_ma"), b.alias("_mb"))
    off = clean.select(*field, *pixel, "day", a.alias("_a"), b.alias("_b")).join(med, [*field, "day"]).groupBy(*field, *pixel).agg(
        F.avg(F.col("_a") - F.col("_ma")).alias("_oa"), F.avg(F.col("_b") - F.col("_mb")).alias("_ob")
    )
    rows = raw.groupBy(*field, "day").agg(F.count(F.lit(1)).cast("double").alias("_rows"))
    days = med.select("*", F.lit(0.0).alias("_rows")).unionByName(rows, allowMissingColumns=True)
    days = days.groupBy(*field, "day").agg(F.max("_ma").alias("_ma"), F.max("_mb").alias("_mb"), F.max("_rows").alias("_rows"))
    told = ["_ga", "_gb", "fc_quality_flag", "_ma0", "_ma1", "_mb0", "_mb1"]

    def fit(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {k: np.full(len(c["day"]), np.nan) for k in told}
        known, at = ~np.isnan(c["_ma"]), c["_rows"] > 0
        if known.sum() < 3 or not at.any():
            return out
        y = np.column_stack([c["_ma"], c["_mb"]])[known]
        t = c["day"].astype(float)[:, None]
        m, s = t[known].mean(), max(t[known].std(), 1.0)
        mean, sd = gp_predict((t[known] - m) / s, y, np.full(len(y), 0.05), (t[at] - m) / s, rbf)
        out["_ga"][at], out["_gb"][at] = mean.T
        # quantiles over rows: a day counts once per pixel observed on it
        unc = np.sqrt((sd * sd).sum(1))
        out["fc_quality_flag"][at] = (unc[:, None] > weighted_quantiles(unc, c["_rows"][at], (0.8, 0.95))).sum(1)
        for j, k in enumerate(("_ma", "_mb")):
            out[f"{k}0"][at], out[f"{k}1"][at] = y[:, j].min(), y[:, j].max()
        return out

    # a median series has one row per day, and so have the dates
    g = map_runs(days, field, ["day"], ["day", "_ma", "_mb", "_rows"], fit, dict.fromkeys(told, "double"))
    g = g.where(~F.isnan("_ga")).select(*field, "day", *told).withColumn("fc_quality_flag", F.col("fc_quality_flag").cast("int"))
    j = raw.select(*field, *pixel, "day").join(g, [*field, "day"]).join(off, [*field, *pixel], "left")

    def clamp(c: str) -> Column:
        lo, hi = F.col(f"_m{c}0"), F.col(f"_m{c}1")
        v = F.col(f"_g{c}") + F.coalesce(F.col(f"_o{c}"), F.lit(0.0))
        return F.least(F.greatest(v, lo - 0.5 * (hi - lo)), hi + 0.5 * (hi - lo))

    p, n, so = alr_inverse(F.col("_ca"), F.col("_cb"))
    j = j.withColumns({"_ca": clamp("a"), "_cb": clamp("b")})
    return j.select(*field, *pixel, "day", p.alias("pv"), n.alias("npv"), so.alias("soil"), "fc_quality_flag")


def gapfill_gp_doy(
    series: DataFrame, keys: list[str], values: list[str], max_gap: int = 15, noise: dict[str, str] | None = None,
    space: list[str] | None = None, at: DataFrame | None = None, axis: str = "doy",
) -> DataFrame:
    """Plain GP on the day of year, each fraction by itself, renormalised afterwards.

    Predicts the days ``at`` (keys, day), or else the fill days. The length
    scale is 20 days for a varying fraction (sd above 0.2), else 80. ``axis``
    may be ``day`` for the absolute day. ``space`` adds scaled coordinates as
    inputs and takes the basis form. With ``noise`` (variance column per
    fraction) rows carry their own noise, and the result has bounds of 1.96
    sd. Sds are on the scale of the renormalised fractions.
    """
    at_keys = [*keys, *(space or [])]
    points = fill_dates(series, at_keys, max_gap) if at is None else at.select(*at_keys, "day").distinct()
    place = lambda c: F.dayofyear(c) if axis == "doy" else F.datediff(c, F.lit("1970-01-01").cast("date"))
    length = lambda sd: 20.0 if sd > 0.2 else 80.0
    if space:
        rows = series.select(*at_keys, "day", *values)

        def on_axis(r: _Info, day: np.ndarray) -> np.ndarray:
            if axis != "doy":
                return day - r._t0
            d = day.astype("datetime64[D]")
            return (d - d.astype("datetime64[Y]").astype("datetime64[D]")).astype(float) + 1

        features = lambda r, v, day, xy: np.column_stack([on_axis(r, day) / length(getattr(r, f"_sd_{v}")), xy])
        p = _space_time(rows, points, keys, space, [[v] for v in values], rbf, lambda r, v: 0.05, features)
    else:
        own = {v: F.col(noise[v]) if noise else F.lit(1.0) for v in values}
        rows = _merged(series, keys, place("day"), values, own)

        def fit(x: np.ndarray, y: np.ndarray, r: np.ndarray, stats: tuple[float, float], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            m, sd = stats
            unit = max(sd * sd, 1e-12) if noise else 1 / 0.05
            far = length(sd)
            mean, dev = gp_predict(x[:, None] / far, y[:, None], r / unit, at[:, None] / far, rbf, (np.array([m]), np.array([sd])))
            return mean[:, 0], dev[:, 0]

        p = _by_series(rows, points.withColumn("_x", place("day").cast("double")), keys, fit, values)
    clip = {v: F.least(F.greatest(F.col(v), F.lit(0.0)), F.lit(1.0)) for v in values}
    total = F.nullif(sum(clip.values(), F.lit(0.0)), F.lit(0.0))
    out = p.select(
        *at_keys, "day", *[F.try_divide(e, total).alias(v) for v, e in clip.items()],
        *[F.try_divide(F.col(f"{v}_sd"), total).alias(f"{v}_sd") for v in values],
    )
    if noise:
        out = out.withColumns(
            {f"{v}_{n}": F.col(v) + k * 1.96 * F.col(f"{v}_sd") for v in values for n, k in (("lower", -1), ("upper", 1))}
        )
    return out
