"""Kalman filters on daily series, many series at a time.

A filter's steps follow each other, but series do not depend on each other: a
task's rows come ordered by series and day, and the first days of all series of
an Arrow batch are filtered together, then the second ones and so on, each
step on arrays with an entry a series. Days between two rows pass at once, by
the closed sums of the transition's powers. What is held is one batch and, for the
series that it ends in, one state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.plans.runs import Arrays, map_runs

#: What callers may name as a chunk's length. Series are no longer cut, so it changes nothing.
CHUNK_DAYS = 64

State = dict[str, np.ndarray]


class Walk:
    """A level that moves by a random step a day."""

    start = {"x": 0.0, "p": 1.0}

    def __init__(self, q: float):
        self.q = q

    def pass_days(self, s: State, g: np.ndarray) -> State:
        return {"x": s["x"], "p": s["p"] + self.q * g}

    def see(self, s: State, y: np.ndarray, r: np.ndarray) -> State:
        k = s["p"] / (s["p"] + r)
        return {"x": s["x"] + k * (y - s["x"]), "p": (1 - k) * s["p"]}


class Trend:
    """A level with a slope, both moved by random steps."""

    start = {"x": 0.0, "v": 0.0, "p00": 1.0, "p01": 0.0, "p11": 1.0}

    def __init__(self, q: float):
        self.q = q

    def pass_days(self, s: State, g: np.ndarray) -> State:
        """``g`` days at once, by the closed sums of the transition's powers."""
        q = self.q
        return {
            "x": s["x"] + s["v"] * g, "v": s["v"],
            "p00": s["p00"] + 2 * g * s["p01"] + g * g * s["p11"] + q * (g + g * (g - 1) * (2 * g - 1) / 6),
            "p01": s["p01"] + g * s["p11"] + q * g * (g - 1) / 2, "p11": s["p11"] + q * g,
        }

    def see(self, s: State, y: np.ndarray, r: np.ndarray) -> State:
        total = s["p00"] + r
        k0, k1, d = s["p00"] / total, s["p01"] / total, y - s["x"]
        return {
            "x": s["x"] + k0 * d, "v": s["v"] + k1 * d,
            "p00": (1 - k0) * s["p00"], "p01": (1 - k0) * s["p01"], "p11": s["p11"] - k1 * s["p01"],
        }


def _steps(model: Walk | Trend, day: np.ndarray, y: np.ndarray, r: np.ndarray, starts: np.ndarray) -> State:
    """States after each row of the series that begin at ``starts``; NaN is nothing seen."""
    # the first value counts whether or not it has an sd
    known = np.minimum.reduceat(np.where(np.isnan(y), len(y), np.arange(len(y))), starts)
    length = np.diff(np.append(starts, len(y)))
    some = known < starts + length
    level = np.where(some, y[np.where(some, known, 0)], 0.0)
    first = {k: np.full(len(starts), x) for k, x in model.start.items()} | {"x": level}
    before = day[starts] - 1
    # longest first, so that the series still running are a leading part
    order = np.argsort(-length, kind="stable")
    at, length = starts[order], length[order]
    state, last = {k: v[order] for k, v in first.items()}, before[order]
    out = {k: np.empty(len(day)) for k in state}
    for i in range(length[0]):
        n = np.searchsorted(-length, -i, side="left")  # those longer than i
        row = at[:n] + i
        state = model.pass_days({k: v[:n] for k, v in state.items()}, day[row] - last[:n])
        seen = ~np.isnan(y[row]) & ~np.isnan(r[row])
        met = model.see(state, y[row], r[row])
        state = {k: np.where(seen, met[k], v) for k, v in state.items()}
        last = day[row]
        for k, v in state.items():
            out[k][row] = v
    return out


def filtered(
    series: DataFrame, keys: list[str], pairs: list[tuple[str, str]], at: DataFrame | None, model: Walk | Trend, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """The state of each (value, sd) pair after each day, as a struct named like the value.

    A series has one row per day at most. Days without an observation, such as
    those of ``at``, only let time pass; one day passes before the first. A
    series starts at its first value, or at 0 if it has none.
    """
    cols = [c for pair in pairs for c in pair]
    rows = series.select(*keys, "day", *[F.col(c).cast("double").alias(c) for c in cols])
    if at is not None:
        rows = rows.unionByName(at.select(*keys, "day"), allowMissingColumns=True)
        rows = rows.groupBy(*keys, "day").agg(*[F.max(c).alias(c) for c in cols])

    def run(c: Arrays, starts: np.ndarray) -> Arrays:
        out = {}
        for v, sd in pairs:
            states = _steps(model, c["day"].astype(float), c[v], c[sd] * c[sd], starts)
            out |= {f"_{v}_{k}": a for k, a in states.items()}
        return out

    told = {f"_{v}_{k}": "double" for v, _ in pairs for k in model.start}
    out = map_runs(rows, keys, ["day"], ["day", *cols], run, told, together=True)
    return out.select(*keys, "day", *[F.struct(*[F.col(f"_{v}_{k}").alias(k) for k in model.start]).alias(v) for v, _ in pairs])
