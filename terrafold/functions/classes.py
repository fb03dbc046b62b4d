"""Classes from numbers: right-closed bins, terrain and region."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf
# fixed values: class limits and labels
SIZE_BINS = [0, 5_000, 10_000, 30_000, 100_000, INF]
SIZE_LABELS = ["<0.5ha", "0.5–1ha", "1–3ha", "3–10ha", ">10ha"]
C_BINS = [-0.001, 0.01, 0.05, 0.10, 0.20, 1.0]
C_LABELS = ["very_low (≤0.01)", "low (0.01–0.05)", "medium (0.05–0.10)", "high (0.10–0.20)", "very_high (>0.20)"]
RISK_BINS = [-0.001, 0.25, 2, 8, 20, INF]
RISK_LABELS = ["low", "medium", "high", "very_high", "extreme"]


def bin_cut(value: Column, bins: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed interval holding ``value``; null outside all."""
    out = None
    for lo, hi, label in zip(bins, bins[1:], labels):
        above = (value >= float(lo)) if include_lowest and lo == bins[0] else (value > float(lo))
        inside = above if hi == INF else above & (value <= float(hi))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bin_index(value: Column, bins: list[float], include_lowest: bool = False) -> Column:
    """The same as an ordinal, for ordered output."""
    return bin_cut(value, bins, [str(i) for i in range(len(bins) - 1)], include_lowest).cast("int")


# fixed values: limits of elevation (m) and slope (degrees), and the class names
def terrain_class(elev: Column, slope: Column) -> Column:
    return (
        F.when((elev < 600) & (slope < 5), "valley").when(elev < 600, "plateau")
        .when((elev < 1500) & (slope < 15), "hill").when(elev < 1500, "steep_hill")
        .when(elev < 2200, "mountain").otherwise("alpine")
    )


def region_class(elev: Column, limit: float = 600.0) -> Column:
    return F.when(elev > limit, "Berg").otherwise("Tal")
