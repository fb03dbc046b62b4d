"""Rain events from an unbounded gauge stream.

The dry gap that separates events is a session gap: a session of wet steps
closes when the watermark passes six hours without rain. Totals match the
batch events of gap-free series; gaps in the record do not break a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.rain import MIN_EVENT_MM, STEP, unit_energy


def rain_sessions(
    stream: DataFrame, time: str = "time", value: str = "rain", key: str = "station", dry_minutes: int = 360,
    late: str = "1 hour", min_total: float | None = MIN_EVENT_MM,
) -> DataFrame:
    """Closed rain sessions per station: span, total and energy.

    ``stream`` needs an event-time column of type timestamp. A wet step lasts
    ``STEP`` minutes, so the session gap is the dry time plus one step.
    """
    wet = stream.where(F.col(value) > 0).withWatermark(time, late)
    # a shorter gap than dry time plus one step keeps steps exactly at the limit apart
    gap = f"{dry_minutes + STEP} minutes"
    s = wet.groupBy(key, F.session_window(time, gap).alias("w")).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.sum(value).alias("total_precipitation"),
        F.sum(unit_energy(F.col(value)) * F.col(value)).alias("energy"),
    ).drop("w")
    return s if min_total is None else s.where(F.col("total_precipitation") >= min_total)
