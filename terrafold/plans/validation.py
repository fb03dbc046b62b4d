"""Checks of predictions against a reference product, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import rain, sampling
from terrafold.plans.ordered import exact_quantiles


def shape_check(monthly: DataFrame, cell: list[str], pred: str, ref: str) -> DataFrame:
    """Quartiles of cumulative percent per month for both products, and the median bias.

    Only cells with a reference value in all twelve months count; each product
    is scaled to its own annual total first.
    """
    full = sampling.complete_cells(monthly, cell, ref)
    a = rain.cumulative_percent(full, cell, pred, "month", "_p")
    b = rain.cumulative_percent(a, cell, ref, "month", "_r")
    # one unpivot ranks all three curves in a single pass
    long = b.select(
        "month", F.col("_p_cumsum").alias("pred"), F.col("_r_cumsum").alias("ref"), (F.col("_p_cumsum") - F.col("_r_cumsum")).alias("bias")
    ).unpivot(["month"], ["pred", "ref", "bias"], "kind", "value")
    q = exact_quantiles(long, ["month", "kind"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return q.groupBy("month").agg(
        *[pick(k, c).alias(f"{k}_{c}") for k in ("pred", "ref") for c in ("q25", "q50", "q75")], pick("bias", "q50").alias("bias")
    )
