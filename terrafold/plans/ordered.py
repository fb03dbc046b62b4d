"""Ordered computation that never needs one key's whole history in one task.

A plain ``Window.partitionBy(station).orderBy(time)`` sends every row of a
station to one task; with a third of the data under one key that task decides
the run time. The functions here cut each key into *chunks* along the order
(for example 30 days), run windows inside (key, chunk), and pass what crosses a
chunk edge through a small table with one row per chunk.

Callers arrange the data by (key, chunk) once with ``repartition``; the windows,
the per-chunk summaries and the joins back then all reuse that one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = Window.unboundedPreceding


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` into a fixed number of tasks.

    Adaptive execution merges shuffle partitions by their bytes; where rows are
    few but each costs much work (Python fits, cell generation) that would
    leave most cores idle. A stated number is kept as it is.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


#: Rows of a task where their number is known. They are sorted and joined several times over within it.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *cols: str, wide: bool = False) -> DataFrame:
    """Hash-partition by ``cols`` into as many tasks as ``rows`` ask for.

    Shuffle partitions are merged by their compressed bytes, so that rows that
    compress to little (cells, regular axes) would all be sorted in one task.
    With ``wide`` there are at least the session's shuffle partitions, so that a
    join with an aggregate does not deal the rows anew.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if wide else 1
    return df.repartition(max(spark.sparkContext.defaultParallelism, least, -(-rows // TASK_ROWS)), *cols)


def carry(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: str,
    back: dict[str, Column] | None = None,
    forward: dict[str, Column] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Add the nearest non-null value before (``back``) or after (``forward``).

    Includes the row itself unless ``strict``. The row order inside a key is
    ``order``; ``chunk`` must be non-decreasing along it.
    """
    back, forward = back or {}, forward or {}
    part = [*keys, chunk]
    vals = {**{f"_b_{k}": v for k, v in back.items()}, **{f"_f_{k}": v for k, v in forward.items()}}
    base = df.withColumns(vals)

    aggs = [
        F.max_by(F.col(f"_b_{k}"), F.when(F.col(f"_b_{k}").isNotNull(), F.col(order))).alias(f"_cb_{k}")
        for k in back
    ] + [
        F.min_by(F.col(f"_f_{k}"), F.when(F.col(f"_f_{k}").isNotNull(), F.col(order))).alias(f"_cf_{k}")
        for k in forward
    ]
    ends = base.groupBy(*part).agg(*aggs)
    # frames that run to the end of the partition are evaluated in quadratic
    # time, so looking forward is looking back along the reversed order
    prev = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(BEFORE, -1)
    nxt = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(BEFORE, -1)
    ends = ends.select(
        *part,
        *[F.last(f"_cb_{k}", True).over(prev).alias(f"_pb_{k}") for k in back],
        *[F.last(f"_cf_{k}", True).over(nxt).alias(f"_pf_{k}") for k in forward],
    )

    stop = -1 if strict else 0
    wb = Window.partitionBy(*part).orderBy(order).rowsBetween(BEFORE, stop)
    wf = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(BEFORE, stop)
    inner = base.withColumns(
        {
            **{f"_lb_{k}": F.last(f"_b_{k}", True).over(wb) for k in back},
            **{f"_lf_{k}": F.last(f"_f_{k}", True).over(wf) for k in forward},
        }
    )
    out = inner.join(ends, part, "left")
    return out.select(
        *[out[c] for c in df.columns],
        *[F.coalesce(f"_lb_{k}", f"_pb_{k}").alias(k) for k in back],
        *[F.coalesce(f"_lf_{k}", f"_pf_{k}").alias(k) for k in forward],
    )


def running_sum(
    df: DataFrame, keys: list[str], chunk: str, order: str, sums: dict[str, Column]
) -> DataFrame:
    """Add running sums along ``order`` within ``keys`` (row included)."""
    part = [*keys, chunk]
    base = df.withColumns({f"_s_{k}": v for k, v in sums.items()})
    totals = base.groupBy(*part).agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(BEFORE, -1)
    totals = totals.select(*part, *[F.sum(f"_t_{k}").over(w).alias(f"_o_{k}") for k in sums])
    wi = Window.partitionBy(*part).orderBy(order).rowsBetween(BEFORE, 0)
    inner = base.withColumns({f"_l_{k}": F.sum(f"_s_{k}").over(wi) for k in sums})
    out = inner.join(totals, part, "left")
    return out.select(
        *[out[c] for c in df.columns],
        *[(F.col(f"_l_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0))).alias(k) for k in sums],
    )


def with_halo(
    df: DataFrame, keys: list[str], chunk: str, reach: Column, halo: str = "_halo", rows: int = 0
) -> DataFrame:
    """Copy rows near a chunk's end into the next chunk.

    ``reach`` is the chunk of the last row that may look back at this one. Run
    windows over (keys, ``halo``) and keep rows with ``halo`` equal to
    ``chunk``. ``rows``, if known, sets the number of tasks.
    """
    wide = df.withColumn(halo, F.explode(F.array_distinct(F.array(F.col(chunk), reach))))
    return dealt(wide, rows, *keys, halo, wide=True) if rows else wide.repartition(*keys, halo)


#: Bits of a value's order-preserving number that the two coarser levels leave out.
LEVELS = (42, 21)


def order_bits(v: Column) -> Column:
    """A long that ascends with the double ``v``: sign, exponent and mantissa as one number.

    Halves of a binade differ in one bit, so any two doubles differ; both zeros
    are 0, NaN is the largest.
    """
    v = v.cast("double")
    a = F.abs(v)
    rough = F.floor(F.log2(a))
    # log2 may round to the next whole number
    e = F.when(F.pow(F.lit(2.0), rough) > a, rough - 1).when(F.pow(F.lit(2.0), rough + 1) <= a, rough + 1).otherwise(rough)
    e = F.greatest(e, F.lit(-1022))
    one = F.lit(1 << 52)
    bits = (e + 1023) * one + ((a / F.pow(F.lit(2.0), e) - 1) * one).cast("long")
    bits = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(v < 0, -bits).otherwise(bits).cast("long")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _named(df: DataFrame, cols: list[str], rest: list[Column]) -> DataFrame:
    """``cols`` under names of their own, for a null-safe join, and ``rest``."""
    return df.select(*[F.col(c).alias(f"_k_{c}") for c in cols], *rest)


def _onto(df: DataFrame, offsets: DataFrame, cols: list[str], names: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns ``names`` of ``offsets``, matched null-safe on ``cols``."""
    o = _named(offsets, cols, [F.col(n) for n in names])
    return df.join(o, _same(cols, [f"_k_{c}" for c in cols]), how).select(*df.columns, *names)


class _Histograms:
    """Rows of a key counted by value and, coarser, by leading bits of the values.

    A value's bits lie in a coarse and, within it, a finer interval. Each level
    has a bounded number of members in a member of the level above (2^22, 2^21
    and 2^21), whatever the data, so sums along one level never hold a key's
    values together. Intervals depend on the value alone: nothing is estimated,
    written or counted beforehand.
    """

    def __init__(self, df: DataFrame, keys: list[str], value: str, weight: str | None):
        n = F.count(F.lit(1)) if weight is None else F.sum(weight)
        self.keys, self.value = keys, value
        counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))
        bits = order_bits(F.col(value))
        self.counts = counts.withColumns({"_p1": F.shiftright(bits, LEVELS[0]), "_p2": F.shiftright(bits, LEVELS[1])})
        self.fine = self.counts.groupBy(*keys, "_p1", "_p2").agg(F.sum("n").alias("n"))
        coarse = self.fine.groupBy(*keys, "_p1").agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(*keys)).alias("total")
        self.coarse = self.below(coarse, keys, "_p1").select("*", total)

    @staticmethod
    def below(df: DataFrame, by: list[str], order: str, start: Column | None = None) -> DataFrame:
        """With ``below``: rows of the members before, from ``start`` on."""
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(BEFORE, -1)
        own = F.coalesce(F.sum("n").over(w), F.lit(0))
        return df.withColumn("below", own if start is None else start + own)


def cumulative_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows (keys, value, n, below, total): how many rows sort below each value.

    Equal values are counted together before anything is ordered (``weight``
    counts a row several times). The order of values is that of their double.
    """
    h = _Histograms(df, keys, value, weight)
    top = h.coarse.withColumnRenamed("below", "_b1").drop("n")
    fine = _onto(h.fine, top, [*keys, "_p1"], ["_b1", "total"])
    fine = h.below(fine, [*keys, "_p1"], "_p2", F.col("_b1")).withColumnRenamed("below", "_b2").drop("n")
    rows = _onto(h.counts, fine, [*keys, "_p2"], ["_b2", "total"])
    return h.below(rows, [*keys, "_p2"], value, F.col("_b2")).select(*keys, value, "n", "below", "total")


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """Rows (keys, value, rank): 1-based rank, ties sharing their mean rank."""
    return cumulative_counts(df, keys, value).select(
        *keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(rank)
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per key with linearly interpolated quantiles.

    The built-in exact ``percentile`` keeps a key's distinct values in one
    aggregation buffer. Here the rows wanted are looked for by leading bits: only
    the intervals that hold one are refined, down to single values.
    """
    h = _Histograms(df, keys, value, None)
    wanted = lambda p: (F.col("total") - 1) * F.lit(float(p))
    ranks = F.array(*[f(wanted(p)) for p in probs.values() for f in (F.floor, F.ceil)])
    holds = F.exists(ranks, lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n")))
    top = h.coarse.where(holds).withColumnRenamed("below", "_b1").drop("n")
    fine = _onto(h.fine, top, [*keys, "_p1"], ["_b1", "total"])
    fine = h.below(fine, [*keys, "_p1"], "_p2", F.col("_b1")).where(holds).withColumnRenamed("below", "_b2").drop("n")
    rows = _onto(h.counts, fine, [*keys, "_p2"], ["_b2", "total"])
    rows = h.below(rows, [*keys, "_p2"], value, F.col("_b2")).where(holds)
    aggs = []
    for name, p in probs.items():
        pos = wanted(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
        lo_v = F.max(F.when(inside(lo), F.col(value)))
        hi_v = F.max(F.when(inside(hi), F.col(value)))
        aggs.append((lo_v + (hi_v - lo_v) * F.max(pos - lo)).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 32
) -> DataFrame:
    """The first ``n`` rows per key.

    Up to the optimizer's group-limit threshold Spark prunes map-side by
    itself. Beyond it, a first pass keeps ``n`` per (key, salt) so the final
    window sees at most ``n * salts`` rows of a key.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    out = df
    if n > limit:
        out = out.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    w = Window.partitionBy(*keys).orderBy(*order)
    out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the smallest by ``order``; a plain combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def with_totals(
    df: DataFrame, keys: list[str], aggs: list[Column], salts: int = 16
) -> DataFrame:
    """Join group aggregates back onto the rows.

    The aggregate is map-side combined; the join back spreads each key over
    ``salts`` partitions, so a hot key is neither windowed nor joined in one
    task.
    """
    tot = df.groupBy(*keys).agg(*aggs)
    names = [c for c in tot.columns if c not in keys]
    right = tot.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *names,
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_k_salt"),
    )
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    on = reduce(
        lambda x, y: x & y,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_k_salt")],
    )
    return left.join(right, on, "inner").select(*df.columns, *names)
