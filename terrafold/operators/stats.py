"""Scores, correlations and stratified comparisons as moment sums."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.plans.ordered import cumulative_counts, exact_quantiles

T_975_DF4 = 2.7764451051977987  # fixed value: Student quantile for five models


def settled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Doubles rounded to 40 bits of their mantissa.

    Sums of the same numbers in another order differ in their last bits; ranks
    would tell such values apart.
    """

    def short(c: str) -> Column:
        far = F.col(c) * float(2**13 + 1)
        return F.when(F.abs(far) < float("inf"), far - (far - F.col(c))).otherwise(F.col(c))

    types = dict(df.dtypes)
    return df.withColumns({c: short(c) for c in cols if types[c] == "double"})


def spearman(df: DataFrame, keys: list[str], a: str, b: str, out: str = "spearman_rho") -> DataFrame:
    """Rank correlation per group with average ranks; values equal to twelve digits are ties.

    Equal (a, b) pairs are counted together first; ranks come from
    distributed cumulative counts, never from sorting a whole group.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return spearman_of_pairs(settled(df.where(both), [a, b]).groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_m")), keys, a, b, out)


def spearman_of_pairs(pairs: DataFrame, keys: list[str], a: str, b: str, out: str = "spearman_rho") -> DataFrame:
    """Rank correlation from distinct pairs of values and their number ``_m``."""

    def centred(value: str, name: str) -> DataFrame:
        cc = cumulative_counts(pairs, keys, value, weight="_m")
        r = F.col("below") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
        return cc.select(*[F.col(k).alias(f"_k{name}_{k}") for k in keys], F.col(value).alias(f"_v{name}"), r.alias(f"_r{name}"))

    ra, rb = centred(a, "a"), centred(b, "b")
    on_a = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_ka_{k}")) for k in keys] + [F.col(a) == F.col("_va")])
    on_b = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_kb_{k}")) for k in keys] + [F.col(b) == F.col("_vb")])
    j = pairs.join(ra, on_a).join(rb, on_b)
    m, x, y = F.col("_m"), F.col("_ra"), F.col("_rb")
    den = F.sqrt(F.sum(m * x * x)) * F.sqrt(F.sum(m * y * y))
    return j.groupBy(*keys).agg(F.try_divide(F.sum(m * x * y), F.nullif(den, F.lit(0.0))).alias(out))


def rank_correlation(df: DataFrame, keys: list[str], ref: str, new: str) -> DataFrame:
    """Spearman, Pearson and the least-squares line of ``new`` on ``ref`` per group."""
    ok = df.where(F.col(ref).isNotNull() & F.col(new).isNotNull())
    lin = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(ref, new).alias("pearson_r"),
        F.regr_slope(new, ref).alias("slope"), F.regr_intercept(new, ref).alias("intercept"),
    )
    s = spearman(ok, keys, ref, new)
    return lin.join(s, keys, "left") if keys else lin.withColumn("spearman_rho", s.scalar())


def stratum_metrics(df: DataFrame, keys: list[str], ref: str, new: str, weight: str, unit: float = 1e4) -> DataFrame:
    """Agreement of a new value with a reference per group.

    Groups without a complete pair stay with n = 0. ``unit`` converts the
    weight column's area unit to hectares.
    """
    g = df.groupBy(*keys).agg(*_agreement_sums(ref, new, weight))
    return _agreement(g, keys, unit).join(spearman(df, keys, ref, new), keys, "left")


def _agreement_sums(ref: str, new: str, weight: str) -> list[Column]:
    """Sums over complete pairs that further sums can be taken of."""
    both = F.col(ref).isNotNull() & F.col(new).isNotNull()
    r, n, w = [F.when(both, F.col(c)) for c in (ref, new, weight)]
    d = n - r
    terms = {"_w": w, "_r": r, "_v": n, "_d": d, "_a": F.abs(d), "_dd": d * d, "_vv": n * n}
    return [F.count(d).alias("_n"), *[F.sum(x).alias(k) for k, x in terms.items()]]


def _agreement(g: DataFrame, keys: list[str], unit: float) -> DataFrame:
    n, mean = F.col("_n"), lambda c: F.try_divide(F.col(c), F.col("_n"))
    # one value has a spread of 0
    left = F.greatest(F.col("_vv") - F.col("_v") * mean("_v"), F.lit(0.0))
    spread = F.when(n > 1, F.sqrt(F.try_divide(left, n - 1))).when(n == 1, F.lit(0.0))
    out = g.select(
        *keys, n.alias("n"), (F.coalesce("_w", F.lit(0.0)) / unit).alias("area_ha"), mean("_r").alias("mean_old"), mean("_v").alias("mean_new"),
        mean("_d").alias("bias"), mean("_a").alias("MAE"), F.sqrt(mean("_dd")).alias("RMSE"), spread.alias("spread_C_new"),
    )
    return out.withColumn("rel_bias_pct", F.when(F.col("mean_old") > 0, 100 * F.col("bias") / F.col("mean_old")))


def by_strata(df: DataFrame, strata: dict[str, Column], cols: list[str], aggs: list[Column], within: list[str] | None = None) -> DataFrame:
    """``aggs`` per (kind, label, within) for several stratifications, by GROUPING SETS.

    Rows are copied once a set inside the aggregate, with the ``cols`` it needs
    only, and combined before anything is shuffled.
    """
    within = within or []
    named = {f"_k{i}": F.coalesce(c.cast("string"), F.lit("(none)")) for i, c in enumerate(strata.values())}
    base = df.select(*within, *cols, *[c.alias(k) for k, c in named.items()])
    sets = [[*[F.col(w) for w in within], F.col(k)] for k in named]
    every = [F.col(c) for c in (*within, *named)]
    g = base.groupingSets(sets, *every).agg(*aggs, F.grouping_id().alias("_set"))
    # the set's own column has a 0 in its place of the id
    full, last = (1 << len(named)) - 1, len(named) - 1
    is_set = {k: F.col("_set") == full - (1 << (last - i)) for i, k in enumerate(named)}
    kind = reduce(lambda c, k: c.when(is_set[k[0]], F.lit(k[1])), zip(list(named)[1:], list(strata)[1:]), F.when(is_set["_k0"], F.lit(next(iter(strata)))))
    return g.select(kind.alias("kind"), F.coalesce(*named).alias("label"), *[c for c in g.columns if c not in named and c != "_set"])


def stratum_tables(df: DataFrame, strata: dict[str, Column], ref: str, new: str, weight: str, unit: float = 1e4) -> DataFrame:
    """``stratum_metrics`` of every stratum of every kind, from one grouping of the rows and one of their pairs of values."""
    keys = ["kind", "label"]
    g = by_strata(df, strata, [ref, new, weight], _agreement_sums(ref, new, weight))
    both = df.where(F.col(ref).isNotNull() & F.col(new).isNotNull())
    # strata are told from the values as they are
    labels = {k: f"_s{i}" for i, k in enumerate(strata)}
    both = settled(both.select(ref, new, *[c.alias(labels[k]) for k, c in strata.items()]), [ref, new])
    pairs = by_strata(both, {k: F.col(c) for k, c in labels.items()}, [], [F.count(F.lit(1)).alias("_m")], within=[ref, new])
    return _agreement(g, keys, unit).join(spearman_of_pairs(pairs, keys, ref, new), keys, "left")


def headline(df: DataFrame, ref: str, new: str, group: str) -> DataFrame:
    """Mean bias and mean absolute error over rows, and over the groups' means, as rows of (level, n, bias, MAE)."""
    rows = df.where(F.col(ref).isNotNull() & F.col(new).isNotNull())
    means = rows.groupBy(group).agg(F.avg(ref).alias("_r"), F.avg(new).alias("_v"))

    def told(t: DataFrame, level: str, d: Column) -> DataFrame:
        return t.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("MAE"))

    return told(rows, "rows", F.col(new) - F.col(ref)).unionByName(told(means, "groups", F.col("_v") - F.col("_r")))


def class_confusion(df: DataFrame, old_class: Column, new_class: Column, labels: list[str], within: Column) -> DataFrame:
    """Counts of (old, new) classes per stratum, with each old class's share that keeps its class; all labels stay."""
    c = df.select(within.cast("string").alias("stratum"), old_class.alias("old"), new_class.alias("new")).dropna()
    c = c.groupBy("stratum", "old", "new").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a in labels for b in labels])
    frame = c.select("stratum").distinct().select("stratum", F.explode(pairs).alias("_p")).select("stratum", "_p.old", "_p.new")
    n = F.coalesce("n", F.lit(0))
    kept = c.groupBy("stratum", "old").agg(F.try_divide(F.sum(F.when(F.col("old") == F.col("new"), F.col("n")).otherwise(0)), F.sum("n")).alias("kept_share"))
    return frame.join(c, ["stratum", "old", "new"], "left").withColumn("n", n).join(kept, ["stratum", "old"], "left")


def best_and_worst(metrics: DataFrame, by: str, n: int, least: int, keys: list[str]) -> DataFrame:
    """The ``n`` strata of lowest and of highest ``by`` among those of at least ``least`` rows, ranked; ties by label."""
    ok = metrics.where((F.col("n") >= least) & F.col(by).isNotNull())
    out = []
    for side, order in (("best", F.asc(by)), ("worst", F.desc(by))):
        few = ok.orderBy(order, *keys).limit(n)
        w = Window.orderBy(order, *keys)  # over n rows
        out.append(few.select(F.lit(side).alias("side"), F.row_number().over(w).alias("place"), *keys, "n", by))
    return out[0].unionByName(out[1])


def _finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))


def _weighted(cols: list[str], weight: str, unit: float) -> list[Column]:
    w = F.col(weight)
    aggs = []
    for c in cols:
        ok = _finite(F.col(c)) & _finite(w) & (w > 0)
        aggs.append(F.try_divide(F.sum(F.when(ok, F.col(c) * w)), F.sum(F.when(ok, w))).alias(c))
    return [*aggs, (F.sum(F.when(_finite(w), w)) / unit).alias("Flaeche_ha"), F.count(F.lit(1)).alias("n_parcel_years")]


def weighted_mean(df: DataFrame, keys: list[str], cols: list[str], weight: str, unit: float = 1e4) -> DataFrame:
    """Area-weighted means over finite values with positive weight; area and row count."""
    return df.groupBy(*keys).agg(*_weighted(cols, weight, unit))


def weighted_mean_tables(df: DataFrame, strata: dict[str, Column], cols: list[str], weight: str, unit: float = 1e4) -> DataFrame:
    """``weighted_mean`` of every stratum of every kind, from one grouping."""
    return by_strata(df, strata, list(dict.fromkeys([*cols, weight])), _weighted(cols, weight, unit))


def risk_confusion(df: DataFrame, old_class: Column, new_class: Column, labels: list[str]) -> DataFrame:
    """Counts for every pair of labels, with the share on the diagonal."""
    c = df.select(old_class.alias("old"), new_class.alias("new")).dropna()
    c = c.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    frame = spark.createDataFrame([(a, b) for a in labels for b in labels], "old string, new string")
    same = F.sum(F.when(F.col("old") == F.col("new"), F.col("n")).otherwise(0))
    agreement = c.agg(F.try_divide(same, F.sum("n"))).scalar()
    out = frame.join(c, ["old", "new"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("agreement", agreement)


def regression_scores(df: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """RMSE, MAE, NRMSE (by range), model R2 and squared Pearson correlation."""
    ok = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    e = F.col(obs) - F.col(pred)
    g = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"),
        (F.max(obs) - F.min(obs)).alias("_range"), F.avg(e * e).alias("_mse"), F.var_pop(obs).alias("_var"),
        F.corr(obs, pred).alias("_r"),
    )
    return g.select(
        *keys, "n", "RMSE", "MAE", F.try_divide("RMSE", F.nullif("_range", F.lit(0.0))).alias("NRMSE"),
        (1 - F.try_divide("_mse", F.nullif("_var", F.lit(0.0)))).alias("R2"), (F.col("_r") * F.col("_r")).alias("r2_pearson"),
    )


def kge_nse(df: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """Kling-Gupta and Nash-Sutcliffe efficiency per curve."""
    o, p = F.col(obs), F.col(pred)
    g = df.groupBy(*keys).agg(
        F.corr(o, p).alias("_r"), F.stddev_pop(p).alias("_sp"), F.stddev_pop(o).alias("_so"),
        F.avg(p).alias("_mp"), F.avg(o).alias("_mo"), F.avg((o - p) ** 2).alias("_mse"), F.var_pop(o).alias("_vo"),
    )
    z = lambda c: F.nullif(F.col(c), F.lit(0.0))
    a, b = F.try_divide("_sp", z("_so")), F.try_divide("_mp", z("_mo"))
    return g.select(
        *keys,
        (1 - F.sqrt((F.col("_r") - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2)).alias("KGE"),
        (1 - F.try_divide("_mse", z("_vo"))).alias("NSE"),
    )


def kge_nse_summary(curves: DataFrame) -> DataFrame:
    return curves.agg(
        F.avg("KGE").alias("mean_KGE"), F.stddev_samp("KGE").alias("std_KGE"),
        F.avg("NSE").alias("mean_NSE"), F.stddev_samp("NSE").alias("std_NSE"),
    )


def ensemble_spread(df: DataFrame, sample: list[str], keys: list[str], pred: str, n_models: int = 5) -> DataFrame:
    """Mean sd, coefficient of variation and 95 % half-width of an ensemble."""
    s = df.groupBy(*keys, *sample).agg(F.stddev_pop(pred).alias("_sd"), F.avg(pred).alias("_m"))
    cv = F.try_divide(F.col("_sd"), F.nullif(F.abs("_m"), F.lit(0.0)))
    return s.groupBy(*keys).agg(
        F.avg("_sd").alias("mean_std"), F.avg(cv).alias("mean_cv"),
        (F.avg("_sd") * F.lit(T_975_DF4 / n_models ** 0.5)).alias("mean_half_width"),
    )


def score_by_model(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean, sd, count and 1.96-based interval of a score."""
    return df.groupBy(*keys).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("count"),
        (1.96 * F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("ci"),
    )


def cross_group_scores(pred: DataFrame, truth: DataFrame, sample: list[str], obs: str, value: str) -> DataFrame:
    """Scores of every model on every group's test samples, then the comparable ones.

    Predictions carry (soil_group, iteration), samples carry test_soil; kept
    are the global model (group 0) and the matching one.
    """
    j = pred.join(truth, sample).where((F.col("soil_group") == 0) | (F.col("soil_group") == F.col("test_soil")))
    out = regression_scores(j, ["soil_group", "iteration", "test_soil"], obs, value)
    return out.withColumn("model", F.when(F.col("soil_group") == 0, "Global").otherwise("Soil-specific"))


def welch_test(df: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """Unequal-variance t statistic and degrees of freedom; ``side`` true is the first sample."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    g = df.groupBy(*keys).agg(
        F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
    ).where((F.col("na") > 1) & (F.col("nb") > 1))
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    se = sa + sb
    return g.select(
        *keys, "na", "nb", F.try_divide(F.col("ma") - F.col("mb"), F.nullif(F.sqrt(se), F.lit(0.0))).alias("t"),
        F.try_divide(se * se, F.nullif(sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1), F.lit(0.0))).alias("df"),
    )


#: Steps of the integration below; even.
TAIL_STEPS = 400


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t.

    With t = sqrt(df) tan(u) the density is proportional to cos(u)^(df - 1), so
    the tail is a ratio of two integrals of that power up to a quarter turn,
    each taken by Simpson's rule.
    """

    def area(start: Column) -> Column:
        # for many degrees of freedom all of the mass lies next to the start
        stop = F.least(F.lit(math.pi / 2), start + 12 / F.sqrt(df))
        h = (stop - start) / TAIL_STEPS

        def term(i: Column) -> Column:
            weight = F.when((i == 0) | (i == TAIL_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * F.pow(F.abs(F.cos(start + h * i)), df - 1)

        return h * F.aggregate(F.sequence(F.lit(0), F.lit(TAIL_STEPS)), F.lit(0.0), lambda a, i: a + term(i))

    return F.least(F.lit(1.0), area(F.atan(F.abs(t) / F.sqrt(df))) / area(F.lit(0.0)))


def welch_p(tests: DataFrame) -> DataFrame:
    """Two-sided p value for each row of ``welch_test``."""
    return tests.withColumn("p", student_tail(F.col("t"), F.col("df")))


def mean_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.05) -> DataFrame:
    """Mean and half-width of its interval by Student's t; a single value has width 0.

    The t quantile is found by halving, once for each distinct count.
    """
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("_sd"))
    span = F.struct(F.lit(0.0).alias("lo"), F.lit(1000.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = student_tail(mid, (F.col("n") - 1).cast("double")) > level
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), span, halve)
    counts = g.select("n").distinct().where("n > 1").select(F.col("n").alias("_n"), ((found["lo"] + found["hi"]) / 2).alias("_q"))
    sem = F.coalesce(F.col("_sd"), F.lit(0.0)) / F.sqrt("n")
    return g.join(counts, F.col("n") == F.col("_n"), "left").select(*keys, "mean", "n", (sem * F.coalesce("_q", F.lit(0.0))).alias("ci"))



def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise Pearson correlations as rows (a, b, r), from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    g = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return g.select(F.explode(rows).alias("_r")).select("_r.a", "_r.b", "_r.r")


def percentile_spectra(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """25/50/75 percentiles of every band per group, exact."""
    long = df.unpivot(keys, bands, "band", "value")
    return exact_quantiles(long, [*keys, "band"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def quantile_band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def extreme_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Range, mean, median and 1st/99th percentile."""
    g = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    q = exact_quantiles(df, keys, value, {"median": 0.5, "p01": 0.01, "p99": 0.99})
    return g.join(q, keys, "inner")


def regional_curve(df: DataFrame, region: str, axis: str, value: str) -> DataFrame:
    """Median and mean curve per region, and over all under the name Overall."""
    both = df.select(F.explode(F.array(F.col(region), F.lit("Overall"))).alias("region"), axis, value)
    q = exact_quantiles(both, ["region", axis], value, {"median": 0.5})
    m = both.groupBy("region", axis).agg(F.avg(value).alias("mean"))
    return q.join(m, ["region", axis])


def category_counts(df: DataFrame, key: str, kind: str, a: str, b: str) -> DataFrame:
    """Counts of two kinds per category and their difference."""
    return df.groupBy(key).agg(
        F.count_if(F.col(kind) == a).alias("n_a"), F.count_if(F.col(kind) == b).alias("n_b"),
        (F.count_if(F.col(kind) == a) - F.count_if(F.col(kind) == b)).alias("difference"), F.count(F.lit(1)).alias("n"),
    )


def majority_group(df: DataFrame, keys: list[str], label: str, none: int = 0) -> DataFrame:
    """Most frequent valid label per group, the smaller on ties; ``none`` without any."""
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    valid = F.col(label).isNotNull()
    return c.groupBy(*keys).agg(
        F.coalesce(
            F.min_by(label, F.when(valid, F.struct(-F.col("_n"), F.col(label)))), F.lit(none)
        ).alias("majority")
    )


def change_detect(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Two labelings of the same cells and whether they differ."""
    x = a.select(*keys, F.col(label).alias("label_a"))
    y = b.select(*keys, F.col(label).alias("label_b"))
    return x.join(y, keys).withColumn("changed", (F.col("label_a") != F.col("label_b")).cast("int"))
