"""Gap filling by GP, spectra, models, feature tables, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.registry import query
from terrafold.catalog.space import FIELD_META
from terrafold.catalog.timeseries import KEYS, V, daily, norm, text_day, with_sd
from terrafold.functions import timeparts as tp
from terrafold.operators import cover, gapfill, grid, learn, rain, sampling, spatial, spectra, stats
from terrafold.plans import features
from terrafold.session import cut_lineage
from terrafold.sources import tables as io

# --- GP gap filling ----------------------------------------------------------
FIELD, PIX = ["poly_id", "yr"], ["x", "y"]


def pixels(s, d):
    """One row per (field, pixel, day)."""
    n = norm(s, d).dropna(subset=V)
    return n.groupBy(*FIELD, *PIX, F.to_date("time").alias("day")).agg(*[F.avg(v).alias(v) for v in V])


query("gapfill_gp")(lambda s, d: text_day(gapfill.gapfill_gp(pixels(s, d), FIELD, PIX)))


def gp_rows(s, d):
    """What of the filled series SQL can tell: its rows, the observed values, and that fractions sum to one."""
    g = gapfill.gapfill_gp(pixels(s, d), FIELD, PIX)
    seen = lambda v: F.when(~F.col("is_gapfilled"), F.col(v)).alias(v)
    total = F.when(F.col("is_gapfilled"), F.abs(F.col("pv") + F.col("npv") + F.col("soil") - 1) < 1e-9).otherwise(True).alias("sums_to_one")
    return text_day(g.select(*FIELD, *PIX, "day", "is_gapfilled", *[seen(v) for v in V], total))


query(
    "gapfill_gp_rows",
    """SELECT poly_id, yr, x, y, day::VARCHAR AS day, FALSE AS is_gapfilled, pv, npv, soil, TRUE AS sums_to_one FROM gpx UNION ALL
       SELECT g.poly_id, g.yr, g.x, g.y, (g.day + CAST(15 * k AS INT))::VARCHAR, TRUE, NULL, NULL, NULL, TRUE FROM gnext g
       JOIN (SELECT poly_id, yr FROM gpx GROUP BY ALL HAVING count(*) >= 3) f ON f.poly_id = g.poly_id AND f.yr = g.yr, range(1, 30) r(k) WHERE g.day + CAST(15 * k AS INT) < g.nday""",
    "x y pv npv soil",
    tables={
        "gpx": """SELECT poly_id, yr, x, y, "time"::DATE AS day, avg(pv) AS pv, avg(npv) AS npv, avg(soil) AS soil FROM fc_norm
            WHERE pv IS NOT NULL AND npv IS NOT NULL AND soil IS NOT NULL GROUP BY ALL""",
        "gnext": "SELECT *, lead(day) OVER (PARTITION BY poly_id, yr, x, y ORDER BY day) AS nday FROM gpx",
    },
)(gp_rows)


def first_pixel(s, d):
    return sampling.first_per_key(pixels(s, d).select(*FIELD, *PIX).distinct(), FIELD, F.struct(*PIX))


query("gapfill_gp_target")(lambda s, d: text_day(gapfill.gapfill_gp(pixels(s, d), FIELD, PIX, targets=first_pixel(s, d))))
query("gapfill_gp_median")(lambda s, d: text_day(gapfill.gapfill_gp_median(pixels(s, d), None, FIELD, PIX)))
query("gapfill_gp_doy")(lambda s, d: text_day(gapfill.gapfill_gp_doy(daily(s, d), KEYS, V, max_gap=6)))
query("gapfill_gp_doy_space")(lambda s, d: text_day(gapfill.gapfill_gp_doy(pixels(s, d), FIELD, V, space=PIX)))


def noisy(s, d):
    return with_sd(s, d).withColumns({f"{v}_var": F.col(f"{v}_sd") ** 2 for v in V})


query("gapfill_gp_noise")(
    lambda s, d: text_day(gapfill.gapfill_gp_doy(noisy(s, d), KEYS, V, max_gap=6, noise={v: f"{v}_var" for v in V}))
)

# --- spectra -----------------------------------------------------------------
B = [f"b{i}" for i in range(1, 11)]


def library(s, d):
    return t.spectra(s, d).select("id", "cls", *B)


query(
    "endmember_library", "SELECT id, cls, b1 AS blue, b2 AS green, " + ", ".join(B[2:]) + " FROM spectra", "blue green " + " ".join(B[2:]),
)(
    lambda s, d: spectra.endmember_library(
        {
            0: library(s, d).where("cls = 0").select("id", *B),
            1: library(s, d).where("cls = 1").select("id", F.col("b1").alias("blue"), *B[1:]),
            2: library(s, d).where("cls = 2").select("id", "b1", F.col("b2").alias("green"), *B[2:]),
        },
        {"b1": "blue", "b2": "green"},
    )
)


def mix_sql(replace: bool) -> dict[str, str]:
    u = lambda tag: f"CAST('0x' || substr(md5('11|' || id || '|{tag}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    if replace:
        cls = "[" + ", ".join(f"CAST(floor(({u(f'c{j}')}) * 3) AS INT)" for j in range(3)) + "]"
    else:
        cls = "list_transform(list_sort([" + ", ".join(f"{{'u': {u(f'c{c}')}, 'c': {c}}}" for c in range(3)) + "]), lambda z: z.c)"
    slot = lambda j: f"""SELECT id, k, cs[{j + 1}] AS cls, CAST(floor(({u(f'i{j}')}) * CASE cs[{j + 1}] WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END) AS BIGINT) AS idx,
        {u(f'w{j}')} AS w FROM mdraw{' WHERE k = 3' if j == 2 else ''}"""
    return {
        "mlib": "SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('11|' || id)) - 1 AS idx FROM spectra",
        "mdraw": f"""SELECT id, CASE WHEN {u('n')} < 0.5 THEN 2 ELSE 3 END AS k, {cls} AS cs, n0, n1, n2 FROM spectra,
            (SELECT count(*) FILTER (cls = 0) n0, count(*) FILTER (cls = 1) n1, count(*) FILTER (cls = 2) n2 FROM spectra)""",
        "mslot": " UNION ALL ".join(slot(j) for j in range(3)) + f" UNION ALL SELECT id, k, 3, 0, {u('ws')} FROM mdraw WHERE {u('shade')} < 0.5",
        "mfrac": "SELECT *, w / sum(w) OVER (PARTITION BY id) AS f FROM mslot",
        "mixed": "SELECT f.id, " + ", ".join(f"sum(f.f * CASE WHEN f.cls = 3 THEN 0.01 ELSE l.{b} END) AS {b}" for b in B)
        + ", " + ", ".join(f"sum(CASE WHEN f.cls = {i} THEN f.f ELSE 0 END) AS {n}" for i, n in enumerate(spectra.CLASSES))
        + " FROM mfrac f LEFT JOIN mlib l ON l.cls = f.cls AND l.idx = f.idx GROUP BY 1",
    }


def mixed(s, d, replace=False):
    lib = library(s, d)
    return spectra.mix_spectra(lib, lib, ["id"], B, seed=11, replace=replace)


query("mix_spectra", "SELECT * FROM mixed", " ".join(B + spectra.CLASSES), digits=7, tables=mix_sql(False))(mixed)
query(
    "mix_spectra_single", f"SELECT id, {', '.join(B)}, PV AS fraction FROM mixed", " ".join(B + ["fraction"]), digits=7, tables=mix_sql(True)
)(lambda s, d: spectra.single_label(mixed(s, d, True), 1))
query(
    "pure_spectra",
    f"SELECT id AS mix_id, {', '.join(B)}, " + ", ".join(f"CASE WHEN cls = {i} THEN 1.0 ELSE 0.0 END AS {n}" for i, n in enumerate(spectra.CLASSES)) + " FROM spectra",
    " ".join(B + spectra.CLASSES),
)(lambda s, d: spectra.pure_spectra(library(s, d), B))

# fixed values: group centres on the first three bands and their relabelling
CENTRES, GROUPS = [[0.05, 0.05, 0.05], [0.2, 0.1, 0.05], [0.1, 0.2, 0.15]], [4, 2, 7]
D2 = ", ".join(
    f"{{'d': " + " + ".join(f"(b{j + 1} - {v}::DOUBLE) ** 2" for j, v in enumerate(c)) + f", 'g': {g}}}" for c, g in zip(CENTRES, GROUPS)
)
query(
    "assign_group",
    f"SELECT id, CASE WHEN id % 5 <> 0 AND b1 <= 0.3 THEN list_sort([{D2}])[1].g ELSE -10000 END AS soil_group FROM spectra",
)(
    lambda s, d: spectra.assign_group(
        library(s, d).withColumn("b1", F.when(F.col("b1") <= 0.3, F.col("b1"))), B[:3], CENTRES, GROUPS, F.pmod("id", F.lit(5)) != 0
    ).select("id", "soil_group")
)


def kmeans_sql(rounds: int = 8) -> dict[str, str]:
    """Every round as one table of centres after one of assignments."""
    d2 = lambda c: " + ".join(f"(x[{j + 1}] - {c}[{j + 1}]) * (x[{j + 1}] - {c}[{j + 1}])" for j in range(len(B)))
    out = {
        "kmx": "SELECT id, [" + ", ".join(f"(s.{b} - lo_{b}) / (hi_{b} - lo_{b})" for b in B) + "] AS x FROM spectra s, (SELECT "
        + ", ".join(f"min({b}) AS lo_{b}, max({b}) AS hi_{b}" for b in B) + " FROM spectra)",
        "kmc0": "SELECT k, i, x AS c FROM (SELECT x, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS i FROM kmx), range(2, 11) r(k) WHERE i < k",
    }
    for r in range(rounds + 1):
        out[f"kma{r}"] = f"""SELECT k, id, x, i, d FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY d, i) AS place FROM
            (SELECT k, id, x, i, {d2('c')} AS d FROM kmx, kmc{r})) WHERE place = 1"""
        if r < rounds:
            out[f"kmc{r + 1}"] = f"""SELECT c.k, c.i, coalesce(m.m, c.c) AS c FROM kmc{r} c LEFT JOIN
                (SELECT k, i, [{", ".join(f"avg(x[{j + 1}])" for j in range(len(B)))}] AS m FROM kma{r} GROUP BY 1, 2) m ON m.k = c.k AND m.i = c.i"""
    return out


# the silhouette by all pairs of rows, not by sums of groups
query(
    "fit_soil_groups",
    f"""WITH p AS (SELECT a.k, a.id, a.i AS own, b.i AS other, sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2))) AS s, count(*) AS n
          FROM kma8 a JOIN kma8 b ON a.k = b.k GROUP BY 1, 2, 3, 4),
        w AS (SELECT k, id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY 1, 2)
        SELECT CAST(w.k AS INT) AS k, avg(coalesce(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END * (a IS NOT NULL)::INT, 0)) AS silhouette, any_value(t.ss) AS within_ss
        FROM w JOIN (SELECT k, sum(d) AS ss FROM kma8 GROUP BY 1) t ON t.k = w.k GROUP BY w.k""",
    "silhouette within_ss", tables=kmeans_sql(),
)(lambda s, d: spectra.fit_soil_groups(library(s, d), B, list(range(2, 11))))

# --- network ensemble --------------------------------------------------------
HID, ITER = 4, 5
KLASS = ["PV", "NPV", "Soil"]


def weight(g, c, i, layer, k, j):
    return ((g * 7 + c * 11 + i * 13 + layer * 17 + k * 29 + j * 31) % 19 - 9) / 10.0


def model_weights(s):
    """Parameters by a fixed rule, in the layout of trained models."""
    rows = []
    for g in range(3):
        for c, name in enumerate(KLASS):
            for i in range(ITER):
                w0 = [[weight(g, c, i, 0, k, j) for j in range(10)] for k in range(HID)]
                w1 = [[weight(g, c, i, 1, 0, k) for k in range(HID)]]
                rows.append((g, name, i, 0, w0, [weight(g, c, i, 2, k, 0) for k in range(HID)]))
                rows.append((g, name, i, 1, w1, [weight(g, c, i, 3, 0, 0)]))
    return s.createDataFrame(
        rows, "soil_group int, class string, iteration int, layer int, w array<array<double>>, b array<double>"
    )


def w_sql(layer: str, k: str, j: str) -> str:
    return f"((g * 7 + c * 11 + i * 13 + {layer} * 17 + {k} * 29 + {j} * 31) % 19 - 9) / 10"


def net_sql(group: str) -> str:
    h = lambda k: "greatest(0, " + " + ".join(f"{b} * {w_sql('0', str(k), str(j))}" for j, b in enumerate(B)) + f" + {w_sql('2', str(k), '0')})"
    out = " + ".join(f"{h(k)} * {w_sql('1', '0', str(k))}" for k in range(HID)) + f" + {w_sql('3', '0', '0')}"
    return f"""SELECT id, avg(CASE WHEN c = 0 THEN o END) AS PV, avg(CASE WHEN c = 1 THEN o END) AS NPV, avg(CASE WHEN c = 2 THEN o END) AS Soil FROM
        (SELECT id, c, {out} AS o FROM (SELECT *, {group} AS g FROM spectra), range(3) a(c), range(5) e(i)) GROUP BY 1"""


def pixels_of_groups(s, d):
    return t.spectra(s, d).withColumn("soil_group", (F.pmod("id", F.lit(2)) + 1).cast("int"))


def both_sets(s, d):
    """Global and soil-specific models in one pass."""
    both = spectra.ensemble_predict_sets(pixels_of_groups(s, d), B, spectra.load_networks(model_weights(s)), {"_global": None, "_soil": "soil_group"})
    for q in ("global", "soil"):
        total = sum((F.greatest(f"{k}_{q}", F.lit(0.0)) for k in KLASS), F.lit(0.0))
        both = both.withColumns({f"{k}_norm_{q}": F.try_divide(F.greatest(f"{k}_{q}", F.lit(0.0)), F.nullif(total, F.lit(0.0))) for k in KLASS})
    return both.select("id", *[f"{k}{n}_{q}" for q in ("global", "soil") for n in ("", "_norm") for k in KLASS])


def norm_sql(p: str, q: str) -> str:
    tot = " + ".join(f"greatest({p}.{k}, 0)" for k in KLASS)
    return ", ".join(f"{p}.{k} AS {k}_{q}" for k in KLASS) + ", " + ", ".join(f"greatest({p}.{k}, 0) / nullif({tot}, 0) AS {k}_norm_{q}" for k in KLASS)


query(
    "ensemble_predict", f"SELECT a.id, {norm_sql('a', 'global')}, {norm_sql('b', 'soil')} FROM nga a JOIN nsb b ON a.id = b.id",
    " ".join(f"{k}{n}_{q}" for q in ("global", "soil") for n in ("", "_norm") for k in KLASS), digits=9,
    tables={"nga": net_sql("0"), "nsb": net_sql("id % 2 + 1")},
)(both_sets)

# --- features and regressors -------------------------------------------------


def feature_parts(s, d):
    g = t.grid_daily(s, d)
    day = rain.doy_climatology(g, ["cell"], "prec").withColumnRenamed("prec", "prec_daily_avg")
    lo = rain.month_climatology(g, ["cell"], "prec", "sum")
    hi = rain.month_climatology(g, ["cell"], "prec", "max")
    static = t.grid_static(s, d).select((F.col("cx") + 50 * F.col("cy")).alias("cell"), "elev", "slope", "aspect")
    target = t.station_curve(s, d).select(F.col("station").alias("cell"), "doy", "EI_daily_avg")
    return static, day, [lo, hi], target


MON = "CAST(month(DATE '2021-01-01' + CAST(doy - 1 AS INT)) AS INT)"
FEAT = {
    "fday": """SELECT cell, CAST(CASE WHEN (year(day) % 4 = 0 AND year(day) % 100 <> 0 OR year(day) % 400 = 0) AND dayofyear(day) > 60 THEN dayofyear(day) - 1 ELSE dayofyear(day) END AS INT) AS doy,
        avg(prec) AS prec_daily_avg FROM grid_daily WHERE NOT (month(day) = 2 AND day(day) = 29) GROUP BY 1, 2""",
    "fm1": "SELECT cell, month, avg(v) AS monthly_sum FROM (SELECT cell, CAST(month(day) AS INT) AS month, year(day) y, sum(prec) v FROM grid_daily GROUP BY ALL) GROUP BY 1, 2",
    "fm2": "SELECT cell, month, avg(v) AS monthly_max FROM (SELECT cell, CAST(month(day) AS INT) AS month, year(day) y, max(prec) v FROM grid_daily GROUP BY ALL) GROUP BY 1, 2",
    "fmon": "SELECT coalesce(fm1.cell, fm2.cell) AS cell, coalesce(fm1.month, fm2.month) AS month, monthly_sum, monthly_max FROM fm1 FULL JOIN fm2 ON fm1.cell = fm2.cell AND fm1.month = fm2.month",
    "fjoin": f"""SELECT a.cell, a.doy, a.prec_daily_avg, m.month, monthly_sum, monthly_max FROM (SELECT *, {MON} AS month FROM fday) a LEFT JOIN fmon m ON m.cell = a.cell AND m.month = a.month""",
    "ffull": """SELECT j.*, elev, slope, aspect, EI_daily_avg FROM fjoin j LEFT JOIN (SELECT cx + 50 * cy AS cell, elev, slope, aspect FROM grid_static) g ON g.cell = j.cell
        JOIN station_curve s ON s.station = j.cell AND s.doy = j.doy""",
}
query("outer_feature_join", "SELECT * FROM fmon", "monthly_sum monthly_max", tables=FEAT)(
    lambda s, d: features.outer_feature_join(feature_parts(s, d)[2], ["cell", "month"])
)
query("month_from_daily_join", "SELECT * FROM fjoin", "prec_daily_avg monthly_sum monthly_max", tables=FEAT)(
    lambda s, d: features.month_from_daily_join(
        feature_parts(s, d)[1], features.outer_feature_join(feature_parts(s, d)[2], ["cell", "month"]), ["cell"]
    )
)
query(
    "target_join", "SELECT fday.cell, fday.doy, prec_daily_avg, EI_daily_avg FROM fday JOIN station_curve s ON s.station = fday.cell AND s.doy = fday.doy",
    "prec_daily_avg EI_daily_avg", tables=FEAT,
)(lambda s, d: features.target_join(feature_parts(s, d)[1], feature_parts(s, d)[3], ["cell"]))


def climate_parts(g):
    """Daily and monthly features of a daily grid; the months' sums and maxima come from one grouping."""
    day = rain.doy_climatology(g, ["cell"], "prec").withColumnRenamed("prec", "prec_daily_avg")
    return day, [rain.month_climatology(g, ["cell"], "prec", ["sum", "max"])]


def table_of_features(s, d):
    static, _, _, target = feature_parts(s, d)
    # written, so that its size is known: only cells with a target have rows, and the others need no features
    target = cut_lineage(target)
    g = t.grid_daily(s, d).join(target.select("cell").distinct(), "cell", "left_semi")
    return features.feature_table(static, *climate_parts(g), ["cell"], target)


query(
    "feature_table",
    """SELECT *, sin(2 * pi() * doy / 365) AS sin_doy, cos(2 * pi() * doy / 365) AS cos_doy, sin(radians(aspect)) AS aspect_sin, cos(radians(aspect)) AS aspect_cos,
       prec_daily_avg / nullif(sum(prec_daily_avg) OVER (PARTITION BY cell), 0) AS prec_daily_fraction FROM ffull""",
    "prec_daily_avg monthly_sum monthly_max elev slope aspect EI_daily_avg sin_doy cos_doy aspect_sin aspect_cos prec_daily_fraction", tables=FEAT,
)(table_of_features)
XS = ["prec_daily_avg", "monthly_sum", "elev", "slope", "sin_doy", "cos_doy"]


COARSE = ["gx", "gy"]


def labelled(s, d):
    """Feature rows with a target, split by coarse cells of five by five."""
    x = learn.require_features(table_of_features(s, d), XS)
    x = x.withColumns({"gx": F.floor(F.pmod("cell", F.lit(50)) / 5), "gy": F.floor(F.col("cell") / 250)})
    return learn.split_by_group(x, COARSE, 0.2, seed=4)


def holdout_scores(x, kind, **kw):
    m = learn.fit_regressor(x.where("split = 'train'"), XS, "EI_daily_avg", kind, **kw)
    test = learn.grid_predict(m, x.where("split = 'test'").select("cell", "doy", *XS, "EI_daily_avg"), "predicted_EI_daily_avg")
    return stats.regression_scores(test, [], "EI_daily_avg", "predicted_EI_daily_avg").withColumn("model", F.lit(kind))


def both_kinds(s, d):
    x = cut_lineage(labelled(s, d))  # fits and scores of both kinds read it
    return sampling.union_all(holdout_scores(x, "rf", numTrees=20, maxDepth=5), holdout_scores(x, "gbt", maxIter=10, maxDepth=3))


def tuned(s, d):
    train = labelled(s, d).where("split = 'train'")
    return learn.tune_regressor(train, XS, "EI_daily_avg", "cell", [3, 5], [10, 20], folds=5)


def whole_grid(s, d):
    """Every cell and day that has features, with or without a gauge."""
    static, _, _, _ = feature_parts(s, d)
    # no model takes the share of the year
    return features.feature_table(static, *climate_parts(t.grid_daily(s, d)), ["cell"], fraction=False).dropna(subset=XS)


SPLIT = """SELECT cell, doy, CASE WHEN CAST('0x' || substr(md5('4|' || (cell % 50) // 5 || '|' || cell // 250), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2
    THEN 'test' ELSE 'train' END AS split FROM ffull"""
query("model_split", SPLIT, tables=FEAT)(lambda s, d: labelled(s, d).select("cell", "doy", "split"))
query("fit_regressor")(both_kinds)
query("tune_regressor")(lambda s, d: tuned(s, d)[0])


def predicted(s, d, best=None):
    best = best or tuned(s, d)[1]
    return learn.grid_predict(best, whole_grid(s, d).select("cell", "doy", *XS), "predicted_EI_daily_avg")


def forest(s, d):
    return learn.fit_regressor(labelled(s, d).where("split = 'train'"), XS, "EI_daily_avg", "rf", numTrees=20, maxDepth=5)


query("grid_predict")(predicted)
query(
    "grid_predict_rows",
    """SELECT j.cell, j.doy, TRUE AS is_valid FROM fjoin j JOIN (SELECT cx + 50 * cy AS cell, elev, slope, aspect FROM grid_static) g ON g.cell = j.cell
       WHERE prec_daily_avg IS NOT NULL AND monthly_sum IS NOT NULL AND elev IS NOT NULL AND slope IS NOT NULL""",
    tables=FEAT,
)(lambda s, d: predicted(s, d, forest(s, d)).select("cell", "doy", (F.col("predicted_EI_daily_avg") >= 0).alias("is_valid")))
query(
    "split_join",
    """SELECT m.station, m.height, m.exposition, g.elev, CASE WHEN u < 0.2 THEN 'test' ELSE 'train' END AS split FROM
       (SELECT *, CAST('0x' || substr(md5('9|' || station), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM station_meta) m
       LEFT JOIN grid_static g ON g.cx = m.station % 50 AND g.cy = m.station // 50""",
    "height elev",
)(
    lambda s, d: sampling.random_split(t.station_meta(s, d), ["station"], 0.2, seed=9)
    .withColumns({"cx": F.pmod("station", F.lit(50)), "cy": F.floor(F.col("station") / 50)})
    .join(t.grid_static(s, d), ["cx", "cy"], "left").select("station", "height", "exposition", "elev", "split")
)
VAL = """SELECT b.mission, count(*) AS n, sqrt(avg((f - p) ** 2)) AS RMSE, avg(abs(f - p)) AS MAE, sqrt(avg((f - p) ** 2)) / nullif(max(f) - min(f), 0) AS NRMSE,
    1 - avg((f - p) ** 2) / nullif(var_pop(f), 0) AS R2, corr(f, p) ** 2 AS r2_pearson FROM
    (SELECT cx // 2 AS bx, cy // 2 AS "by", (cx // 2) % 3 AS mission, avg(CASE WHEN slope > 20 THEN 1.0 ELSE 0.0 END) AS f FROM grid_static GROUP BY 1, 2 HAVING count(*) = 4) b
    JOIN (SELECT bx, "by", pv / (pv + npv + soil) AS p FROM (SELECT (l_partkey % 50) // 2 AS bx, (l_partkey // 50) // 2 AS "by", avg(l_discount) AS pv, avg(l_tax) AS npv, avg(l_quantity) / 1000 AS soil
      FROM lineitem GROUP BY 1, 2)) q ON q.bx = b.bx AND q."by" = b."by" GROUP BY 1"""


def validation(s, d):
    g = t.grid_static(s, d).withColumn("flag", (F.col("slope") > 20).cast("int"))
    truth = grid.block_fraction(g, 2, "flag").withColumn("mission", F.pmod("bx", F.lit(3)))
    fine = t.table(s, d, "lineitem").groupBy(
        F.floor(F.pmod("l_partkey", F.lit(50)) / 2).alias("bx"), F.floor(F.floor(F.col("l_partkey") / 50) / 2).alias("by")
    ).agg(F.avg("l_discount").alias("pv"), F.avg("l_tax").alias("npv"), (F.avg("l_quantity") / 1000).alias("soil"))
    p = cover.normalize_fractions(fine, V, "").select("bx", "by", "pv")
    return stats.regression_scores(truth.join(p, ["bx", "by"]), ["mission"], "fraction", "pv")


query("validation_join", VAL, "RMSE MAE NRMSE R2 r2_pearson")(validation)

# --- sources and sinks -------------------------------------------------------


def stations_back(s, d):
    path = io.scratch_path(s, "stations")
    e = t.rain_gappy(s, d).select(
        F.concat(F.lit("rain_"), F.col("station").cast("string")).alias("src"),
        F.date_format(tp.ntz_from_minutes(F.col("minute")), "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("rain").alias("rre150z0"),
    )
    e.repartition("src").write.option("header", "true").partitionBy("src").csv(f"{path}/good")
    e.select(F.concat(F.lit("other_"), F.col("src")).alias("src"), "time").write.option("header", "true").partitionBy("src").csv(f"{path}/lacking")
    return io.read_stations(s, path, folder=True).select("station", tp.iso_minute(F.col("time")).alias("time"), "rain")


query(
    "read_stations", "SELECT CAST(station AS VARCHAR) AS station, strftime(TIMESTAMP '1970-01-01' + minute * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS \"time\", rain FROM rain_gappy", "rain",
)(stations_back)


def delimited_back(s, d):
    path = io.scratch_path(s, "delimited")
    x = t.table(s, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("Fläche "), F.col("s_name")).alias("name"),
        F.when(F.pmod("s_suppkey", F.lit(9)) == 0, F.lit("k.A.")).otherwise(F.col("s_acctbal").cast("string")).alias("area"),
    )
    io.write_table(x, path, "csv", header="true", sep=";", encoding="ISO-8859-1")
    return io.read_delimited(s, path, ";", "ISO-8859-1", ["name", "area"], ["area"])


query("read_delimited", "SELECT 'Fläche ' || s_name AS name, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS area FROM supplier", "area")(delimited_back)
query("clean_columns", """SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS "time", value AS rre150z0 FROM events""", "rre150z0")(
    lambda s, d: rain.clean_columns(
        t.table(s, d, "events").select(F.col("user_id").alias('"user_id"'), tp.iso_minute(F.col("ts")).alias("'Date'"), F.col("value").alias(" 'rre150z0' ")),
        rename={"Date": "time"}, required=("rre150z0",),
    )
)
def laid_out(s, cells):
    path = io.scratch_path(s, "grid")
    io.write_grid(cells, path, size=8)
    return s.read.parquet(path)


query(
    "read_grid_subset",
    f"""SELECT cx, cy, elev FROM grid_static SEMI JOIN (SELECT DISTINCT CAST(floor((east - {t.X0}) / 100) AS BIGINT) AS cx, CAST(floor((north - {t.Y0}) / 100) AS BIGINT) AS cy FROM station_meta) q USING (cx, cy)""",
    "elev",
)(
    lambda s, d: io.read_grid_subset(
        laid_out(s, t.grid_static(s, d)),
        t.station_meta(s, d).select(grid.cell_of(F.col("east"), t.X0, 100.0).alias("cx"), grid.cell_of(F.col("north"), t.Y0, 100.0).alias("cy")), ["cx", "cy", "elev"],
        size=8,
    )
)


def partitioned_back(s, d):
    """All years, then one year again with doubled values: only that year changes."""
    path = io.scratch_path(s, "partitioned")
    x = t.fc_raw(s, d).groupBy("yr", "lnf_code").agg(F.count(F.lit(1)).alias("n"))
    io.write_partitioned(x, path, ["yr"])
    io.write_partitioned(x.where("yr = 1997").withColumn("n", F.col("n") * 2), path, ["yr"])
    return s.read.parquet(path).select("yr", "lnf_code", "n")


query("write_partitioned", "SELECT yr, lnf_code, count(*) * CASE WHEN yr = 1997 THEN 2 ELSE 1 END AS n FROM fc_raw GROUP BY 1, 2")(partitioned_back)


def written_back(s, d):
    path = io.scratch_path(s, "table")
    io.write_table(t.station_curve(s, d), path, "csv", header="true")
    return s.read.option("header", "true").schema("station bigint, doy int, EI_daily_avg double, predicted_EI_daily_avg double").csv(path)


query("write_table", "SELECT * FROM station_curve", "EI_daily_avg predicted_EI_daily_avg")(written_back)


def metadata_back(s, d):
    path = io.scratch_path(s, "fields")
    io.write_table(spatial.area_centroid(t.field(s, d)).select("id", "lnf_code", "area", "cx", "cy"), path)
    return s.read.parquet(path)


query("field_metadata", FIELD_META, "area cx cy", digits=2)(metadata_back)
