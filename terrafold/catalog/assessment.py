"""Reference lookups, stratified comparison, scores, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.cover_factor import pixel_c, risk
from terrafold.catalog.registry import query
from terrafold.catalog.space import FIELD_META, PROD, product
from terrafold.functions import classes
from terrafold.functions import timeparts as tp
from terrafold.operators import cfactor as cf
from terrafold.operators import lookup, masks, rain, sampling, spatial, stats

# --- lookups -----------------------------------------------------------------
NA = r"trim(regexp_replace(regexp_replace(lower({c}), '[(){{}}\[\],;:.\-/]', ' ', 'g'), '\s+', ' ', 'g'))"
BRIDGE = f"""SELECT l.lnf_code, CASE WHEN o.C_ref IS NOT NULL THEN o.crop_name ELSE l.crop_name END AS crop_name, l.a AS area_ha,
    coalesce(o.C_ref, e.C_ref, f.C_ref) AS C_ref
    FROM (SELECT lnf_code, crop_name, "2022_Area_m23" / 1e4 AS a, {NA.format(c='crop_name')} AS nn FROM lnf_label) l
    LEFT JOIN c_table e ON e.crop_name = l.crop_name
    LEFT JOIN (SELECT {NA.format(c='crop_name')} AS nn, min_by(C_ref, crop_name) AS C_ref FROM c_table GROUP BY 1) f ON f.nn = l.nn
    LEFT JOIN (SELECT o.lnf_code, o.crop_name, c.C_ref FROM override_table o JOIN c_table c USING (crop_name)) o ON o.lnf_code = l.lnf_code
    WHERE coalesce(o.C_ref, e.C_ref, f.C_ref) IS NOT NULL"""


def labels(s, d):
    return t.lnf_label(s, d).select("lnf_code", "crop_name", (F.col("2022_Area_m23") / 1e4).alias("area_ha"))


query("reference_bridge", BRIDGE, "area_ha C_ref")(
    lambda s, d: lookup.reference_bridge(labels(s, d), t.c_table(s, d), t.override_table(s, d))
)
query(
    "attach_reference",
    f"""SELECT p.poly_id, p.lnf_code, f.C_ref FROM parcel p LEFT JOIN lnf_label l USING (lnf_code)
        LEFT JOIN (SELECT {NA.format(c='crop_name')} AS nn, min_by(C_ref, crop_name) AS C_ref FROM c_table GROUP BY 1) f
        ON f.nn = {NA.format(c='l.crop_name')}""",
    "C_ref",
)(
    lambda s, d: lookup.attach_reference(t.parcel(s, d).select("poly_id", "lnf_code"), labels(s, d), t.c_table(s, d))
    .select("poly_id", "lnf_code", "C_ref")
)
MGMT = {
    "mt": f"""SELECT {NA.format(c='crop_name')} AS nn, C_ref AS C_old_total, split_part(k, '_', 1) AS Region, split_part(k, '_', 2) AS Bodenbearbeitung, v AS C_old_mgmt
        FROM (UNPIVOT c_table ON Tal_Pflug, Tal_Mulch, Berg_Pflug, Berg_Mulch INTO NAME k VALUE v)""",
    "cn": "SELECT lnf_code, poly_id, yr, avg(C) AS C_new, count(C) AS n_pixels FROM pixel_c GROUP BY 1, 2, 3",
    "mgmt": f"""SELECT p.*, CASE WHEN elevation_m > 450 THEN 'Berg' ELSE 'Tal' END AS Region, coalesce(tillage, 'Pflug') AS Bodenbearbeitung FROM parcel p""",
    "assess": f"""SELECT m.*, x.C_old_mgmt, x.C_old_total, c.yr, c.C_new, c.n_pixels FROM mgmt m LEFT JOIN lnf_label l ON l.lnf_code = m.lnf_code
        LEFT JOIN mt x ON x.nn = {NA.format(c='l.crop_name')} AND x.Region = m.Region AND x.Bodenbearbeitung = m.Bodenbearbeitung
        JOIN cn c ON c.poly_id = m.poly_id AND c.lnf_code = m.lnf_code""",
}


def c_new(s, d):
    return cf.parcel_cfactor(pixel_c(s, d), ["lnf_code", "poly_id", "yr"]).select("lnf_code", "poly_id", "yr", "C_new", "n_pixels")


def assess(s, d):
    return lookup.management_lookup(t.parcel(s, d), labels(s, d), t.c_table(s, d), c_new(s, d), limit=450.0)


query(
    "management_lookup", """SELECT poly_id, yr, Region, Bodenbearbeitung, C_old_mgmt, C_old_total, C_new FROM assess""",
    "C_old_mgmt C_old_total C_new", tables=MGMT,
)(lambda s, d: assess(s, d).select("poly_id", "yr", "Region", "Bodenbearbeitung", "C_old_mgmt", "C_old_total", "C_new"))
query(
    "export_join",
    """SELECT CAST(p.poly_id AS VARCHAR) AS poly_id, p.Flaeche, r.C_old_R FROM parcel p LEFT JOIN
       (SELECT CAST(o_custkey AS VARCHAR) AS k, max(o_totalprice) / 1e6 AS C_old_R FROM orders GROUP BY 1) r ON r.k = CAST(p.poly_id AS VARCHAR)""",
    "Flaeche C_old_R",
)(
    lambda s, d: lookup.export_join(
        t.parcel(s, d), t.table(s, d, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") / 1e6).alias("c_old")),
        {"o_custkey": "poly_id", "c_old": "C_old_R"}, ["poly_id"],
    ).select("poly_id", "Flaeche", "C_old_R")
)
# fixed value: five activity translations
ACTIVITIES = '{"click": "mowing", "view": "sowing", "purchase": "harvest", "error": "tillage", "signup": "fertilising"}'
ACT_SQL = "(VALUES ('click', 'mowing'), ('view', 'sowing'), ('purchase', 'harvest'), ('error', 'tillage'), ('signup', 'fertilising')) a(massnahme, activity)"
query(
    "calendar_join",
    f"""SELECT p.poly_id, c.datum::VARCHAR AS datum, coalesce(a.activity, c.massnahme) AS activity, count(*) AS n
        FROM parcel p JOIN calendar c ON c.parzellen_id = p.poly_id LEFT JOIN {ACT_SQL} USING (massnahme) GROUP BY 1, 2, 3""",
)(lambda s, d: _calendar(s, d).groupBy("poly_id", F.date_format("datum", "yyyy-MM-dd").alias("datum"), "activity").agg(F.count(F.lit(1)).alias("n")))


def _calendar(s, d):
    act = lookup.json_dictionary(s.createDataFrame([(ACTIVITIES,)], "j string"), "j", "massnahme", "activity")
    return lookup.calendar_join(t.parcel(s, d), t.calendar(s, d), act, "poly_id")


# --- strata ------------------------------------------------------------------
SPEAR = """(SELECT {k}, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(ra, rb) END AS rho FROM
    (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY a) + (count(*) OVER (PARTITION BY {k}, a) - 1) / 2 AS ra,
     rank() OVER (PARTITION BY {k} ORDER BY b) + (count(*) OVER (PARTITION BY {k}, b) - 1) / 2 AS rb
     FROM {src}) GROUP BY {k})"""
STRATA = {
    **MGMT,
    "strata": """SELECT 'by_crop' AS kind, CAST(lnf_code AS VARCHAR) AS label, * FROM assess UNION ALL
        SELECT 'by_region', Region, * FROM assess UNION ALL SELECT 'by_tillage', Bodenbearbeitung, * FROM assess UNION ALL
        SELECT 'by_crop_region', lnf_code || '/' || Region, * FROM assess UNION ALL SELECT 'by_year', CAST(yr AS VARCHAR), * FROM assess UNION ALL
        SELECT 'by_size', CASE WHEN Flaeche <= 5000 THEN '<0.5ha' WHEN Flaeche <= 10000 THEN '0.5–1ha' WHEN Flaeche <= 30000 THEN '1–3ha'
          WHEN Flaeche <= 100000 THEN '3–10ha' ELSE '>10ha' END, * FROM assess UNION ALL
        SELECT 'by_c_magnitude', CASE WHEN C_old_total IS NULL THEN '(none)' WHEN C_old_total <= 0.01 THEN 'very_low (≤0.01)' WHEN C_old_total <= 0.05 THEN 'low (0.01–0.05)'
          WHEN C_old_total <= 0.1 THEN 'medium (0.05–0.10)' WHEN C_old_total <= 0.2 THEN 'high (0.10–0.20)' ELSE 'very_high (>0.20)' END, * FROM assess UNION ALL
        SELECT 'by_quality', CASE WHEN poly_id % 7 > 0 THEN CAST(poly_id % 3 AS VARCHAR) ELSE '(none)' END, * FROM assess""",
    "spairs": "SELECT kind, label, C_old_total AS a, C_new AS b FROM strata WHERE C_old_total IS NOT NULL AND C_new IS NOT NULL",
}


def kinds(s, d):
    c = F.col
    return {
        "by_crop": c("lnf_code"), "by_region": c("Region"), "by_tillage": c("Bodenbearbeitung"),
        "by_crop_region": F.concat_ws("/", c("lnf_code").cast("string"), c("Region")), "by_year": c("yr"),
        "by_size": classes.bin_cut(c("Flaeche"), classes.SIZE_BINS, classes.SIZE_LABELS, True),
        "by_c_magnitude": classes.bin_cut(c("C_old_total"), classes.C_BINS, classes.C_LABELS),
        "by_quality": quality(),
    }


def quality():
    """A stand-in for a parcel's worst quality flag: 0 to 2, none for some."""
    return F.when(F.pmod("poly_id", F.lit(7)) > 0, F.pmod("poly_id", F.lit(3)))


query(
    "stratum_metrics",
    f"""SELECT s.kind, s.label, n, area_ha, mean_old, mean_new, bias, CASE WHEN mean_old > 0 THEN 100 * bias / mean_old END AS rel_bias_pct,
        MAE, RMSE, spread_C_new, r.rho AS spearman_rho FROM
        (SELECT kind, label, count(d) AS n, coalesce(sum(w), 0) / 1e4 AS area_ha, avg(o) AS mean_old, avg(c) AS mean_new, avg(d) AS bias,
         avg(abs(d)) AS MAE, sqrt(avg(d * d)) AS RMSE, CASE WHEN count(d) > 1 THEN stddev_samp(c) WHEN count(d) = 1 THEN 0.0 END AS spread_C_new
         FROM (SELECT kind, label, CASE WHEN C_old_total IS NOT NULL AND C_new IS NOT NULL THEN C_new - C_old_total END AS d,
           CASE WHEN C_old_total IS NOT NULL AND C_new IS NOT NULL THEN Flaeche END AS w,
           CASE WHEN C_old_total IS NOT NULL AND C_new IS NOT NULL THEN C_old_total END AS o,
           CASE WHEN C_old_total IS NOT NULL AND C_new IS NOT NULL THEN C_new END AS c FROM strata) GROUP BY 1, 2) s
        LEFT JOIN {SPEAR.format(k='kind, label', src='spairs')} r ON r.kind = s.kind AND r.label = s.label""",
    "area_ha mean_old mean_new bias rel_bias_pct MAE RMSE spread_C_new spearman_rho", tables=STRATA,
)(lambda s, d: stats.stratum_tables(assess(s, d), kinds(s, d), "C_old_total", "C_new", "Flaeche"))
query(
    "assessment_tables",
    """SELECT kind, label, sum(Flaeche * C_new) FILTER (C_new IS NOT NULL) / sum(Flaeche) FILTER (C_new IS NOT NULL) AS C_new,
       sum(Flaeche * C_old_mgmt) FILTER (C_old_mgmt IS NOT NULL) / sum(Flaeche) FILTER (C_old_mgmt IS NOT NULL) AS C_old_mgmt,
       sum(Flaeche) / 1e4 AS Flaeche_ha, count(*) AS n_parcel_years FROM strata GROUP BY 1, 2""",
    "C_new C_old_mgmt Flaeche_ha", tables=STRATA,
)(lambda s, d: stats.weighted_mean_tables(assess(s, d), kinds(s, d), ["C_new", "C_old_mgmt"], "Flaeche"))
PAIR = "C_old_total IS NOT NULL AND C_new IS NOT NULL"
query(
    "assessment_crop_year",
    f"""SELECT lnf_code, yr, count(*) FILTER ({PAIR}) AS n, coalesce(sum(Flaeche) FILTER ({PAIR}), 0) / 1e4 AS area_ha,
        avg(C_new - C_old_total) AS bias, avg(abs(C_new - C_old_total)) AS MAE, sqrt(avg((C_new - C_old_total) ** 2)) AS RMSE FROM assess GROUP BY 1, 2""",
    "area_ha bias MAE RMSE", tables=MGMT,
)(
    lambda s, d: stats.stratum_metrics(assess(s, d), ["lnf_code", "yr"], "C_old_total", "C_new", "Flaeche")
    .select("lnf_code", "yr", "n", "area_ha", "bias", "MAE", "RMSE")
)
query(
    "assessment_headline",
    f"""SELECT 'rows' AS level, count(*) AS n, avg(C_new - C_old_total) AS bias, avg(abs(C_new - C_old_total)) AS MAE FROM assess WHERE {PAIR} UNION ALL
        SELECT 'groups', count(*), avg(v - r), avg(abs(v - r)) FROM (SELECT lnf_code, avg(C_new) AS v, avg(C_old_total) AS r FROM assess WHERE {PAIR} GROUP BY 1)""",
    "bias MAE", tables=MGMT,
)(lambda s, d: stats.headline(assess(s, d), "C_old_total", "C_new", "lnf_code"))
CB = " ".join(f"WHEN {{c}} <= {hi} THEN '{label}'" for hi, label in zip(classes.C_BINS[1:-1], classes.C_LABELS))
CLASS = f"CASE WHEN {{c}} IS NULL OR {{c}} <= {classes.C_BINS[0]} THEN NULL {CB} ELSE '{classes.C_LABELS[-1]}' END"
query(
    "assessment_class_confusion",
    f"""WITH k AS (SELECT Region AS stratum, {CLASS.format(c="C_old_total")} AS o, {CLASS.format(c="C_new")} AS n FROM assess), v AS (SELECT * FROM k WHERE stratum IS NOT NULL AND o IS NOT NULL AND n IS NOT NULL),
        lab AS (SELECT unnest({classes.C_LABELS}) AS l), s AS (SELECT DISTINCT stratum FROM v)
        SELECT s.stratum, a.l AS "old", b.l AS "new", count(v.o) AS n, (SELECT count(*) FILTER (w.o = w.n) / nullif(count(*), 0) FROM v w WHERE w.stratum = s.stratum AND w.o = a.l) AS kept_share
        FROM s CROSS JOIN lab a CROSS JOIN lab b LEFT JOIN v ON v.stratum = s.stratum AND v.o = a.l AND v.n = b.l GROUP BY 1, 2, 3""",
    "kept_share", tables=MGMT,
)(
    lambda s, d: stats.class_confusion(
        assess(s, d), classes.bin_cut(F.col("C_old_total"), classes.C_BINS, classes.C_LABELS), classes.bin_cut(F.col("C_new"), classes.C_BINS, classes.C_LABELS),
        classes.C_LABELS, F.col("Region"),
    )
)
query(
    "assessment_extremes",
    f"""WITH m AS (SELECT lnf_code, count(*) AS n, round(avg(abs(C_new - C_old_total)), 9) AS MAE FROM assess WHERE {PAIR} GROUP BY 1 HAVING count(*) >= 10)
        SELECT 'best' AS side, CAST(p AS INT) AS place, lnf_code, n, MAE FROM (SELECT *, row_number() OVER (ORDER BY MAE, lnf_code) AS p FROM m) WHERE p <= 5 UNION ALL
        SELECT 'worst', CAST(p AS INT), lnf_code, n, MAE FROM (SELECT *, row_number() OVER (ORDER BY MAE DESC, lnf_code) AS p FROM m) WHERE p <= 5""",
    "MAE", tables=MGMT,
)(
    lambda s, d: stats.best_and_worst(
        stats.stratum_metrics(assess(s, d), ["lnf_code"], "C_old_total", "C_new", "Flaeche").withColumn("MAE", F.round("MAE", 9)), "MAE", 5, 10, ["lnf_code"]
    )
)
query(
    "area_weighted_mean",
    """SELECT Gemeinde, sum(Flaeche * C_new) FILTER (C_new IS NOT NULL) / sum(Flaeche) FILTER (C_new IS NOT NULL) AS C_new, sum(Flaeche) / 1e4 AS Flaeche_ha,
       count(*) AS n_parcel_years FROM assess GROUP BY 1""",
    "C_new Flaeche_ha", tables=MGMT,
)(lambda s, d: stats.weighted_mean(assess(s, d), ["Gemeinde"], ["C_new"], "Flaeche"))
RB = "CASE WHEN {c} > -0.001 AND {c} <= 0.25 THEN 'low' WHEN {c} > 0.25 AND {c} <= 2 THEN 'medium' WHEN {c} > 2 AND {c} <= 8 THEN 'high' WHEN {c} > 8 AND {c} <= 20 THEN 'very_high' WHEN {c} > 20 THEN 'extreme' END"
query(
    "risk_confusion",
    f"""WITH pc AS (SELECT poly_id, avg(C) AS C_new FROM pixel_c GROUP BY 1),
        r AS (SELECT {RB.format(c='(lnf_code / 50 * er_pot * p_factor)')} AS o, {RB.format(c='(C_new * er_pot * p_factor)')} AS n FROM parcel JOIN pc USING (poly_id)),
        k AS (SELECT o, n FROM r WHERE o IS NOT NULL AND n IS NOT NULL), lab AS (SELECT unnest(['low', 'medium', 'high', 'very_high', 'extreme']) AS l)
        SELECT a.l AS "old", b.l AS "new", count(k.o) AS n, (SELECT count(*) FILTER (o = n) / count(*) FROM k) AS agreement
        FROM lab a CROSS JOIN lab b LEFT JOIN k ON k.o = a.l AND k.n = b.l GROUP BY 1, 2""",
    "agreement",
)(
    lambda s, d: stats.risk_confusion(
        risk(s, d), classes.bin_cut(F.col("ers_risk_old_total"), classes.RISK_BINS, classes.RISK_LABELS),
        classes.bin_cut(F.col("ers_risk_new"), classes.RISK_BINS, classes.RISK_LABELS), classes.RISK_LABELS,
    )
)
query(
    "rank_correlation",
    f"""SELECT q.month, q.n, pearson_r, slope, intercept, r.rho AS spearman_rho FROM
        (SELECT CAST(month(DATE '2021-01-01' + CAST(doy - 1 AS INT)) AS INT) AS month, count(*) AS n, corr(EI_daily_avg, predicted_EI_daily_avg) AS pearson_r,
         regr_slope(predicted_EI_daily_avg, EI_daily_avg) AS slope, regr_intercept(predicted_EI_daily_avg, EI_daily_avg) AS intercept FROM station_curve GROUP BY 1) q
        JOIN {SPEAR.format(k='month', src='mm')} r ON r.month = q.month""",
    "pearson_r slope intercept spearman_rho",
    tables={"mm": "SELECT CAST(month(DATE '2021-01-01' + CAST(doy - 1 AS INT)) AS INT) AS month, EI_daily_avg AS a, predicted_EI_daily_avg AS b FROM station_curve"},
)(
    lambda s, d: stats.rank_correlation(
        t.station_curve(s, d).withColumn("month", tp.month_of_doy(F.col("doy"))), ["month"], "EI_daily_avg", "predicted_EI_daily_avg"
    )
)

# --- scores ------------------------------------------------------------------
query(
    "regression_scores",
    """SELECT station, count(*) AS n, sqrt(avg((o - p) ** 2)) AS RMSE, avg(abs(o - p)) AS MAE, sqrt(avg((o - p) ** 2)) / (max(o) - min(o)) AS NRMSE,
       1 - avg((o - p) ** 2) / var_pop(o) AS R2, corr(o, p) ** 2 AS r2_pearson FROM (SELECT station, EI_daily_avg AS o, predicted_EI_daily_avg AS p FROM station_curve) GROUP BY 1""",
    "RMSE MAE NRMSE R2 r2_pearson", digits=9,
)(lambda s, d: stats.regression_scores(t.station_curve(s, d), ["station"], "EI_daily_avg", "predicted_EI_daily_avg"))
CURVES = {
    "cum": """SELECT station, doy, sum(EI_daily_avg) OVER w / sum(EI_daily_avg) OVER (PARTITION BY station) * 100 AS o,
        sum(predicted_EI_daily_avg) OVER w / sum(predicted_EI_daily_avg) OVER (PARTITION BY station) * 100 AS p
        FROM station_curve WINDOW w AS (PARTITION BY station ORDER BY doy)""",
    "kge": """SELECT station, 1 - sqrt((corr(o, p) - 1) ** 2 + (stddev_pop(p) / stddev_pop(o) - 1) ** 2 + (avg(p) / avg(o) - 1) ** 2) AS KGE,
        1 - sum((o - p) ** 2) / (var_pop(o) * count(*)) AS NSE FROM cum GROUP BY 1""",
}


def curves(s, d):
    c = rain.cumulative_percent(t.station_curve(s, d), ["station"])
    return rain.cumulative_percent(c, ["station"], "predicted_EI_daily_avg", prefix="predicted_EI_daily")


def kge(s, d):
    return stats.kge_nse(curves(s, d), ["station"], "EI_daily_cumsum", "predicted_EI_daily_cumsum")


query("kge_nse", "SELECT * FROM kge", "KGE NSE", tables=CURVES)(kge)
query(
    "kge_nse_summary", "SELECT avg(KGE) AS mean_KGE, stddev_samp(KGE) AS std_KGE, avg(NSE) AS mean_NSE, stddev_samp(NSE) AS std_NSE FROM kge",
    "mean_KGE std_KGE mean_NSE std_NSE", tables=CURVES,
)(lambda s, d: stats.kge_nse_summary(kge(s, d)))
query(
    "ensemble_spread",
    f"""SELECT g, avg(sd) AS mean_std, avg(sd / nullif(abs(m), 0)) AS mean_cv, avg(sd) * {stats.T_975_DF4} / sqrt(5) AS mean_half_width FROM
        (SELECT l_suppkey % 3 AS g, l_partkey, stddev_pop(l_discount) AS sd, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
    "mean_std mean_cv mean_half_width",
)(
    lambda s, d: stats.ensemble_spread(
        t.table(s, d, "lineitem").withColumn("g", F.pmod("l_suppkey", F.lit(3))), ["l_partkey"], ["g"], "l_discount"
    )
)
query(
    "score_by_model",
    """SELECT class_type, CASE WHEN soil_group = 0 THEN 'Global' ELSE 'Soil-specific' END AS model, avg(rmse) AS mean, stddev_samp(rmse) AS std,
       count(rmse) AS "count", 1.96 * stddev_samp(rmse) / sqrt(count(rmse)) AS ci FROM score GROUP BY 1, 2""",
    "mean std ci",
)(
    lambda s, d: stats.score_by_model(
        t.score(s, d).withColumn("model", F.when(F.col("soil_group") == 0, "Global").otherwise("Soil-specific")), ["class_type", "model"], "rmse"
    )
)
query(
    "cross_group_scores",
    """SELECT soil_group, iteration, test_soil, count(*) AS n, sqrt(avg((o - p) ** 2)) AS RMSE, avg(abs(o - p)) AS MAE,
       sqrt(avg((o - p) ** 2)) / (max(o) - min(o)) AS NRMSE, 1 - avg((o - p) ** 2) / nullif(var_pop(o), 0) AS R2, corr(o, p) ** 2 AS r2_pearson,
       CASE WHEN soil_group = 0 THEN 'Global' ELSE 'Soil-specific' END AS model FROM
       (SELECT l_suppkey % 4 AS soil_group, l_linenumber AS iteration, l_partkey % 4 AS test_soil, l_quantity AS p, o_totalprice / 1e4 AS o
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE soil_group = 0 OR soil_group = test_soil GROUP BY 1, 2, 3""",
    "RMSE MAE NRMSE R2 r2_pearson",
)(
    lambda s, d: stats.cross_group_scores(
        t.table(s, d, "lineitem").select(
            "l_orderkey", F.pmod("l_suppkey", F.lit(4)).alias("soil_group"), F.col("l_linenumber").alias("iteration"),
            F.pmod("l_partkey", F.lit(4)).alias("test_soil"), F.col("l_quantity").alias("p"),
        ),
        t.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1e4).alias("o")),
        ["l_orderkey"], "o", "p",
    )
)
WELCH = """SELECT class_type, na, nb, (ma - mb) / sqrt(va / na + vb / nb) AS t,
    (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM
    (SELECT class_type, count(*) FILTER (soil_group = 0) na, count(*) FILTER (soil_group <> 0) nb, avg(rmse) FILTER (soil_group = 0) ma,
     avg(rmse) FILTER (soil_group <> 0) mb, var_samp(rmse) FILTER (soil_group = 0) va, var_samp(rmse) FILTER (soil_group <> 0) vb FROM score GROUP BY 1)"""


def welch(s, d):
    return stats.welch_test(t.score(s, d), ["class_type"], F.col("soil_group") == 0, "rmse")


query("welch_test", WELCH, "t df", digits=4)(welch)


def tail_sql(t: str, df: str) -> str:
    """Student's tail by Simpson's rule with twice the steps of the operator."""
    area = lambda a: f"""((pi() / 2 - {a}) / 800 * list_sum(list_transform(range(801), lambda i:
        CASE WHEN i IN (0, 800) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * abs(cos({a} + (pi() / 2 - {a}) / 800 * i)) ** ({df} - 1))))"""
    return f"least(1.0::DOUBLE, {area(f'atan(abs({t}) / sqrt({df}))')} / {area('0.0::DOUBLE')})"


query("welch_p", f"SELECT *, {tail_sql('t', 'df')} AS p FROM ({WELCH})", "t df p", digits=4)(
    lambda s, d: stats.welch_p(welch(s, d))
)
query(
    "mean_interval",
    f"""WITH RECURSIVE g AS (SELECT class_type, avg(rmse) AS mean, count(rmse) AS n, stddev_samp(rmse) AS sd FROM score GROUP BY 1),
        h AS (SELECT DISTINCT n, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS i FROM g WHERE n > 1 UNION ALL
          SELECT n, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, i + 1 FROM
          (SELECT *, {tail_sql('mid', '(n - 1)')} > 0.05 AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM h WHERE i < 50)))
        SELECT class_type, mean, g.n, coalesce(sd, 0) / sqrt(g.n) * coalesce((lo + hi) / 2, 0) AS ci FROM g LEFT JOIN h ON h.n = g.n AND h.i = 50""",
    "mean ci",
)(lambda s, d: stats.mean_interval(t.score(s, d), ["class_type"], "rmse"))
query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem"
        for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
        for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]
    ),
    "r",
)(lambda s, d: stats.correlation_matrix(t.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
B10 = [f"b{i}" for i in range(1, 11)]
query(
    "percentile_spectra",
    " UNION ALL ".join(
        f"SELECT cls, yr, '{b}' AS band, quantile_cont({b}, 0.25) AS q25, quantile_cont({b}, 0.5) AS q50, quantile_cont({b}, 0.75) AS q75 FROM spectra GROUP BY 1, 2"
        for b in B10
    ),
    "q25 q50 q75", digits=8,
)(lambda s, d: stats.percentile_spectra(t.spectra(s, d).drop("id"), ["cls", "yr"], B10))
query(
    "quantile_band",
    """SELECT month, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM
       (SELECT CAST(month(l_shipdate) AS INT) AS month, l_extendedprice AS v FROM lineitem) GROUP BY 1""", "q25 q50 q75",
)(
    lambda s, d: stats.quantile_band(
        t.table(s, d, "lineitem").select(F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("v")), ["month"], "v"
    )
)
query(
    "extreme_summary",
    """SELECT month, min(v) AS min, max(v) AS max, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.99) AS p99
       FROM (SELECT CAST(month(o_orderdate) AS INT) AS month, o_totalprice AS v FROM orders) GROUP BY 1""",
    "min max mean median p01 p99", digits=4,
)(
    lambda s, d: stats.extreme_summary(
        t.table(s, d, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("v")), ["month"], "v"
    )
)
query(
    "regional_curve",
    """SELECT region, doy, quantile_cont(o, 0.5) AS median, avg(o) AS mean FROM
       (SELECT 'r' || (station % 4) AS region, doy, o FROM cum UNION ALL SELECT 'Overall', doy, o FROM cum) GROUP BY 1, 2""",
    "median mean", tables=CURVES,
)(
    lambda s, d: stats.regional_curve(
        curves(s, d).withColumn("region", F.concat(F.lit("r"), F.pmod("station", F.lit(4)).cast("string"))), "region", "doy", "EI_daily_cumsum"
    )
)
query(
    "category_counts",
    """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_b,
       count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'N') AS difference, count(*) AS n FROM lineitem GROUP BY 1""",
)(lambda s, d: stats.category_counts(t.table(s, d, "lineitem"), "l_suppkey", "l_returnflag", "A", "N"))

# --- ranking and sampling ----------------------------------------------------
query(
    "top_crops",
    """SELECT DISTINCT crop_name FROM (SELECT crop_name, row_number() OVER (PARTITION BY k ORDER BY v DESC, crop_name) AS rn FROM
       (UNPIVOT lnf_label ON "2021_Area_m22", "2022_Area_m23", "2023_Area_m2" INTO NAME k VALUE v)) WHERE rn <= 5 AND crop_name NOT IN ('Nation, 3')""",
)(lambda s, d: sampling.top_crops(t.lnf_label(s, d), "crop_name", ["2021_Area_m22", "2022_Area_m23", "2023_Area_m2"], 5, ["Nation, 3"]))
query(
    "top_k",
    """(SELECT station, RMSE, n, 'best' AS side FROM m WHERE n >= 200 ORDER BY RMSE, station LIMIT 5) UNION ALL
       (SELECT station, RMSE, n, 'worst' AS side FROM m WHERE n >= 200 ORDER BY RMSE DESC, station LIMIT 5)""",
    "RMSE", tables={"m": "SELECT station, count(*) AS n, sqrt(avg((EI_daily_avg - predicted_EI_daily_avg) ** 2)) AS RMSE FROM station_curve GROUP BY 1"},
)(
    lambda s, d: sampling.best_and_worst(
        stats.regression_scores(t.station_curve(s, d), ["station"], "EI_daily_avg", "predicted_EI_daily_avg").select("station", "RMSE", "n"),
        "RMSE", "station", "n", 200, 5,
    )
)
query("ordered_output", "SELECT poly_id, yr, C_old_total FROM assess ORDER BY C_old_total DESC NULLS LAST, poly_id", "C_old_total", tables=MGMT)(
    lambda s, d: sampling.ordered_output(assess(s, d).select("poly_id", "yr", "C_old_total"), "C_old_total", "poly_id")
)
query(
    "first_per_key",
    """SELECT c_nationkey, min_by(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1""", "c_acctbal",
)(
    lambda s, d: sampling.first_per_key(
        t.table(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.struct(-F.col("c_acctbal"), F.col("c_custkey"))
    )
)
query(
    "sample_per_group",
    """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7|' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 10""",
)(lambda s, d: sampling.sample_per_group(t.table(s, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 10, seed=7))
U = "greatest(CAST('0x' || substr(md5({k}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE, 2.0::DOUBLE ** -33)"
query(
    "sample_weighted",
    f"""SELECT lnf_code, poly_id FROM (SELECT *, row_number() OVER (PARTITION BY lnf_code ORDER BY -ln({U.format(k="'3|' || poly_id")}) / Flaeche, poly_id) AS rn
        FROM parcel) WHERE rn <= 2""",
)(lambda s, d: sampling.sample_weighted(t.parcel(s, d).select("lnf_code", "poly_id", "Flaeche"), ["lnf_code"], ["poly_id"], "Flaeche", 2, seed=3).drop("Flaeche"))
query(
    "sample_weighted_replace",
    """WITH c AS (SELECT lnf_code, poly_id, Flaeche, sum(Flaeche) OVER (PARTITION BY lnf_code ORDER BY md5('3|' || poly_id), poly_id) AS c1,
          sum(Flaeche) OVER (PARTITION BY lnf_code) AS total FROM parcel WHERE Flaeche > 0),
        d AS (SELECT DISTINCT lnf_code, CAST(draw AS INT) AS draw, total * CAST('0x' || substr(md5('3|' || lnf_code || '|' || draw), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS pos
          FROM c, range(4) r(draw))
        SELECT c.lnf_code, draw, poly_id FROM c JOIN d ON d.lnf_code = c.lnf_code AND pos < c1 AND pos >= c1 - Flaeche""",
)(
    lambda s, d: sampling.sample_weighted(
        t.parcel(s, d).select("lnf_code", "poly_id", "Flaeche"), ["lnf_code"], ["poly_id"], "Flaeche", 4, seed=3, replace=True
    ).select("lnf_code", "draw", "poly_id")
)
query(
    "aoi_samples", f"SELECT id, CAST(yr AS INT) AS yr, cx AS x, cy AS y FROM ({FIELD_META}), (VALUES (2021), (2022), (2023)) y(yr)", "x y", digits=2
)(lambda s, d: sampling.aoi_samples(t.field(s, d), [2021, 2022, 2023]).select("id", "yr", "x", "y"))
NDVI = """SELECT px, l AS day, avg(n) AS ndvi, avg(w) AS swir_ratio FROM (SELECT l_partkey AS px, CAST(l_shipdate AS DATE) AS l,
    (floor(l_quantity * 60 + 3000) - floor(l_discount * 30000 + 200)) / (floor(l_quantity * 60 + 3000) + floor(l_discount * 30000 + 200)) AS n,
    floor(l_tax * 20000 + l_discount * 10000 + 300) / floor(l_tax * 40000 + 500) AS w FROM lineitem) GROUP BY 1, 2"""


def ndvi_series(s, d):
    from terrafold.functions import indices

    li = t.table(s, d, "lineitem").select(
        F.col("l_partkey").alias("px"), F.to_date("l_shipdate").alias("day"),
        F.floor(F.col("l_quantity") * 60 + 3000).alias("b8"), F.floor(F.col("l_discount") * 30000 + 200).alias("b4"),
        F.floor(F.col("l_tax") * 20000 + F.col("l_discount") * 10000 + 300).alias("b12"), F.floor(F.col("l_tax") * 40000 + 500).alias("b11"),
    )
    x = li.withColumns({"ndvi": indices.ratio_index(F.col("b8"), F.col("b4")), "swir_ratio": indices.swir_ratio(F.col("b12"), F.col("b11"))})
    return x.groupBy("px", "day").agg(F.avg("ndvi").alias("ndvi"), F.avg("swir_ratio").alias("swir_ratio"))


query(
    "extreme_pick",
    """WITH q AS (SELECT px, quantile_cont(ndvi, 0.7) AS hi, quantile_cont(ndvi, 0.3) AS lo FROM nd GROUP BY 1 HAVING max(ndvi) > 0.1),
       c AS (SELECT nd.*, hi, lo FROM nd JOIN q USING (px)),
       p AS (SELECT px, 'pv' AS kind, ndvi, swir_ratio, swir_ratio AS o, day FROM c WHERE ndvi >= hi UNION ALL
             SELECT px, 'npv', ndvi, swir_ratio, swir_ratio, day FROM c WHERE ndvi <= lo AND month(day) * 100 + day(day) BETWEEN 601 AND 1115 UNION ALL
             SELECT px, 'soil', ndvi, swir_ratio, -swir_ratio, day FROM c WHERE ndvi <= lo)
       SELECT px, kind, ndvi, swir_ratio FROM (SELECT *, row_number() OVER (PARTITION BY px, kind ORDER BY o, day) AS rn FROM p) WHERE rn = 1""",
    "ndvi swir_ratio", tables={"nd": NDVI}, digits=9,
)(lambda s, d: sampling.extreme_pick(ndvi_series(s, d), ["px"], "day").select("px", "kind", "ndvi", "swir_ratio"))
query(
    "sample_cells",
    """SELECT x, y, doy, ei FROM ei_grid SEMI JOIN (SELECT x, y FROM (SELECT DISTINCT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM ei_grid)
       ORDER BY md5('0|' || x || '|' || y), x, y LIMIT 6) k USING (x, y)""",
    "x y ei",
)(
    lambda s, d: sampling.sample_cells(
        t.ei_grid(s, d).withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")}), ["x", "y"], 6
    ).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
)
query(
    "spatial_split",
    """WITH st AS (SELECT DISTINCT station, CAST(floor(east / 500) AS BIGINT) AS grid_x, CAST(floor(north / 500) AS BIGINT) AS grid_y FROM station_meta),
       c AS (SELECT grid_x, grid_y, row_number() OVER (ORDER BY md5('42|' || grid_x || '|' || grid_y)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT grid_x, grid_y FROM st))
       SELECT station, grid_x, grid_y, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
       FROM st JOIN c USING (grid_x, grid_y)""",
)(lambda s, d: sampling.spatial_split(t.station_meta(s, d), "station", "east", "north", size=500.0))
query(
    "random_split", f"""SELECT id, CASE WHEN CAST('0x' || substr(md5('5|' || id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split FROM spectra"""
)(lambda s, d: sampling.random_split(t.spectra(s, d), ["id"], 0.2, seed=5).select("id", "split"))
query(
    "union_all",
    """SELECT station, doy, EI_daily_avg, NULL::DOUBLE AS ei FROM station_curve UNION ALL SELECT NULL, doy, NULL, ei FROM ei_grid""",
    "station EI_daily_avg ei",
)(
    lambda s, d: sampling.union_all(
        t.station_curve(s, d).select(F.col("station").cast("double").alias("station"), "doy", "EI_daily_avg"), t.ei_grid(s, d).select("doy", "ei")
    )
)
query("distinct", "SELECT DISTINCT lnf_code, yr FROM fc_raw")(lambda s, d: t.fc_raw(s, d).select("lnf_code", "yr").distinct())
query(
    "complete_cells",
    """SELECT station, month, m FROM (SELECT *, count(*) OVER (PARTITION BY station) AS k FROM (SELECT l_partkey AS station, CAST(month(l_shipdate) AS INT) AS month,
       max(l_quantity) AS m FROM lineitem GROUP BY 1, 2)) WHERE k = 12 AND station NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)""",
    "m",
)(
    lambda s, d: sampling.intersect_except(
        sampling.complete_cells(
            t.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("station"), F.month("l_shipdate").alias("month")).agg(F.max("l_quantity").alias("m")),
            ["station"], "m",
        ),
        t.table(s, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("station")), ["station"],
    )
)

# --- prediction against product ----------------------------------------------
MONTHLY = """SELECT station, CAST(month(DATE '2021-01-01' + CAST(doy - 1 AS INT)) AS INT) AS month, sum(predicted_EI_daily_avg) AS p FROM station_curve GROUP BY 1, 2"""
SHAPE = {
    "mprod": PROD,
    "msc": MONTHLY,
    "paired": "SELECT m.station, m.month, m.p, r.product AS b FROM msc m JOIN mprod r ON r.cx + 50 * r.cy = m.station AND r.month = m.month",
    "full12": "SELECT * FROM paired WHERE station IN (SELECT station FROM paired GROUP BY 1 HAVING count(b) = 12)",
    "shape": """SELECT month, 100 * sum(p) OVER w / sum(p) OVER (PARTITION BY station) AS pc, 100 * sum(b) OVER w / sum(b) OVER (PARTITION BY station) AS bc
        FROM full12 WINDOW w AS (PARTITION BY station ORDER BY month)""",
}


def compared(s, d):
    m = rain.monthly_ei(t.station_curve(s, d), ["station"], "predicted_EI_daily_avg")
    p = product(s, d).select((F.col("cx") + 50 * F.col("cy")).alias("station"), "month", "product")
    # twelve rows a cell, which the file's size does not tell: never a broadcast
    return m.join(p.hint("merge"), ["station", "month"])


query(
    "shape_check",
    """SELECT month, quantile_cont(pc, 0.25) AS pred_q25, quantile_cont(pc, 0.5) AS pred_q50, quantile_cont(pc, 0.75) AS pred_q75,
       quantile_cont(bc, 0.25) AS ref_q25, quantile_cont(bc, 0.5) AS ref_q50, quantile_cont(bc, 0.75) AS ref_q75, quantile_cont(pc - bc, 0.5) AS bias
       FROM shape GROUP BY 1""",
    "pred_q25 pred_q50 pred_q75 ref_q25 ref_q50 ref_q75 bias", tables=SHAPE,
)(lambda s, d: __import__("terrafold.plans.validation", fromlist=["x"]).shape_check(compared(s, d), ["station"], "EI_month", "product"))
query(
    "spatial_check",
    f"""SELECT q.month, q.n, pearson_r, slope, intercept, r.rho AS spearman_rho FROM (SELECT month, count(*) AS n, corr(b, p) AS pearson_r, regr_slope(p, b) AS slope,
        regr_intercept(p, b) AS intercept FROM paired WHERE p >= 0 AND b >= 0 GROUP BY 1) q JOIN {SPEAR.format(k='month', src='cmp')} r ON r.month = q.month""",
    "pearson_r slope intercept spearman_rho", tables={**SHAPE, "cmp": "SELECT month, b AS a, p AS b FROM paired WHERE p >= 0 AND b >= 0"},
)(
    lambda s, d: stats.rank_correlation(
        compared(s, d).where((F.col("EI_month") >= 0) & (F.col("product") >= 0)), ["month"], "product", "EI_month"
    )
)
