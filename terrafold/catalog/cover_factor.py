"""Cover factor chain: snap join, C per pixel/crop/parcel/field, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.registry import query
from terrafold.functions import timeparts as tp
from terrafold.operators import cfactor as cf
from terrafold.operators import cover

PIXEL = ["lnf_code", "yr", "poly_id", "x", "y"]
BETAS = cf.beta_grid(1e-4, 0.1, 60)


def fc_ei(s, d):
    return cf.grid_snap_join(t.fc_pixel(s, d), t.ei_grid(s, d), t.X0, t.Y0)


def pixel_c(s, d):
    return cf.cfactor(fc_ei(s, d), PIXEL)


@query("grid_snap_join", """SELECT lnf_code, poly_id, x, y, strftime("time", '%Y-%m-%d') AS day, fc_total, ei FROM fc_ei""",
       "x y fc_total ei")
def _(s, d):
    return fc_ei(s, d).select("lnf_code", "poly_id", "x", "y", tp.iso_date(F.col("time")).alias("day"), "fc_total", "ei")


query("cfactor", "SELECT * FROM pixel_c", "x y C")(pixel_c)

query("crop_mean", "SELECT lnf_code, avg(C) AS C_predicted FROM pixel_c WHERE C IS NOT NULL GROUP BY 1", "C_predicted")(
    lambda s, d: cf.crop_mean(pixel_c(s, d))
)

query(
    "parcel_cfactor",
    """SELECT poly_id, yr, avg(C) AS C_new, stddev_samp(C) AS C_new_sd, count(C) AS n_pixels, max(lnf_code % 3) AS flag
       FROM pixel_c GROUP BY 1, 2""",
    "C_new C_new_sd",
)(lambda s, d: cf.parcel_cfactor(pixel_c(s, d).withColumn("flag", F.col("lnf_code") % 3), ["poly_id", "yr"], "flag"))

FTS = """SELECT poly_id, CAST("time" AS DATE) AS day, avg(fc_total) AS fc_mean, stddev_pop(fc_total) AS fc_std,
    count(fc_total) AS n_pix FROM fc_pixel WHERE fc_total IS NOT NULL GROUP BY 1, 2"""


def field_stats(s, d):
    return cf.field_time_stats(t.fc_pixel(s, d).withColumn("day", F.to_date("time")), ["poly_id", "day"])


query(
    "field_time_stats",
    f"SELECT poly_id, strftime(day, '%Y-%m-%d') AS day, fc_mean, fc_std, n_pix FROM ({FTS})", "fc_mean fc_std",
)(lambda s, d: field_stats(s, d).withColumn("day", F.date_format("day", "yyyy-MM-dd")))


def series(s, d):
    ei = t.ei_grid(s, d).groupBy("doy").agg(F.avg("ei").alias("ei"))
    st = field_stats(s, d).withColumn("doy", tp.doy365(F.col("day"))).join(ei, "doy", "left")
    return cf.cfactor_timeseries(st)


SERIES = {
    "fts": FTS,
    "cser": """SELECT poly_id, day, fc_mean, e.ei, exp(-0.033 * fc_mean) AS slr, exp(-0.033 * fc_mean) * e.ei AS slr_ei
        FROM fts LEFT JOIN (SELECT doy, avg(ei) AS ei FROM ei_grid GROUP BY 1) e ON least(dayofyear(day), 365) = e.doy""",
}
query(
    "cfactor_timeseries", "SELECT poly_id, strftime(day, '%Y-%m-%d') AS day, fc_mean, ei, slr, slr_ei FROM cser",
    "fc_mean ei slr slr_ei", tables=SERIES, digits=9,
)(lambda s, d: series(s, d).select("poly_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "fc_mean", "ei", "slr", "slr_ei"))
query(
    "annual_cfactor",
    """SELECT poly_id, CAST(year(day) AS INT) AS yr, CASE WHEN sum(ei) > 0 THEN sum(slr_ei) / sum(ei) END AS C_annual,
       count(*) AS n_times FROM cser WHERE slr_ei IS NOT NULL GROUP BY 1, 2""",
    "C_annual", tables=SERIES,
)(lambda s, d: cf.annual_cfactor(series(s, d).withColumn("yr", F.year("day")), ["poly_id", "yr"]))

query(
    "normalize_fractions",
    """SELECT poly_id, yr, count(pv) AS n, sum(pv) AS pv, sum(npv) AS npv, sum(soil) AS soil FROM fc_norm GROUP BY 1, 2""",
    "pv npv soil",
)(
    lambda s, d: cover.normalize_fractions(t.fc_raw(s, d), ["pv", "npv", "soil"], "")
    .groupBy("poly_id", "yr").agg(F.count("pv").alias("n"), *[F.sum(c).alias(c) for c in ("pv", "npv", "soil")])
)
query(
    "normalize_fractions_unit",
    """SELECT poly_id, "time"::DATE::VARCHAR AS day, x, y, CASE WHEN t > 0 THEN p / t ELSE 0 END AS pv,
       CASE WHEN t > 0 THEN n / t ELSE 0 END AS npv, CASE WHEN t > 0 THEN s / t ELSE 0 END AS soil
       FROM (SELECT *, p + n + s AS t FROM (SELECT poly_id, "time", x, y, least(greatest(pv, 0), 1) AS p,
       least(greatest(npv, 0), 1) AS n, least(greatest(soil, 0), 1) AS s FROM fc_raw))""",
    "x y pv npv soil", digits=9,
)(
    lambda s, d: cover.normalize_fractions(t.fc_raw(s, d), ["pv", "npv", "soil"], "", upper=1.0, zero_sum=0.0)
    .select("poly_id", tp.iso_date(F.col("time")).alias("day"), "x", "y", "pv", "npv", "soil")
)
query(
    "dedupe_mean",
    """SELECT poly_id, x, y, "time"::DATE::VARCHAR AS day, pv, npv, soil FROM fc_pixel""", "x y pv npv soil", digits=9,
)(lambda s, d: t.fc_pixel(s, d).select("poly_id", "x", "y", tp.iso_date(F.col("time")).alias("day"), "pv", "npv", "soil"))

query(
    "agronomic_year",
    """SELECT poly_id, yr, x, y, "time"::DATE::VARCHAR AS day, (pv + npv) * 100 AS fc_total FROM fc_norm
       WHERE "time"::DATE BETWEEN make_date(yr - 1, 7, 1) AND make_date(yr, 6, 30)""",
    "x y fc_total",
)(
    lambda s, d: cf.agronomic_year(cover.normalize_fractions(t.fc_raw(s, d), ["pv", "npv", "soil"], ""))
    .select("poly_id", "yr", "x", "y", tp.iso_date(F.col("time")).alias("day"), "fc_total")
)

RISK = {"pc": "SELECT poly_id, avg(C) AS C_new FROM pixel_c GROUP BY 1"}


def risk(s, d):
    pc = cf.parcel_cfactor(pixel_c(s, d), ["poly_id"]).select("poly_id", "C_new")
    j = t.parcel(s, d).join(pc, "poly_id").withColumns({"C_old": F.col("lnf_code") / 50, "C_mgmt": F.col("lnf_code") / 60})
    return cf.erosion_risk(j, {"new": "C_new", "old_total": "C_old", "old_mgmt": "C_mgmt"}, "er_pot", "p_factor")


query(
    "erosion_risk",
    """SELECT poly_id, C_new * er_pot * p_factor AS ers_risk_new, lnf_code / 50 * er_pot * p_factor AS ers_risk_old_total,
       lnf_code / 60 * er_pot * p_factor AS ers_risk_old_mgmt FROM parcel JOIN pc USING (poly_id)""",
    "ers_risk_new ers_risk_old_total ers_risk_old_mgmt", tables=RISK,
)(lambda s, d: risk(s, d).select("poly_id", "ers_risk_new", "ers_risk_old_total", "ers_risk_old_mgmt"))


def ref_area(s, d):
    lab = t.lnf_label(s, d).select("lnf_code", (F.col("2022_Area_m23") / 1e4).alias("area_ha"))
    return lab.withColumn("C_ref", (F.col("lnf_code") % 10 + 1) / 50)


REF = {
    "ref_area": """SELECT lnf_code, "2022_Area_m23" / 1e4 AS area_ha, (lnf_code % 10 + 1) / 50 AS C_ref FROM lnf_label""",
    "ref_w": """SELECT lnf_code, C_ref, greatest(coalesce(area_ha, 0), 0) AS w0,
        CASE WHEN sum(greatest(coalesce(area_ha, 0), 0)) OVER () > 0
        THEN greatest(coalesce(area_ha, 0), 0) / sum(greatest(coalesce(area_ha, 0), 0)) OVER ()
        ELSE 1.0 / count(*) OVER () END AS weight FROM ref_area""",
    "betas": f"SELECT 1e-4::DOUBLE + (0.1::DOUBLE - 1e-4::DOUBLE) * i / 59 AS beta FROM range(60) r(i)",
    "bpx": """SELECT lnf_code, yr, poly_id, x, y, beta, sum(exp(-beta * fc_total) * ei) / sum(ei) AS C
        FROM fc_ei, betas WHERE fc_total IS NOT NULL AND ei IS NOT NULL GROUP BY ALL HAVING sum(ei) > 0""",
    "bcrop": "SELECT lnf_code, beta, avg(C) AS C_predicted FROM bpx GROUP BY 1, 2",
    "bsens": """SELECT lnf_code, beta, C_predicted, C_ref, abs(C_predicted - C_ref) AS abs_error, weight
        FROM bcrop JOIN ref_w USING (lnf_code)""",
    "bloss": """SELECT beta, CASE WHEN sum(weight) > 0 THEN sum(weight * abs_error) / sum(weight) ELSE avg(abs_error) END AS mae,
        avg(abs_error) AS mae_equal FROM bsens GROUP BY 1""",
}
query("area_weights", "SELECT lnf_code, weight FROM ref_w", "weight", tables=REF)(
    lambda s, d: cf.area_weights(ref_area(s, d)).select("lnf_code", "weight")
)
query("beta_sensitivity", "SELECT * FROM bsens", "beta C_predicted C_ref abs_error weight", tables=REF)(
    lambda s, d: cf.beta_sensitivity(fc_ei(s, d), ref_area(s, d), PIXEL, BETAS)
)

def calibrated(s, d):
    best, table = cf.calibrate_beta(fc_ei(s, d), ref_area(s, d), PIXEL, points=12, rounds=3)
    return table.where(F.col("beta") == best)


def shrinking(rounds: int, points: int) -> dict[str, str]:
    """Loss on a grid of exponents, then on grids around the best of the one before."""
    out, lo, hi = {}, "1e-4::DOUBLE", "0.1::DOUBLE"
    for r in range(rounds):
        out[f"grid{r}"] = f"SELECT {lo} + ({hi} - {lo}) * i / {points - 1} AS beta FROM range({points}) t(i)"
        out[f"gpx{r}"] = f"""SELECT lnf_code, yr, poly_id, x, y, beta, sum(exp(-beta * fc_total) * ei) / sum(ei) AS C
            FROM fc_ei, grid{r} WHERE fc_total IS NOT NULL AND ei IS NOT NULL GROUP BY ALL HAVING sum(ei) > 0"""
        out[f"gerr{r}"] = f"""SELECT beta, abs(C - C_ref) AS e, weight FROM (SELECT lnf_code, beta, avg(C) AS C FROM gpx{r} GROUP BY 1, 2) JOIN ref_w USING (lnf_code)"""
        out[f"loss{r}"] = f"""SELECT beta, CASE WHEN sum(weight) > 0 THEN sum(weight * e) / sum(weight) ELSE avg(e) END AS mae, avg(e) AS mae_equal FROM gerr{r} GROUP BY 1"""
        step = f"(({hi} - {lo}) / {points - 1})"
        best = f"(SELECT min_by(beta, (mae, beta)) FROM loss{r})"
        lo, hi = f"greatest(1e-4::DOUBLE, {best} - {step})", f"least(0.1::DOUBLE, {best} + {step})"
    return out


query(
    "calibrate_beta", "SELECT * FROM loss2 ORDER BY mae, beta LIMIT 1", "beta mae mae_equal", tables={**REF, **shrinking(3, 12)},
)(calibrated)
