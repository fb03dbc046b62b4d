"""Gap filling, smoothing, spikes and filters on cover series."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.registry import query
from terrafold.operators import cover, series

KEYS = ["poly_id", "yr"]
V = ["pv", "npv", "soil"]


def norm(s, d):
    return cover.normalize_fractions(t.fc_raw(s, d), V, "")


def daily(s, d):
    return series.daily_series(norm(s, d), KEYS, "time", V)


def text_day(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols or ("day",)})


DAILY = {
    "ds": """SELECT poly_id, yr, CAST("time" AS DATE) AS day, avg(pv) AS pv, avg(npv) AS npv, avg(soil) AS soil FROM fc_norm
        WHERE pv IS NOT NULL GROUP BY 1, 2, 3""",
    "dl": """SELECT *, lead(day) OVER w AS nday, lead(pv) OVER w AS npv1, lead(npv) OVER w AS nnpv, lead(soil) OVER w AS nsoil,
        lag(pv) OVER w AS ppv, row_number() OVER w AS rn, count(*) OVER (PARTITION BY poly_id, yr) AS n FROM ds WINDOW w AS (PARTITION BY poly_id, yr ORDER BY day)""",
    "fills": "SELECT *, unnest(generate_series(day + INTERVAL 6 DAY, nday - INTERVAL 1 DAY, INTERVAL 6 DAY))::DATE AS fday FROM dl WHERE nday - day > 6",
}
query("daily_series", "SELECT poly_id, yr, day::VARCHAR AS day, pv, npv, soil FROM ds", "pv npv soil", tables=DAILY, digits=9)(lambda s, d: text_day(daily(s, d)))
query("fill_dates", "SELECT poly_id, yr, fday::VARCHAR AS day FROM fills", tables=DAILY)(lambda s, d: text_day(series.fill_dates(daily(s, d), KEYS, 6)))
query(
    "gapfill_linear",
    """SELECT poly_id, yr, day::VARCHAR AS day, pv, npv, soil, 0 AS is_gapfilled FROM ds UNION ALL
       SELECT poly_id, yr, fday::VARCHAR, p / (p + n + s), n / (p + n + s), s / (p + n + s), 1 FROM
       (SELECT poly_id, yr, fday, pv + (npv1 - pv) * f AS p, npv + (nnpv - npv) * f AS n, soil + (nsoil - soil) * f AS s FROM
        (SELECT *, (fday - day) / (nday - day) AS f FROM fills))""",
    "pv npv soil", tables=DAILY, digits=9,
)(lambda s, d: text_day(series.gapfill_linear(daily(s, d), KEYS, V, 6)))
query(
    "nearest_date",
    """SELECT o.k, o.day::VARCHAR AS day, max(l.day) FILTER (l.day <= o.day)::VARCHAR AS before, min(l.day) FILTER (l.day >= o.day)::VARCHAR AS after
       FROM (SELECT DISTINCT o_custkey % 100 AS k, o_orderdate::DATE AS day FROM orders) o
       LEFT JOIN (SELECT DISTINCT l_suppkey % 100 AS k, l_shipdate::DATE AS day FROM lineitem) l ON l.k = o.k GROUP BY 1, 2""",
)(
    lambda s, d: text_day(series.nearest_date(
        t.table(s, d, "orders").select(F.pmod("o_custkey", F.lit(100)).alias("k"), F.to_date("o_orderdate").alias("day")),
        t.table(s, d, "lineitem").select(F.pmod("l_suppkey", F.lit(100)).alias("k"), F.to_date("l_shipdate").alias("day")), ["k"],
    ), "day", "before", "after")
)
DESP = {
    **DAILY,
    "cand": """SELECT poly_id, yr, day, rn, coalesce(ppv <> 0 AND pv <> 0 AND nday - day <= 5 AND
        (((pv - ppv) / ppv > 0.1 AND (pv - npv1) / pv > 0.1) OR ((ppv - pv) / ppv > 0.1 AND (npv1 - pv) / pv > 0.1)), FALSE) AS c
        FROM (SELECT * REPLACE (CASE WHEN pv = 0 THEN NULL ELSE pv END AS pv, CASE WHEN ppv = 0 THEN NULL ELSE ppv END AS ppv) FROM dl)""",
    "fold": """SELECT poly_id, yr, day, rn, c, FALSE AS removed FROM cand WHERE rn = 1 UNION ALL
        SELECT c.poly_id, c.yr, c.day, c.rn, c.c, c.c AND NOT f.removed FROM fold f JOIN cand c ON c.poly_id = f.poly_id AND c.yr = f.yr AND c.rn = f.rn + 1""",
}
query("despike", "SELECT poly_id, yr, day::VARCHAR AS day, CAST(removed AS INT) AS removed FROM fold", tables=DESP)(
    lambda s, d: text_day(series.despike(daily(s, d), KEYS, "pv").select(*KEYS, "day", "removed"))
)
query(
    "despike_zscore",
    """SELECT poly_id, yr, day::VARCHAR AS day, z, CASE WHEN abs(z) > 1.5 AND rn > 1 AND nday - day <= 5 AND abs(lead(z) OVER w) < 1.5 THEN 1 ELSE 0 END AS removed
       FROM (SELECT *, CASE WHEN count(pv) OVER c = 10 THEN (pv - avg(pv) OVER c) / nullif(stddev_pop(pv) OVER c, 0) END AS z FROM dl
         WINDOW c AS (PARTITION BY poly_id, yr ORDER BY day ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
       WINDOW w AS (PARTITION BY poly_id, yr ORDER BY day)""",
    "z", tables=DAILY,
)(lambda s, d: text_day(series.despike_zscore(daily(s, d), KEYS, "pv", z_max=1.5).select(*KEYS, "day", "z", "removed")))


REACH = range(-6, 7)


def sg_sql() -> str:
    """Weights by offset to the row, for each window length and place in the window."""
    rows = []
    for k in (5, 7):
        for p, r in enumerate(series.savgol_weights(k, 2)):
            rows.append(f"({k}, {p}, " + ", ".join(f"{r[o + p] if 0 <= o + p < k else 0.0!r}::DOUBLE" for o in REACH) + ")")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) m(k, p, " + ", ".join(f"w{o + 6}" for o in REACH) + ")"


def sg_sum(v: str) -> str:
    return " + ".join(f"w{o + 6} * coalesce(lead({v}, {o}) OVER w, 0)" for o in REACH)


SG = {
    **DAILY,
    "sgw": sg_sql(),
    "sgp": """SELECT *, CAST(rn - 1 - greatest(0, least(rn - 1 - k // 2, n - k)) AS INT) AS p FROM (SELECT *, CASE WHEN n < 7 THEN 5 ELSE 7 END AS k FROM dl)""",
    "sgs": f"""SELECT poly_id, yr, day, {", ".join(f"CASE WHEN n < 5 THEN {v} ELSE {sg_sum(v)} END AS {v}" for v in V)}
        FROM sgp LEFT JOIN sgw ON sgw.k = sgp.k AND sgw.p = sgp.p WINDOW w AS (PARTITION BY poly_id, yr ORDER BY day)""",
}
query(
    "savgol",
    """SELECT poly_id, yr, day::VARCHAR AS day, pv / (pv + npv + soil) AS pv, npv / (pv + npv + soil) AS npv, soil / (pv + npv + soil) AS soil FROM sgs""",
    "pv npv soil", tables=SG,
)(lambda s, d: text_day(series.savgol(daily(s, d), KEYS, V)))
LO = {
    **DAILY,
    "pairs": "SELECT a.poly_id, a.yr, a.day, a.n, abs(a.day - b.day) AS dist, CAST(b.day - DATE '1990-01-01' AS DOUBLE) AS x, CAST(a.day - DATE '1990-01-01' AS DOUBLE) AS x0, b.pv, b.npv, b.soil, a.pv AS pv0, a.npv AS npv0, a.soil AS soil0 FROM dl a JOIN dl b ON a.poly_id = b.poly_id AND a.yr = b.yr",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY poly_id, yr, day ORDER BY dist) AS r FROM pairs",
    "bw": "SELECT *, max(CASE WHEN r = CAST(floor(0.3::DOUBLE * n + 1e-10) AS BIGINT) THEN dist END) OVER (PARTITION BY poly_id, yr, day) AS h FROM ranked",
    "wt": "SELECT *, CASE WHEN h > 0 AND dist < h THEN (1 - (dist / h) ** 3) ** 3 ELSE 0 END AS w FROM bw",
    "fitm": """SELECT poly_id, yr, day, any_value(n) AS n, any_value(x0) AS x0, any_value(pv0) AS pv0, any_value(npv0) AS npv0, any_value(soil0) AS soil0, sum(w) AS sw,
        sum(w * (x - x0)) / nullif(sum(w), 0) AS mx, sum(w * pv) / nullif(sum(w), 0) AS mp, sum(w * npv) / nullif(sum(w), 0) AS mn, sum(w * soil) / nullif(sum(w), 0) AS ms,
        sum(w * (x - x0) * (x - x0)) AS sxx, sum(w * (x - x0) * pv) AS sp, sum(w * (x - x0) * npv) AS sn, sum(w * (x - x0) * soil) AS ss FROM wt GROUP BY 1, 2, 3""",
    "fitv": """SELECT *, sxx - sw * mx * mx AS vx FROM fitm""",
    "fito": """SELECT poly_id, yr, day, CASE WHEN coalesce(sw, 0) > 0 THEN mp - mx * CASE WHEN vx > 1e-9 THEN (sp - sw * mx * mp) / vx ELSE 0 END ELSE pv0 END AS pv,
        CASE WHEN coalesce(sw, 0) > 0 THEN mn - mx * CASE WHEN vx > 1e-9 THEN (sn - sw * mx * mn) / vx ELSE 0 END ELSE npv0 END AS npv,
        CASE WHEN coalesce(sw, 0) > 0 THEN ms - mx * CASE WHEN vx > 1e-9 THEN (ss - sw * mx * ms) / vx ELSE 0 END ELSE soil0 END AS soil FROM fitv""",
}
query(
    "loess",
    """SELECT poly_id, yr, day::VARCHAR AS day, pv / (pv + npv + soil) AS pv, npv / (pv + npv + soil) AS npv, soil / (pv + npv + soil) AS soil FROM fito""",
    "pv npv soil", tables=LO,
)(lambda s, d: text_day(series.loess(daily(s, d), KEYS, V)))
LINE = "CASE WHEN sw > 0 THEN s{v} / sw - mx * CASE WHEN vx > 1e-9 THEN (x{v} - mx * s{v}) / vx ELSE 0 END WHEN k < 2 AND own > 0 THEN {v}0 END"
LB = {
    **LO,
    # a byte of a digest for each draw says how often it counts a day
    "dg": """SELECT poly_id, yr, day, 16 * g + i AS draw, (b >= 94)::INT + (b >= 188)::INT + (b >= 235)::INT + (b >= 251)::INT + (b >= 255)::INT AS m FROM
        (SELECT *, ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::INT AS b FROM (SELECT poly_id, yr, day, g, md5('42|' || poly_id || '|' || yr || '|' || (day - DATE '1970-01-01') || '|' || g) AS h
         FROM ds, range(3) r(g)), range(16) t(i))""",
    "near": """SELECT poly_id, yr, day, x0, x - x0 AS dx, DATE '1990-01-01' + CAST(x AS INT) AS nday, CAST(floor(0.3::DOUBLE * n + 1e-10) AS BIGINT) AS k, w, pv, npv, soil, pv0, npv0, soil0
        FROM wt WHERE w > 0 OR dist = 0""",
    "lsum": """SELECT n.poly_id, n.yr, n.day, g.draw, any_value(k) AS k, sum(w * m) AS sw, sum(CASE WHEN dx = 0 THEN m END) AS own, sum(w * m * dx) AS sx, sum(w * m * dx * dx) AS sxx,
        sum(w * m * pv) AS spv, sum(w * m * npv) AS snpv, sum(w * m * soil) AS ssoil, sum(w * m * dx * pv) AS xpv, sum(w * m * dx * npv) AS xnpv, sum(w * m * dx * soil) AS xsoil,
        any_value(pv0) AS pv0, any_value(npv0) AS npv0, any_value(soil0) AS soil0
        FROM near n JOIN dg g ON g.poly_id = n.poly_id AND g.yr = n.yr AND g.day = n.nday GROUP BY 1, 2, 3, 4""",
    "lfit": f"""SELECT poly_id, yr, day, {", ".join(LINE.format(v=v) + f" AS {v}" for v in V)} FROM
        (SELECT *, sx / nullif(sw, 0) AS mx, sxx - sx * sx / nullif(sw, 0) AS vx FROM lsum)""",
    "lone": f"""SELECT poly_id, yr, day, {", ".join(f"{v} / nullif(pv + npv + soil, 0) AS {v}" for v in V)} FROM lfit""",
}
query(
    "loess_band",
    f"""SELECT poly_id, yr, day::VARCHAR AS day, {", ".join(f"avg({v}) AS {v}_mean, quantile_cont({v}, 0.05) AS {v}_q05, quantile_cont({v}, 0.95) AS {v}_q95" for v in V)}
       FROM lone GROUP BY 1, 2, 3""",
    " ".join(f"{v}_{q}" for v in V for q in ("mean", "q05", "q95")), tables=LB,
)(lambda s, d: text_day(series.loess_band(daily(s, d), KEYS, V)))


def with_sd(s, d):
    x = daily(s, d)
    sd = lambda k: 0.02 + F.pmod(F.dayofyear("day") * k, F.lit(7)) / 100
    return x.withColumns({"pv_sd": sd(1), "npv_sd": sd(3), "soil_sd": sd(5)})


def at(s, d):
    return series.fill_dates(daily(s, d), KEYS, 6)


def interpolated(smooth: str) -> str:
    """A smoothed table at the fill days, all of which lie between two of its days."""
    share = "CAST(f.fday - p.day AS DOUBLE) / (n.day - p.day)"
    value = lambda v: f"p.{v} / p.t + {share} * (n.{v} / n.t - p.{v} / p.t)"
    src = f"(SELECT *, pv + npv + soil AS t FROM {smooth})"
    return f"""SELECT poly_id, yr, day::VARCHAR AS day, pv / (pv + npv + soil) AS pv, npv / (pv + npv + soil) AS npv, soil / (pv + npv + soil) AS soil FROM
        (SELECT f.poly_id, f.yr, f.fday AS day, {", ".join(f"{value(v)} AS {v}" for v in V)} FROM fills f
         ASOF JOIN {src} p ON p.poly_id = f.poly_id AND p.yr = f.yr AND p.day <= f.fday
         ASOF JOIN {src} n ON n.poly_id = f.poly_id AND n.yr = f.yr AND n.day >= f.fday)"""


query(
    "savgol_at_dates", interpolated("sgs"), "pv npv soil", tables=SG,
)(lambda s, d: text_day(series.interpolate_at(series.savgol(daily(s, d), KEYS, V), KEYS, V, at(s, d))))
query(
    "loess_at_dates", interpolated("fito"), "pv npv soil", tables=LO,
)(lambda s, d: text_day(series.interpolate_at(series.loess(daily(s, d), KEYS, V), KEYS, V, at(s, d))))


def kal(v: str, k: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY poly_id, yr ORDER BY day) AS rn, day - lag(day) OVER (PARTITION BY poly_id, yr ORDER BY day) AS gap,
        first_value(y) OVER (PARTITION BY poly_id, yr ORDER BY day) AS y0 FROM
        (SELECT poly_id, yr, day, {v} AS y, (0.02::DOUBLE + (dayofyear(day) * {k} % 7) / 100) ** 2 AS r FROM ds UNION ALL SELECT poly_id, yr, fday, NULL, NULL FROM fills)"""


RW = {
    **DAILY, "kobs": kal("pv", 1),
    "kr": """SELECT poly_id, yr, rn, day, CASE WHEN y IS NULL THEN y0 ELSE y0 + (1 + 1e-5) / (1 + 1e-5 + r) * (y - y0) END AS x,
        CASE WHEN y IS NULL THEN 1 + 1e-5 ELSE (1 - (1 + 1e-5) / (1 + 1e-5 + r)) * (1 + 1e-5) END AS p FROM kobs WHERE rn = 1 UNION ALL
        SELECT o.poly_id, o.yr, o.rn, o.day, CASE WHEN y IS NULL THEN x ELSE x + (p + 1e-5 * gap) / (p + 1e-5 * gap + r) * (y - x) END,
        CASE WHEN y IS NULL THEN p + 1e-5 * gap ELSE (1 - (p + 1e-5 * gap) / (p + 1e-5 * gap + r)) * (p + 1e-5 * gap) END
        FROM kr JOIN kobs o ON o.poly_id = kr.poly_id AND o.yr = kr.yr AND o.rn = kr.rn + 1""",
}
query("kalman_rw", "SELECT poly_id, yr, day::VARCHAR AS day, x AS level, sqrt(p) AS level_sd FROM kr", "level level_sd", tables=RW)(
    lambda s, d: text_day(series.kalman_rw(with_sd(s, d), KEYS, "pv", "pv_sd", at(s, d)))
)


def llt(v: str, k: int, tag: str) -> dict[str, str]:
    """Day-by-day recursion: predict once per calendar day, update where observed."""
    q = "1e-6"
    step = f"""l + b AS pl, b AS pb, p00 + 2 * p01 + p11 + {q} AS q00, p01 + p11 AS q01, p11 + {q} AS q11"""
    upd = """CASE WHEN y IS NULL THEN pl ELSE pl + q00 / (q00 + r) * (y - pl) END AS l, CASE WHEN y IS NULL THEN pb ELSE pb + q01 / (q00 + r) * (y - pl) END AS b,
        CASE WHEN y IS NULL THEN q00 ELSE (1 - q00 / (q00 + r)) * q00 END AS p00, CASE WHEN y IS NULL THEN q01 ELSE (1 - q00 / (q00 + r)) * q01 END AS p01,
        CASE WHEN y IS NULL THEN q11 ELSE q11 - q01 / (q00 + r) * q01 END AS p11"""
    return {
        f"o{tag}": f"""SELECT poly_id, yr, day, {v} AS y, (0.02::DOUBLE + (dayofyear(day) * {k} % 7) / 100) ** 2 AS r FROM ds""",
        f"x{tag}": f"""SELECT a.poly_id, a.yr, a.day, o.y, o.r, row_number() OVER (PARTITION BY a.poly_id, a.yr ORDER BY a.day) AS rn FROM
            (SELECT poly_id, yr, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM ds GROUP BY 1, 2) a
            LEFT JOIN o{tag} o ON o.poly_id = a.poly_id AND o.yr = a.yr AND o.day = a.day""",
        f"k{tag}": f"""SELECT poly_id, yr, CAST(0 AS BIGINT) AS rn, min(day) AS day, min_by(y, day) FILTER (y IS NOT NULL) AS l, 0.0::DOUBLE AS b, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11
            FROM x{tag} GROUP BY 1, 2 UNION ALL SELECT poly_id, yr, rn, day, {upd} FROM (SELECT x.poly_id, x.yr, x.rn, x.day, x.y, x.r, {step}
            FROM k{tag} k JOIN x{tag} x ON x.poly_id = k.poly_id AND x.yr = k.yr AND x.rn = k.rn + 1)""",
        f"f{tag}": f"SELECT poly_id, yr, day, l, b, sqrt(p00) AS sd FROM k{tag} k WHERE rn > 0 AND (EXISTS (SELECT 1 FROM ds WHERE ds.poly_id = k.poly_id AND ds.yr = k.yr AND ds.day = k.day) OR EXISTS (SELECT 1 FROM fills f WHERE f.poly_id = k.poly_id AND f.yr = k.yr AND f.fday = k.day))",
    }


query("kalman_llt", "SELECT poly_id, yr, day::VARCHAR AS day, l AS level, b AS trend, sd AS level_sd FROM f1", "level trend level_sd",
      tables={**DAILY, **llt("pv", 1, "1")})(lambda s, d: text_day(series.kalman_llt(with_sd(s, d), KEYS, "pv", "pv_sd", at(s, d))))
LLT3 = {**DAILY, **llt("pv", 1, "1"), **llt("npv", 3, "2"), **llt("soil", 5, "3")}
query(
    "kalman_fractions",
    """SELECT poly_id, yr, day::VARCHAR AS day, p / (p + n + s) AS pv, n / (p + n + s) AS npv, s / (p + n + s) AS soil, a AS pv_sd, b AS npv_sd, c AS soil_sd FROM
       (SELECT f1.poly_id, f1.yr, f1.day, least(greatest(f1.l, 0), 1) AS p, least(greatest(f2.l, 0), 1) AS n, least(greatest(f3.l, 0), 1) AS s, f1.sd AS a, f2.sd AS b, f3.sd AS c
        FROM f1 JOIN f2 ON f1.poly_id = f2.poly_id AND f1.yr = f2.yr AND f1.day = f2.day JOIN f3 ON f1.poly_id = f3.poly_id AND f1.yr = f3.yr AND f1.day = f3.day)""",
    "pv npv soil pv_sd npv_sd soil_sd", tables=LLT3,
)(lambda s, d: text_day(series.kalman_fractions(with_sd(s, d), KEYS, V, ["pv_sd", "npv_sd", "soil_sd"], at(s, d))))
query(
    "combine_uncertainty",
    """SELECT kr.poly_id, kr.yr, kr.day::VARCHAR AS day, x AS level, sqrt(p) AS level_sd, sqrt(p + coalesce(r, 0)) AS total_sd FROM kr
       LEFT JOIN kobs o ON o.poly_id = kr.poly_id AND o.yr = kr.yr AND o.day = kr.day""",
    "level level_sd total_sd", tables=RW,
)(
    lambda s, d: text_day(series.combine_uncertainty(
        series.kalman_rw(with_sd(s, d), KEYS, "pv", "pv_sd", at(s, d)), with_sd(s, d), KEYS, "level_sd", "pv_sd", "total_sd"
    ))
)


def alr_round(s, d):
    a, b = series.alr(F.col("pv"), F.col("npv"), F.col("soil"))
    x = daily(s, d).withColumns({"alr_pv": a, "alr_npv": b})
    p, n, so = series.alr_inverse(F.col("alr_pv"), F.col("alr_npv"))
    return text_day(x.select(*KEYS, "day", "alr_pv", "alr_npv", p.alias("pv_back"), n.alias("npv_back"), so.alias("soil_back")))


CL = "least(greatest({v}, 1e-6), 1 - 1e-6)"
query(
    "alr",
    f"""SELECT poly_id, yr, day::VARCHAR AS day, a AS alr_pv, b AS alr_npv, exp(a) / (1 + exp(a) + exp(b)) AS pv_back, exp(b) / (1 + exp(a) + exp(b)) AS npv_back,
        1 / (1 + exp(a) + exp(b)) AS soil_back FROM (SELECT *, ln({CL.format(v='pv')} / {CL.format(v='soil')}) AS a, ln({CL.format(v='npv')} / {CL.format(v='soil')}) AS b FROM ds)""",
    "alr_pv alr_npv pv_back npv_back soil_back", tables=DAILY, digits=9,
)(alr_round)
query(
    "season_phase",
    """SELECT poly_id, yr, day::VARCHAR AS day, CAST(t AS INT) AS t, t / 365 AS t_years, sin(2 * pi() * (t % 365) / 365) AS t_sin, cos(2 * pi() * (t % 365) / 365) AS t_cos
       FROM (SELECT *, day - min(day) OVER (PARTITION BY poly_id, yr) AS t FROM ds)""",
    "t_years t_sin t_cos", tables=DAILY,
)(lambda s, d: text_day(series.season_phase(daily(s, d), KEYS).drop(*V)))


def weeks(s, d):
    y = t.table(s, d, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct()
    m = series.periods(y, "yr", "month").withColumn("freq", F.lit("month"))
    return text_day(m.unionByName(series.periods(y, "yr", "week").withColumn("freq", F.lit("week"))), "start", "end")


query(
    "periods",
    """WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS yr FROM lineitem),
       p AS (SELECT yr, 'month' AS freq, m::DATE AS s, last_day(m::DATE) AS e FROM (SELECT yr, unnest(generate_series(make_date(yr, 1, 1), make_date(yr, 12, 31), INTERVAL 1 MONTH)) AS m FROM y)
         UNION ALL SELECT yr, 'week', w::DATE, w::DATE + 6 FROM (SELECT yr, unnest(generate_series(date_trunc('week', make_date(yr, 1, 1)), make_date(yr, 12, 31), INTERVAL 7 DAY)) AS w FROM y))
       SELECT yr, freq, CAST(row_number() OVER (PARTITION BY yr, freq ORDER BY s) AS INT) AS idx, greatest(s, make_date(yr, 1, 1))::VARCHAR AS start,
       least(e, make_date(yr, 12, 31))::VARCHAR AS "end" FROM p""",
)(weeks)
query(
    "lagged_features",
    """WITH w AS (SELECT cell, CAST(floor((date_trunc('week', day)::DATE - DATE '1970-01-05') / 7) AS BIGINT) AS week, avg(prec) AS prec FROM grid_daily GROUP BY 1, 2)
       SELECT a.cell, a.week, a.prec, max(CASE WHEN b.week = a.week - 1 THEN b.prec END) AS lag_1, max(CASE WHEN b.week = a.week - 4 THEN b.prec END) AS lag_4,
       max(CASE WHEN b.week = a.week - 12 THEN b.prec END) AS lag_12, avg(CASE WHEN b.week > a.week - 4 THEN b.prec END) AS mean_4,
       avg(CASE WHEN b.week > a.week - 12 THEN b.prec END) AS mean_12
       FROM w a JOIN w b ON b.cell = a.cell AND b.week BETWEEN a.week - 12 AND a.week GROUP BY 1, 2, 3""",
    "prec lag_1 lag_4 lag_12 mean_4 mean_12",
)(lambda s, d: series.lagged_features(t.grid_daily(s, d), ["cell"], "prec"))
