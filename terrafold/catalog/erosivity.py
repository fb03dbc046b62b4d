"""Rain series, events and erosivity climatology."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.registry import query
from terrafold.functions import timeparts as tp
from terrafold.operators import rain


def _sql(src: str) -> dict[str, str]:
    """The row-level chain of a station series, in plain window SQL."""
    return {
        "axis": f"""SELECT a.station, a.minute, max(r.rain) AS rain FROM
            (SELECT station, unnest(range(min(minute), max(minute) + 10, 10)) AS minute FROM {src} GROUP BY station) a
            LEFT JOIN {src} r ON r.station = a.station AND r.minute = a.minute GROUP BY 1, 2""",
        "miss": """SELECT *, rain IS NULL AS m, lag(rain IS NULL) OVER w AS pm FROM axis
            WINDOW w AS (PARTITION BY station ORDER BY minute)""",
        "missrun": """SELECT *, sum(CASE WHEN pm IS NULL OR pm <> m THEN 1 ELSE 0 END)
            OVER (PARTITION BY station ORDER BY minute) AS run FROM miss""",
        "gaps": """SELECT station, minute, greatest(coalesce(rain, 0), 0) AS rain, m,
            count(*) OVER (PARTITION BY station, run) * 10 AS run_minutes FROM missrun""",
        "gapped": """SELECT station, minute, rain, CASE WHEN m THEN run_minutes END AS gap_minutes,
            CASE WHEN m AND run_minutes > 30 AND run_minutes < 180 THEN 1 ELSE 0 END AS medium_gap,
            CASE WHEN m AND run_minutes >= 180 THEN 1 ELSE 0 END AS large_gap FROM gaps""",
        "dryflag": """SELECT *, rain = 0 AS dry, lag(rain = 0) OVER (PARTITION BY station ORDER BY minute) AS pd FROM gapped""",
        "dryrun": """SELECT *, sum(CASE WHEN pd IS NULL OR pd <> dry THEN 1 ELSE 0 END)
            OVER (PARTITION BY station ORDER BY minute) AS drun FROM dryflag""",
        "brk": """SELECT *, CASE WHEN (dry AND count(*) OVER (PARTITION BY station, drun) >= 36) OR medium_gap = 1
            OR large_gap = 1 THEN 1 ELSE 0 END AS event_break FROM dryrun""",
        "ev": """SELECT station, minute, rain, gap_minutes, medium_gap, large_gap, event_break,
            CAST(sum(event_break) OVER (PARTITION BY station ORDER BY minute) AS BIGINT) AS event_id FROM brk""",
        "peak": """SELECT *, 2 * sum(rain) OVER (PARTITION BY station, event_id ORDER BY minute ROWS 2 PRECEDING) AS I30,
            CASE WHEN rain >= 0.1 THEN 0.29 * (1 - 0.72 * exp(-0.05 * rain * 6)) * rain ELSE 0 END AS energy FROM ev""",
        "evstat": """SELECT station, event_id, min(CASE WHEN rain > 0 THEN minute END) AS start_min,
            max(CASE WHEN rain > 0 THEN minute END) AS end_min, sum(rain) AS total_precipitation, max(I30) AS I30,
            sum(energy) * max(I30) AS EI30 FROM peak GROUP BY 1, 2 HAVING sum(rain) >= 12.7""",
    }


GAPPY, DRY = _sql("rain_gappy"), _sql("rain_dry")


def axis(s, d):
    return rain.regularize(t.rain_gappy(s, d))


query("regularize", "SELECT station, minute, rain FROM axis", "rain", tables=GAPPY)(
    lambda s, d: axis(s, d).select("station", "minute", "rain")
)
query(
    "run_length",
    """SELECT station, minute, CAST(m AS INT) AS missing, count(*) OVER (PARTITION BY station, run) AS run_rows FROM missrun""",
    tables=GAPPY,
)(
    lambda s, d: rain.run_length(axis(s, d), F.col("rain").isNull(), "run_rows").select(
        "station", "minute", F.col("rain").isNull().cast("int").alias("missing"), "run_rows"
    )
)
query(
    "gap_policy",
    "SELECT station, minute, rain, CAST(coalesce(gap_minutes, 0) AS BIGINT) AS gap_minutes, medium_gap, large_gap FROM gapped",
    "rain", tables=GAPPY,
)(
    lambda s, d: rain.gap_policy(axis(s, d)).select(
        "station", "minute", "rain", F.coalesce("gap_minutes", F.lit(0)).alias("gap_minutes"), "medium_gap", "large_gap"
    )
)
query("rain_events", "SELECT station, minute, event_break, event_id FROM ev", tables=GAPPY)(
    lambda s, d: rain.rain_events(axis(s, d)).select("station", "minute", "event_break", "event_id")
)
query("i30", "SELECT station, minute, event_id, I30, energy FROM peak", "I30 energy", tables=GAPPY)(
    lambda s, d: rain.i30(rain.rain_events(axis(s, d))).select("station", "minute", "event_id", "I30", "energy")
)
EV = "SELECT station, event_id, start_min, end_min, total_precipitation, I30, EI30 FROM evstat"
query("event_stats", EV, "total_precipitation I30 EI30", digits=5, tables=GAPPY)(
    lambda s, d: rain.events_from_series(t.rain_gappy(s, d))
)
query("event_stats_dry_axis", EV, "total_precipitation I30 EI30", digits=5, tables=DRY)(
    lambda s, d: rain.events_from_series(t.rain_dry(s, d))
)
query(
    "coverage_stats",
    """SELECT station, min(minute) AS t_min, max(minute) AS t_max, count(*) AS n,
       avg(CASE WHEN rain IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share FROM rain_gappy GROUP BY 1""",
    "missing_share",
)(lambda s, d: rain.coverage_stats(t.rain_gappy(s, d)))

CLIM = {
    "evdays": """SELECT station, start_min, end_min, EI30, unnest(range(start_min // 1440, end_min // 1440 + 1)) AS d,
        start_min // 1440 AS d0, end_min // 1440 AS d1 FROM rain_event""",
    "eidaily": """SELECT station, DATE '1970-01-01' + CAST(d AS INT) AS day, sum(CASE WHEN d0 = d1 THEN EI30
        ELSE EI30 * (least(end_min, (d + 1) * 1440) - greatest(start_min, d * 1440)) / (end_min - start_min) END) AS EI_daily
        FROM evdays GROUP BY 1, 2""",
    "eitop": """SELECT *, least(dayofyear(day), 365) AS doy, row_number() OVER (PARTITION BY station ORDER BY EI_daily DESC, day) AS rn FROM eidaily""",
    "eibad": """SELECT DISTINCT station FROM eitop q WHERE rn <= 3 AND
        (SELECT sum(EI_daily) FROM eitop z WHERE z.station = q.station AND z.rn <= 3) >
        0.02 * (SELECT sum(EI_daily) FROM eitop z WHERE z.station = q.station) AND
        (SELECT count(DISTINCT year(day)) FROM eitop z WHERE z.station = q.station AND z.doy = q.doy) < 6""",
    "eiclim": """SELECT a.station, CAST(a.doy AS INT) AS doy, coalesce(b.s / a.n, 0) AS EI_daily_avg FROM
        (SELECT station, n, unnest(range(1, 366)) AS doy FROM
          (SELECT station, max(year(day)) - min(year(day)) + 1 AS n FROM eidaily GROUP BY 1)) a
        LEFT JOIN (SELECT station, least(dayofyear(day), 365) AS doy, sum(EI_daily) AS s FROM eidaily GROUP BY 1, 2) b
        ON a.station = b.station AND a.doy = b.doy""",
    "eipct": """SELECT station, doy, EI_daily_avg, CASE WHEN sum(EI_daily_avg) OVER (PARTITION BY station) = 0 THEN 0
        ELSE EI_daily_avg / sum(EI_daily_avg) OVER (PARTITION BY station) * 100 END AS EI_daily_percent FROM eiclim""",
    "eicum": """SELECT *, sum(EI_daily_percent) OVER (PARTITION BY station ORDER BY doy) AS EI_daily_cumsum FROM eipct""",
}


def daily(s, d):
    return rain.ei_daily(t.rain_event(s, d))


query("ei_daily", "SELECT station, day::VARCHAR AS day, EI_daily FROM eidaily", "EI_daily", tables=CLIM, digits=6)(
    lambda s, d: daily(s, d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
)
# thresholds tightened so that the stand-in stations fall on both sides
query(
    "station_screen", "SELECT station, day::VARCHAR AS day, EI_daily FROM eidaily WHERE station NOT IN (SELECT station FROM eibad)",
    "EI_daily", tables=CLIM, digits=6,
)(
    lambda s, d: rain.station_screen(daily(s, d), max_fraction=0.02, min_years=6)
    .withColumn("day", F.date_format("day", "yyyy-MM-dd"))
)
query("ei_climatology", "SELECT * FROM eiclim", "EI_daily_avg", tables=CLIM, digits=6)(lambda s, d: rain.ei_climatology(daily(s, d)))
query("cumulative_percent", "SELECT * FROM eicum", "EI_daily_avg EI_daily_percent EI_daily_cumsum", tables=CLIM, digits=6)(
    lambda s, d: rain.cumulative_percent(rain.ei_climatology(daily(s, d)), ["station"])
)
query(
    "cumulative_percent_from_percent",
    """SELECT station, doy, p AS EI_daily_percent, sum(p) OVER (PARTITION BY station ORDER BY doy) AS EI_daily_cumsum FROM
       (SELECT station, doy, coalesce(greatest(v, 0) / nullif(sum(greatest(v, 0)) OVER (PARTITION BY station), 0) * 100, 0) AS p
        FROM (SELECT station, doy, EI_daily_avg - 1000 AS v FROM station_curve))""",
    "EI_daily_percent EI_daily_cumsum",
)(
    lambda s, d: rain.renormalise_percent(
        t.station_curve(s, d).select("station", "doy", (F.col("EI_daily_avg") - 1000).alias("v")), ["station"], "v"
    ).drop("v")
)
query(
    "group_fraction",
    """SELECT cell, day::VARCHAR AS day, prec / nullif(sum(prec) OVER (PARTITION BY cell), 0) AS fraction FROM grid_daily""",
    "fraction",
)(
    lambda s, d: rain.group_fraction(t.grid_daily(s, d), ["cell"], "prec", "fraction")
    .select("cell", F.date_format("day", "yyyy-MM-dd").alias("day"), "fraction")
)
MONTH = "CAST(month(DATE '2021-01-01' + CAST(doy - 1 AS INT)) AS INT)"
query(
    "monthly_ei",
    f"""SELECT station, {MONTH} AS month, sum(EI_daily_avg) AS EI_month, min(predicted_EI_daily_avg) AS predicted_EI_daily_avg
        FROM station_curve GROUP BY 1, 2""",
    "EI_month predicted_EI_daily_avg", digits=4,
)(lambda s, d: rain.monthly_ei(t.station_curve(s, d), ["station"], attrs=["predicted_EI_daily_avg"]))
query(
    "monthly_spread",
    f"""SELECT month, avg(m) AS EI_mean, stddev_samp(m) AS EI_std, count(*) AS n FROM
        (SELECT station, {MONTH} AS month, sum(EI_daily_avg) AS m FROM station_curve GROUP BY 1, 2) GROUP BY 1""",
    "EI_mean EI_std", digits=8,
)(lambda s, d: rain.monthly_spread(rain.monthly_ei(t.station_curve(s, d), ["station"])))

LEAP = "(year(day) % 4 = 0 AND year(day) % 100 <> 0 OR year(day) % 400 = 0)"
DOYC = f"""SELECT cell, CAST(CASE WHEN {LEAP} AND dayofyear(day) > 60 THEN dayofyear(day) - 1 ELSE dayofyear(day) END AS INT) AS doy,
    avg(prec) AS prec FROM grid_daily WHERE NOT (month(day) = 2 AND day(day) = 29) GROUP BY 1, 2"""
query("doy_climatology", DOYC, "prec")(lambda s, d: rain.doy_climatology(t.grid_daily(s, d), ["cell"], "prec"))


def months(s, d):
    g = t.grid_daily(s, d)
    a = rain.month_climatology(g, ["cell"], "prec", "sum")
    for how in ("min", "max", "mean"):
        a = a.join(rain.month_climatology(g, ["cell"], "prec", how), ["cell", "month"])
    return a


query(
    "month_climatology",
    """SELECT cell, month, avg(s) AS monthly_sum, avg(lo) AS monthly_min, avg(hi) AS monthly_max, avg(m) AS monthly_mean FROM
       (SELECT cell, CAST(month(day) AS INT) AS month, year(day) AS y, sum(prec) s, min(prec) lo, max(prec) hi, avg(prec) m
        FROM grid_daily GROUP BY ALL) GROUP BY 1, 2""",
    "monthly_sum monthly_min monthly_max monthly_mean",
)(months)
query(
    "month_expand",
    f"""SELECT cell, m.month, CAST(dd.doy AS INT) AS doy, v AS monthly_sum FROM
       (SELECT cell, month, avg(s) AS v FROM (SELECT cell, CAST(month(day) AS INT) AS month, year(day) AS y, sum(prec) s
        FROM grid_daily GROUP BY ALL) GROUP BY 1, 2) m
       JOIN (SELECT doy, {MONTH} AS month FROM range(1, 366) r(doy)) dd ON dd.month = m.month""",
    "monthly_sum",
)(lambda s, d: rain.month_expand(rain.month_climatology(t.grid_daily(s, d), ["cell"], "prec", "sum")))
