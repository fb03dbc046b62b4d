"""Domain tables derived from the driver's parquet tables.

Every function derives one table of the data model (rain series, cover
fractions, grids, parcels, ...) from the whole input table. ``SQL`` holds the
same tables for the SQL check as named sub-queries; ``with_tables`` prefixes a
query with those it needs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import timeparts as tp
from terrafold.plans.ordered import dealt
from terrafold.session import cut_lineage

X0, Y0 = 500_000, 5_200_000
NODATA = 65535


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- rain ------------------------------------------------------------------


def rain_gappy(spark, sf, stations: Column | None = None) -> DataFrame:
    """10-minute sums; error rows are missing values; absent slots stay absent."""
    e = table(spark, sf, "events")
    st = F.pmod("user_id", F.lit(3)) if stations is None else stations
    return e.groupBy(st.alias("station"), tp.floor_minutes(F.col("ts"), 10).alias("minute")).agg(
        F.round(F.sum(F.when(F.col("event_type") != "error", F.col("value"))) / 10, 4).alias("rain")
    )


def rain_dry(spark, sf) -> DataFrame:
    """Finer stations on the full axis; slots without rows are dry, not missing."""
    obs = rain_gappy(spark, sf, F.floor(F.col("user_id") / 5)).withColumn("seen", F.lit(1))
    span = obs.groupBy("station").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    span = cut_lineage(span)
    rows = int(span.agg(F.sum((F.col("b") - F.col("a")) / 10 + 1)).first()[0] or 0)
    axis = span.select(
        "station", F.explode(F.sequence("a", "b", F.lit(10).cast("long"))).alias("minute")
    )
    # the axis compresses to next to nothing, so its tasks follow from its rows
    return dealt(axis, rows, "station", "minute", wide=True).join(obs, ["station", "minute"], "left").select(
        "station", "minute",
        F.when(F.col("seen").isNull(), F.lit(0.0)).otherwise(F.col("rain")).alias("rain"),
    )


def rain_event(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    start = tp.epoch_minutes(F.col("o_orderdate")) + F.pmod("o_orderkey", F.lit(1440))
    return o.select(
        F.pmod("o_custkey", F.lit(40)).alias("station"),
        F.col("o_orderkey").alias("event_id"),
        start.alias("start_min"),
        (start + F.pmod(F.col("o_orderkey") * 37, F.lit(4000))).alias("end_min"),
        (F.col("o_totalprice") / 1013).alias("EI30"),
    )


# --- cover -----------------------------------------------------------------


def fc_raw(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("poly_id"),
        F.pmod("l_suppkey", F.lit(25)).cast("int").alias("lnf_code"),
        F.year("l_shipdate").alias("yr"),
        (F.lit(float(X0)) + F.pmod("l_partkey", F.lit(50)) * 10).alias("x"),
        (F.lit(float(Y0)) + F.pmod("l_orderkey", F.lit(50)) * 10).alias("y"),
        F.col("l_shipdate").alias("time"),
        (F.col("l_quantity") / 50 - 0.1).alias("pv"),
        (F.col("l_discount") * 10 - 0.1).alias("npv"),
        (F.col("l_tax") / 0.08 - 0.1).alias("soil"),
    )


def fc_pixel(spark, sf) -> DataFrame:
    from terrafold.operators import cover

    raw = cover.normalize_fractions(fc_raw(spark, sf), ["pv", "npv", "soil"], suffix="")
    one = cover.dedupe_mean(raw, ["lnf_code", "poly_id", "yr", "x", "y", "time"], ["pv", "npv", "soil"])
    return one.withColumn("fc_total", (F.col("pv") + F.col("npv")) * 100)


def ei_grid(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(
        (F.lit(float(X0)) + 100 * F.pmod("o_custkey", F.lit(5))).alias("x"),
        (F.lit(float(Y0)) + 100 * F.pmod(F.floor(F.col("o_custkey") / 5), F.lit(5))).alias("y"),
        F.dayofyear("o_orderdate").alias("doy"),
    ).agg((F.sum("o_totalprice") / 7e4).alias("ei"))


def s2_pixel(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    none = F.pmod("l_partkey", F.lit(97)) == 0

    def band(expr: Column) -> Column:
        return F.when(none, F.lit(NODATA)).otherwise(F.floor(expr).cast("int"))

    month = F.trunc(F.to_date("l_shipdate"), "month")
    return li.select(
        (X0 + 1280 * F.pmod("l_suppkey", F.lit(10))).cast("int").alias("tile_minx"),
        (Y0 + 1280 * F.floor(F.col("l_suppkey") / 10)).cast("int").alias("tile_maxy"),
        F.col("l_suppkey").alias("field_id"),
        F.col("l_partkey").alias("px"),
        F.col("l_orderkey").alias("py"),
        month.alias("time"),
        F.concat(
            F.lit("S2A_MSIL2A_"), F.date_format(F.to_date("l_shipdate"), "yyyyMMdd"), F.lit("T102031_N0500_R"),
            F.lpad(F.pmod("l_suppkey", F.lit(100)).cast("string"), 3, "0"), F.lit("_T32"),
            F.lpad(F.pmod("l_partkey", F.lit(1000)).cast("string"), 3, "0"), F.lit("_20240101T000000"),
        ).alias("product_uri"),
        band(F.col("l_extendedprice") / 10).alias("s2_B02"),
        band(F.col("l_quantity") * 100 + 300).alias("s2_B03"),
        band(F.col("l_discount") * 30000 + 200).alias("s2_B04"),
        band(F.col("l_quantity") * 60 + 3000).alias("s2_B08"),
        band(F.col("l_tax") * 40000 + 500).alias("s2_B11"),
        band(F.col("l_tax") * 20000 + F.col("l_discount") * 10000 + 300).alias("s2_B12"),
        F.pmod("l_linenumber", F.lit(5)).cast("int").alias("s2_mask"),
        F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(12)).cast("int").alias("s2_SCL"),
    )


# --- parcels, crops, polygons ----------------------------------------------


def lnf_label(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.sum("c_acctbal").alias("a0"), F.min("c_acctbal").alias("a1"), F.max("c_acctbal").alias("a2")
    )
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select(
        F.col("n_nationkey").alias("lnf_code"),
        F.concat(F.lit("Nation, "), F.col("n_nationkey").cast("string")).alias("crop_name"),
        F.round("a0", 2).alias("2021_Area_m22"),
        F.col("a1").alias("2022_Area_m23"),
        F.col("a2").alias("2023_Area_m2"),
    )


def c_table(spark, sf) -> DataFrame:
    """Reference values by name: exact, differently punctuated, or unmatched."""
    k = F.col("n_nationkey")
    ks = k.cast("string")
    return table(spark, sf, "nation").select(
        F.when(k % 7 == 6, F.concat(F.lit("other "), ks))
        .when(k % 2 == 1, F.concat(F.lit("NATION ("), ks, F.lit(")")))
        .otherwise(F.concat(F.lit("Nation, "), ks)).alias("crop_name"),
        ((k % 10 + 1) / 50).alias("C_ref"),
        ((k % 10 + 1) / 60).alias("Tal_Pflug"),
        ((k % 10 + 1) / 90).alias("Tal_Mulch"),
        ((k % 10 + 1) / 45).alias("Berg_Pflug"),
        ((k % 10 + 1) / 75).alias("Berg_Mulch"),
    )


def override_table(spark, sf) -> DataFrame:
    """Manual names for codes no rule resolves; a few stay unresolved."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").where(F.col("n_regionkey") == 1).select(
        k.alias("lnf_code"), F.concat(F.lit("other "), k.cast("string")).alias("crop_name")
    )


def parcel(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("poly_id"),
        F.pmod(k, F.lit(25)).cast("int").alias("lnf_code"),
        (400 + F.pmod(k, F.lit(500))).cast("double").alias("elevation_m"),
        (2000 + F.abs("s_acctbal") * 10).alias("Flaeche"),
        F.col("s_nationkey").alias("Gemeinde"),
        F.pmod(k, F.lit(20)).alias("betr_ID"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit("Mulch")).when(F.pmod(k, F.lit(3)) == 1, F.lit("Pflug")).alias("tillage"),
        (F.col("s_acctbal") / 311.7).alias("er_pot"),
        (0.5 + F.pmod(k, F.lit(4)) / 8).alias("p_factor"),
    )


def _pt(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def field(spark, sf) -> DataFrame:
    """Boxes, triangles and a few empty rings, one per supplier."""
    k = F.col("s_suppkey")
    x = X0 + F.pmod(k, F.lit(7)) * 70 + 3
    y = Y0 + F.pmod(F.floor(k / 7), F.lit(7)) * 70 + 4
    w = 30 + F.pmod(k, F.lit(5)) * 15
    h = 25 + F.pmod(k, F.lit(4)) * 20
    box = F.array(_pt(x, y), _pt(x + w, y), _pt(x + w, y + h), _pt(x, y + h))
    tri = F.array(_pt(x, y), _pt(x + w, y), _pt(x + w, y + h))
    rings = (
        F.when(F.pmod(k, F.lit(50)) == 49, F.array().cast("array<array<struct<x:double,y:double>>>"))
        .when(F.pmod(k, F.lit(3)) == 0, F.array(tri))
        .otherwise(F.array(box))
    )
    return table(spark, sf, "supplier").select(
        k.alias("id"), F.pmod(k, F.lit(25)).cast("int").alias("lnf_code"), rings.alias("rings")
    )


def admin(spark, sf) -> DataFrame:
    """One notched region per row of ``region``, the last reaching off the grid."""
    k = F.col("r_regionkey")
    x = X0 + k * 110
    ring = F.array(
        _pt(x, F.lit(Y0)), _pt(x + 100, F.lit(Y0)), _pt(x + 100, F.lit(Y0 + 520)),
        _pt(x + 50, F.lit(Y0 + 251)), _pt(x, F.lit(Y0 + 520)),
    )
    return table(spark, sf, "region").select(F.col("r_name").alias("name"), F.array(ring).alias("rings"))


def landuse(spark, sf) -> DataFrame:
    """100 m land-use squares, given by their upper right corner."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.pmod(p, F.lit(17)).cast("int").alias("AS_17"),
        (X0 + (F.pmod(p, F.lit(50)) + 1) * 100).cast("double").alias("E_COORD"),
        (Y0 + (F.floor(p / 50) + 1) * 100).cast("double").alias("N_COORD"),
    )


# --- grids, stations, models -----------------------------------------------


def grid_static(spark, sf) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.pmod(p, F.lit(50)).alias("cx"),
        F.floor(p / 50).alias("cy"),
        (F.col("p_retailprice") * 1.5 + F.col("p_size") * 3).alias("elev"),
        (F.col("p_size") * 0.8).alias("slope"),
        F.pmod(p, F.lit(360)).cast("double").alias("aspect"),
    )


def station_meta(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("station"),
        (X0 + F.pmod(c * 37, F.lit(5000)) + 0.5).alias("east"),
        (Y0 + F.pmod(c * 101, F.lit(4100)) + 0.25).alias("north"),
        F.pmod(c, F.lit(2000)).cast("double").alias("height"),
        F.col("c_mktsegment").alias("exposition"),
    )


def grid_daily(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("prec")
    )


def station_curve(spark, sf) -> DataFrame:
    """Observed and predicted daily erosivity per station and day of year."""
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.pmod("o_custkey", F.lit(40)).alias("station"), tp.doy365(F.col("o_orderdate")).alias("doy")
    ).agg(
        F.round(F.sum("o_totalprice") / 7919, 4).alias("EI_daily_avg"),
        F.round(F.max("o_totalprice") / 3119, 4).alias("predicted_EI_daily_avg"),
    )


def spectra(spark, sf) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.pmod("label", F.lit(3)).cast("int").alias("cls"),
        (2021 + F.pmod("vec_id", F.lit(3))).cast("int").alias("yr"),
        *[F.round(F.abs(e[i].cast("double")), 6).alias(f"b{i + 1}") for i in range(10)],
    )


def calendar(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("parzellen_id"), F.col("event_type").alias("massnahme"),
        F.to_date("ts").alias("datum"),
    )


def score(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.pmod("l_suppkey", F.lit(3)).alias("class_type"),
        F.pmod("l_partkey", F.lit(6)).alias("soil_group"),
        F.col("l_linenumber").alias("iteration"),
    ).agg(F.round(F.avg("l_discount"), 6).alias("rmse"), F.round(F.avg("l_tax"), 6).alias("r2"))


SQL: dict[str, str] = {
    "rain_gappy": """SELECT user_id % 3 AS station,
        CAST(floor(epoch(ts) / 600) AS BIGINT) * 10 AS minute,
        round(sum(CASE WHEN event_type <> 'error' THEN value END) / 10, 4) AS rain
        FROM events GROUP BY 1, 2""",
    "rain_five": """SELECT CAST(floor(user_id / 5) AS BIGINT) AS station,
        CAST(floor(epoch(ts) / 600) AS BIGINT) * 10 AS minute, 1 AS seen,
        round(sum(CASE WHEN event_type <> 'error' THEN value END) / 10, 4) AS rain
        FROM events GROUP BY 1, 2""",
    "rain_dry": """SELECT a.station, a.minute,
        CASE WHEN r.seen IS NULL THEN 0.0 ELSE r.rain END AS rain
        FROM (SELECT station, unnest(range(min(minute), max(minute) + 10, 10)) AS minute
              FROM rain_five GROUP BY station) a
        LEFT JOIN rain_five r ON r.station = a.station AND r.minute = a.minute""",
    "rain_event": """SELECT o_custkey % 40 AS station, o_orderkey AS event_id,
        CAST(epoch(o_orderdate) / 60 AS BIGINT) + o_orderkey % 1440 AS start_min,
        CAST(epoch(o_orderdate) / 60 AS BIGINT) + o_orderkey % 1440 + (o_orderkey * 37) % 4000 AS end_min,
        o_totalprice / 1013 AS EI30 FROM orders""",
    "fc_raw": f"""SELECT l_suppkey AS poly_id, CAST(l_suppkey % 25 AS INT) AS lnf_code,
        CAST(year(l_shipdate) AS INT) AS yr,
        {X0}.0::DOUBLE + (l_partkey % 50) * 10 AS x, {Y0}.0::DOUBLE + (l_orderkey % 50) * 10 AS y,
        l_shipdate AS "time", l_quantity / 50 - 0.1::DOUBLE AS pv,
        l_discount * 10 - 0.1::DOUBLE AS npv, l_tax / 0.08::DOUBLE - 0.1::DOUBLE AS soil FROM lineitem""",
    "fc_clip": """SELECT *, greatest(pv, 0) + greatest(npv, 0) + greatest(soil, 0) AS tot FROM fc_raw""",
    "fc_norm": """SELECT poly_id, lnf_code, yr, x, y, "time",
        CASE WHEN tot > 0 THEN greatest(pv, 0) / tot END AS pv,
        CASE WHEN tot > 0 THEN greatest(npv, 0) / tot END AS npv,
        CASE WHEN tot > 0 THEN greatest(soil, 0) / tot END AS soil FROM fc_clip""",
    "fc_pixel": """SELECT lnf_code, poly_id, yr, x, y, "time", avg(pv) AS pv, avg(npv) AS npv,
        avg(soil) AS soil, (avg(pv) + avg(npv)) * 100 AS fc_total
        FROM fc_norm GROUP BY ALL""",
    "ei_grid": f"""SELECT {X0}.0::DOUBLE + 100 * (o_custkey % 5) AS x,
        {Y0}.0::DOUBLE + 100 * (CAST(floor(o_custkey / 5) AS BIGINT) % 5) AS y,
        CAST(dayofyear(o_orderdate) AS INT) AS doy, sum(o_totalprice) / 7e4 AS ei FROM orders GROUP BY 1, 2, 3""",
    "ei_cells": f"""SELECT CAST((x - {X0}) / 100 AS BIGINT) AS gx, CAST((y - {Y0}) / 100 AS BIGINT) AS gy, doy, ei FROM ei_grid""",
    "fc_ei": f"""SELECT f.*, e.ei FROM fc_pixel f LEFT JOIN ei_cells e
        ON CAST(round_even((f.x - {X0}) / 100, 0) AS BIGINT) = e.gx
        AND CAST(round_even((f.y - {Y0}) / 100, 0) AS BIGINT) = e.gy
        AND least(dayofyear(f."time"), 365) = e.doy""",
    "pixel_c": """SELECT lnf_code, yr, poly_id, x, y,
        CASE WHEN sum(ei) > 0 THEN sum(exp(-0.033 * fc_total) * ei) / sum(ei) END AS C
        FROM fc_ei WHERE ei IS NOT NULL AND fc_total IS NOT NULL GROUP BY ALL""",
    "s2_pixel": f"""SELECT CAST({X0} + 1280 * (l_suppkey % 10) AS INT) AS tile_minx,
        CAST({Y0} + 1280 * floor(l_suppkey / 10) AS INT) AS tile_maxy,
        l_suppkey AS field_id, l_partkey AS px, l_orderkey AS py,
        CAST(date_trunc('month', l_shipdate) AS DATE) AS "time",
        'S2A_MSIL2A_' || strftime(l_shipdate, '%Y%m%d') || 'T102031_N0500_R' ||
          lpad(CAST(l_suppkey % 100 AS VARCHAR), 3, '0') || '_T32' ||
          lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '_20240101T000000' AS product_uri,
        CASE WHEN l_partkey % 97 = 0 THEN 65535 ELSE CAST(floor(l_extendedprice / 10) AS INT) END AS s2_B02,
        CASE WHEN l_partkey % 97 = 0 THEN 65535 ELSE CAST(floor(l_quantity * 100 + 300) AS INT) END AS s2_B03,
        CASE WHEN l_partkey % 97 = 0 THEN 65535 ELSE CAST(floor(l_discount * 30000 + 200) AS INT) END AS s2_B04,
        CASE WHEN l_partkey % 97 = 0 THEN 65535 ELSE CAST(floor(l_quantity * 60 + 3000) AS INT) END AS s2_B08,
        CASE WHEN l_partkey % 97 = 0 THEN 65535 ELSE CAST(floor(l_tax * 40000 + 500) AS INT) END AS s2_B11,
        CASE WHEN l_partkey % 97 = 0 THEN 65535 ELSE CAST(floor(l_tax * 20000 + l_discount * 10000 + 300) AS INT) END AS s2_B12,
        CAST(l_linenumber % 5 AS INT) AS s2_mask, CAST((l_partkey + l_linenumber) % 12 AS INT) AS s2_SCL
        FROM lineitem""",
    "lnf_label": """SELECT n_nationkey AS lnf_code, 'Nation, ' || n_nationkey AS crop_name,
        round(a0, 2) AS "2021_Area_m22", a1 AS "2022_Area_m23", a2 AS "2023_Area_m2"
        FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) a0, min(c_acctbal) a1, max(c_acctbal) a2
        FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""",
    "c_table": """SELECT CASE WHEN n_nationkey % 7 = 6 THEN 'other ' || n_nationkey
        WHEN n_nationkey % 2 = 1 THEN 'NATION (' || n_nationkey || ')' ELSE 'Nation, ' || n_nationkey END AS crop_name,
        (n_nationkey % 10 + 1) / 50 AS C_ref, (n_nationkey % 10 + 1) / 60 AS Tal_Pflug,
        (n_nationkey % 10 + 1) / 90 AS Tal_Mulch, (n_nationkey % 10 + 1) / 45 AS Berg_Pflug,
        (n_nationkey % 10 + 1) / 75 AS Berg_Mulch FROM nation""",
    "override_table": """SELECT n_nationkey AS lnf_code, 'other ' || n_nationkey AS crop_name
        FROM nation WHERE n_regionkey = 1""",
    "parcel": """SELECT s_suppkey AS poly_id, CAST(s_suppkey % 25 AS INT) AS lnf_code,
        CAST(400 + s_suppkey % 500 AS DOUBLE) AS elevation_m, 2000 + abs(s_acctbal) * 10 AS Flaeche,
        s_nationkey AS Gemeinde, s_suppkey % 20 AS betr_ID,
        CASE s_suppkey % 3 WHEN 0 THEN 'Mulch' WHEN 1 THEN 'Pflug' END AS tillage,
        s_acctbal / 311.7::DOUBLE AS er_pot, 0.5::DOUBLE + (s_suppkey % 4) / 8 AS p_factor FROM supplier""",
    # one row per corner, in ring order; polygons without rows are empty
    "field_v": f"""SELECT s_suppkey AS id, CAST(s_suppkey % 25 AS INT) AS lnf_code, v.i AS i,
        {X0} + (s_suppkey % 7) * 70 + 3 + v.dx * (30 + (s_suppkey % 5) * 15) AS x,
        {Y0} + (CAST(floor(s_suppkey / 7) AS BIGINT) % 7) * 70 + 4 + v.dy * (25 + (s_suppkey % 4) * 20) AS y
        FROM supplier, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) v(i, dx, dy)
        WHERE s_suppkey % 50 <> 49 AND NOT (s_suppkey % 3 = 0 AND v.i = 3)""",
    "admin_v": f"""SELECT r_name AS name, v.i AS i, {X0} + r_regionkey * 110 + v.dx AS x, {Y0} + v.dy AS y
        FROM region, (VALUES (0, 0, 0), (1, 100, 0), (2, 100, 520), (3, 50, 251), (4, 0, 520)) v(i, dx, dy)""",
    "field_e": """SELECT id, lnf_code, i, x AS x1, y AS y1,
        coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM field_v WINDOW w AS (PARTITION BY id ORDER BY i)""",
    "admin_e": """SELECT name, i, x AS x1, y AS y1,
        coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM admin_v WINDOW w AS (PARTITION BY name ORDER BY i)""",
    "landuse": f"""SELECT CAST(p_partkey % 17 AS INT) AS AS_17,
        CAST({X0} + (p_partkey % 50 + 1) * 100 AS DOUBLE) AS E_COORD,
        CAST({Y0} + (floor(p_partkey / 50) + 1) * 100 AS DOUBLE) AS N_COORD FROM part""",
    "grid_static": """SELECT p_partkey % 50 AS cx, CAST(floor(p_partkey / 50) AS BIGINT) AS cy,
        p_retailprice * 1.5::DOUBLE + p_size * 3 AS elev, p_size * 0.8::DOUBLE AS slope,
        CAST(p_partkey % 360 AS DOUBLE) AS aspect FROM part""",
    "station_meta": f"""SELECT c_custkey AS station, {X0} + (c_custkey * 37) % 5000 + 0.5::DOUBLE AS east,
        {Y0} + (c_custkey * 101) % 4100 + 0.25::DOUBLE AS north, CAST(c_custkey % 2000 AS DOUBLE) AS height,
        c_mktsegment AS exposition FROM customer""",
    "grid_daily": """SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS prec
        FROM lineitem GROUP BY 1, 2""",
    "station_curve": """SELECT o_custkey % 40 AS station, CAST(least(dayofyear(o_orderdate), 365) AS INT) AS doy,
        round(sum(o_totalprice) / 7919, 4) AS EI_daily_avg,
        round(max(o_totalprice) / 3119, 4) AS predicted_EI_daily_avg FROM orders GROUP BY 1, 2""",
    "spectra": "SELECT vec_id AS id, CAST(label % 3 AS INT) AS cls, CAST(2021 + vec_id % 3 AS INT) AS yr, "
    + ", ".join(f"round(abs(CAST(embedding[{i}] AS DOUBLE)), 6) AS b{i}" for i in range(1, 11))
    + " FROM embeddings",
    "calendar": """SELECT user_id AS parzellen_id, event_type AS massnahme, CAST(ts AS DATE) AS datum FROM events""",
    "score": """SELECT l_suppkey % 3 AS class_type, l_partkey % 6 AS soil_group, l_linenumber AS iteration,
        round(avg(l_discount), 6) AS rmse, round(avg(l_tax), 6) AS r2 FROM lineitem GROUP BY 1, 2, 3""",
}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the derived tables it names, in dependency order."""
    defs = {**SQL, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in defs:
            if name not in order and re.search(rf"\b{name}\b", text):
                if defs[name] is not text:
                    need(defs[name])
                    if name not in order:
                        order.append(name)

    need(body)
    if not order:
        return body
    head = ", ".join(f"{n} AS ({defs[n]})" for n in order)
    text = body.lstrip()
    if text.upper().startswith("WITH "):
        return f"WITH RECURSIVE {head}, {text[5:]}"
    return f"WITH RECURSIVE {head} {body}"
