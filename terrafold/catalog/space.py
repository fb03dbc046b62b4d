"""Polygon joins, rasters, regions and grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.registry import query, rounded
from terrafold.functions import timeparts as tp
from terrafold.operators import cover, grid, rain, spatial, stats
from terrafold.sources import tiles

X0, Y0 = t.X0, t.Y0
NORM = ["pv", "npv", "soil"]


def norm(s, d):
    return cover.normalize_fractions(t.fc_raw(s, d), NORM, "")


# points in polygons on the SQL side: count edge crossings
PIP = """((e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1)"""
SPACE = {
    "pos": "SELECT DISTINCT x, y FROM fc_raw",
    "pos_field": f"""SELECT p.x, p.y, e.id, e.lnf_code AS code FROM pos p, field_e e GROUP BY ALL HAVING count(*) FILTER {PIP.join(['(WHERE ', ')'])} % 2 = 1""",
    "pos_admin": f"""SELECT p.x, p.y, e.name FROM pos p, admin_e e GROUP BY ALL HAVING count(*) FILTER (WHERE {PIP}) % 2 = 1""",
    # all 10 m cells of the area, with their centres
    "cells": f"""SELECT i AS gx, j AS gy, {X0} + (i + 0.5::DOUBLE) * 10 AS x, {Y0} + (j + 0.5::DOUBLE) * 10 AS y FROM range(0, 70) a(i), range(0, 70) b(j)""",
    "cell_field": f"""SELECT p.gx, p.gy, e.id, e.lnf_code FROM cells p, field_e e GROUP BY ALL HAVING count(*) FILTER (WHERE {PIP}) % 2 = 1""",
    "norm_region": """SELECT n.*, a.name FROM fc_norm n JOIN pos_admin a ON n.x = a.x AND n.y = a.y""",
    "region_area": f"""SELECT name, count(*) * 100.0::DOUBLE AS total_valid_area FROM
        (SELECT DISTINCT gx, gy FROM cell_field) c JOIN
        (SELECT p.gx, p.gy, e.name FROM cells p, admin_e e GROUP BY ALL HAVING count(*) FILTER (WHERE {PIP}) % 2 = 1) r
        USING (gx, gy) GROUP BY 1""",
}
query(
    "point_in_polygon_join",
    """SELECT f.poly_id, f."time"::DATE::VARCHAR AS day, f.x, f.y, q.id FROM fc_raw f JOIN pos_field q ON f.x = q.x AND f.y = q.y
       """, "x y", tables=SPACE, settled=True,
)(
    # the result has many rows for each row of the points, so what can be told of a point is told before the join
    lambda s, d: spatial.point_in_polygon_join(
        rounded(t.fc_raw(s, d).select("poly_id", tp.iso_date(F.col("time")).alias("day"), "x", "y"), 6), t.field(s, d).select("id", "rings"), size=100.0
    ).select("poly_id", "day", "x", "y", "id")
)
query(
    "point_in_polygon_left",
    """SELECT f.poly_id, count(*) AS n_rows, count(q.name) AS n_inside FROM fc_raw f LEFT JOIN pos_admin q ON f.x = q.x AND f.y = q.y GROUP BY 1""",
    tables=SPACE,
)(
    lambda s, d: spatial.point_in_polygon_join(t.fc_raw(s, d), t.admin(s, d), how="left").groupBy("poly_id")
    .agg(F.count(F.lit(1)).alias("n_rows"), F.count("name").alias("n_inside"))
)
query(
    "clip",
    f"""SELECT poly_id, count(*) AS n FROM fc_raw f SEMI JOIN (SELECT p.x, p.y FROM (SELECT DISTINCT x + 5 AS x, y - 5 AS y FROM fc_raw) p, field_e e
        GROUP BY p.x, p.y, e.id HAVING count(*) FILTER (WHERE {PIP}) % 2 = 1) q ON f.x + 5 = q.x AND f.y - 5 = q.y GROUP BY 1""",
    tables=SPACE,
)(lambda s, d: spatial.clip(t.fc_raw(s, d), t.field(s, d), size=100.0).groupBy("poly_id").agg(F.count(F.lit(1)).alias("n")))
query(
    "point_in_polygon",
    f"""SELECT name, count(*) AS n_positions FROM pos_admin GROUP BY 1""", tables=SPACE,
)(
    lambda s, d: spatial.point_in_polygon_join(t.fc_raw(s, d).select("x", "y").distinct(), t.admin(s, d), size=200.0)
    .groupBy("name").agg(F.count(F.lit(1)).alias("n_positions"))
)


def field_cells(s, d):
    return spatial.interior_cells(t.field(s, d), ["id"], 10.0, X0, Y0)


query("rasterize", "SELECT gx, gy, max(id) AS id FROM cell_field GROUP BY 1, 2", tables=SPACE)(
    lambda s, d: spatial.rasterize(t.field(s, d), "id", "id", 10.0, X0, Y0)
)
query(
    "rasterize_majority",
    f"""WITH fine AS (SELECT p.i, p.j, max(e.lnf_code) FILTER (WHERE FALSE) AS none, e.id, e.lnf_code AS code FROM
          (SELECT i, j, {X0} + (i + 0.5::DOUBLE) * 2 AS x, {Y0} + (j + 0.5::DOUBLE) * 2 AS y FROM range(0, 325) a(i), range(0, 325) b(j)) p
          JOIN field_e e ON p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)
          GROUP BY ALL HAVING count(*) FILTER (WHERE {PIP}) % 2 = 1),
       top AS (SELECT i, j, max_by(code, id) AS lnf_code FROM fine GROUP BY 1, 2),
       cnt AS (SELECT i // 5 AS gx, j // 5 AS gy, lnf_code, count(*) AS n FROM top GROUP BY 1, 2, 3)
       SELECT gx, gy, lnf_code, n_probes FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY n DESC, lnf_code) AS rn,
         CAST(sum(n) OVER (PARTITION BY gx, gy) AS BIGINT) AS n_probes FROM cnt) WHERE rn = 1""",
)(lambda s, d: spatial.rasterize_majority(t.field(s, d), "lnf_code", "id", 10.0, X0, Y0, sub=5))
ERODE = {
    "kept": """SELECT a.id, a.gx, a.gy FROM cell_field a JOIN cell_field b ON a.id = b.id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1
        GROUP BY 1, 2, 3 HAVING count(*) = 9""",
    "eroded": "SELECT * FROM kept UNION ALL SELECT id, gx, gy FROM cell_field WHERE id NOT IN (SELECT id FROM kept)",
}
query("erode", "SELECT id, gx, gy FROM eroded", tables={**SPACE, **ERODE})(lambda s, d: spatial.erode(field_cells(s, d), "id"))
query(
    "sample_point",
    f"""SELECT id, {X0} + (gx + 0.5::DOUBLE) * 10 AS x, {Y0} + (gy + 0.5::DOUBLE) * 10 AS y FROM
        (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('0|' || id || '|' || gx || '|' || gy), gx, gy) AS rn FROM eroded) WHERE rn = 1""",
    "x y", tables={**SPACE, **ERODE},
)(lambda s, d: spatial.interior_points(field_cells(s, d), "id", 10.0, X0, Y0))
SHOE = """SELECT id, any_value(lnf_code) AS lnf_code, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area,
    sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx,
    sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy
    FROM (SELECT id, lnf_code, CAST(x1 AS DOUBLE) x1, CAST(x2 AS DOUBLE) x2, CAST(y1 AS DOUBLE) y1, CAST(y2 AS DOUBLE) y2 FROM field_e) GROUP BY 1"""
FIELD_META = f"""SELECT s_suppkey AS id, CAST(s_suppkey % 25 AS INT) AS lnf_code, coalesce(area, 0.0) AS area, cx, cy
    FROM supplier LEFT JOIN ({SHOE}) q ON q.id = s_suppkey"""
query("area_centroid", FIELD_META, "area cx cy", digits=2)(
    lambda s, d: spatial.area_centroid(t.field(s, d)).select("id", "lnf_code", "area", "cx", "cy")
)
query(
    "centroid_join",
    f"""SELECT c.id, e.doy, e.ei FROM ({FIELD_META}) c JOIN ei_cells e
        ON CAST(round_even((round(c.cx, 3) - {X0}) / 100, 0) AS BIGINT) = e.gx AND CAST(round_even((round(c.cy, 3) - {Y0}) / 100, 0) AS BIGINT) = e.gy""",
    "ei",
)(lambda s, d: _centroid_join(s, d))


def _centroid_join(s, d):
    from terrafold.operators import cfactor as cf

    c = spatial.area_centroid(t.field(s, d)).select("id", F.round("cx", 3).alias("x"), F.round("cy", 3).alias("y"))
    p = c.withColumns({"gx": cf.grid_cell(F.col("x"), X0, 100.0), "gy": cf.grid_cell(F.col("y"), Y0, 100.0)})
    e = t.ei_grid(s, d).select(
        cf.grid_cell(F.col("x"), X0, 100.0).alias("gx"), cf.grid_cell(F.col("y"), Y0, 100.0).alias("gy"), "doy", "ei"
    )
    return p.join(e, ["gx", "gy"]).select("id", "doy", "ei")


query("area_in_region", "SELECT * FROM region_area", "total_valid_area", tables=SPACE)(
    lambda s, d: spatial.area_in_region(field_cells(s, d), t.admin(s, d), "name", 10.0, X0, Y0)
)
query(
    "dedupe_geometry",
    """WITH g AS (SELECT id, any_value(lnf_code) AS lnf_code, string_agg(x || ',' || y, ';' ORDER BY i) AS geo FROM field_v GROUP BY 1),
       f AS (SELECT s_suppkey AS id, CAST(s_suppkey % 25 AS INT) AS lnf_code, coalesce(geo, '') AS geo FROM supplier LEFT JOIN g ON g.id = s_suppkey)
       SELECT min(id) AS id, lnf_code FROM f GROUP BY lnf_code, geo""",
)(lambda s, d: spatial.dedupe_geometry(t.field(s, d), "lnf_code", "id").select("id", "lnf_code"))


def region_pixels(s, d):
    return spatial.point_in_polygon_join(norm(s, d), t.admin(s, d))


RSTAT = """SELECT r.name, s.n_pixels, total_valid_area, pv_mean, pv_std, pv_count, soil_mean, soil_std, soil_count,
    s.n_pixels * 100 / total_valid_area AS fraction_area, pv_count / max(pv_count) OVER () AS count_norm
    FROM (SELECT name, count(*) AS n_pixels, avg(pv) pv_mean, stddev_samp(pv) pv_std, count(pv) pv_count, avg(soil) soil_mean,
      stddev_samp(soil) soil_std, count(soil) soil_count FROM
      (SELECT name, x, y, avg(pv) AS pv, avg(soil) AS soil FROM norm_region WHERE pv IS NOT NULL OR soil IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1) s
    JOIN region_area r USING (name) WHERE total_valid_area > 300 AND s.n_pixels * 100 / total_valid_area > 0.1"""
query(
    "region_stats", RSTAT, "total_valid_area pv_mean pv_std soil_mean soil_std fraction_area count_norm", tables=SPACE
)(
    lambda s, d: cover.region_stats(
        region_pixels(s, d), spatial.area_in_region(field_cells(s, d), t.admin(s, d), "name", 10.0, X0, Y0),
        "name", ["x", "y"], ["pv", "soil"], min_share=0.1,
    )
)
query(
    "region_stats_median", RSTAT.replace("avg(pv) AS pv, avg(soil) AS soil", "quantile_cont(pv, 0.5) AS pv, quantile_cont(soil, 0.5) AS soil"),
    "total_valid_area pv_mean pv_std soil_mean soil_std fraction_area count_norm", tables=SPACE,
)(
    lambda s, d: cover.region_stats(
        region_pixels(s, d), spatial.area_in_region(field_cells(s, d), t.admin(s, d), "name", 10.0, X0, Y0),
        "name", ["x", "y"], ["pv", "soil"], min_share=0.1, stat="median",
    )
)
query(
    "bare_share",
    """SELECT name, count(*) FILTER (soil > 0.3) AS n_bare, count(*) AS n_pixels, count(*) FILTER (soil > 0.3) / count(*) AS bare_share
       FROM (SELECT name, x, y, avg(soil) AS soil FROM norm_region GROUP BY 1, 2, 3) WHERE soil IS NOT NULL GROUP BY 1""",
    "bare_share", tables=SPACE,
)(lambda s, d: cover.bare_share(region_pixels(s, d), "name", ["x", "y"], "soil", 0.3))
query(
    "bare_days",
    """SELECT name, avg(CASE WHEN v >= 8 THEN dd END) AS bare_days, count(CASE WHEN v >= 8 THEN dd END) AS n_pixels FROM
       (SELECT name, x, y, count(soil) AS v, 7 * count(*) FILTER (soil > 0.5) AS dd FROM
        (SELECT name, x, y, CAST(week("time") AS INT) AS w, avg(soil) AS soil FROM norm_region GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1""",
    "bare_days", tables=SPACE,
)(
    lambda s, d: cover.bare_days(
        region_pixels(s, d).withColumn("week", F.weekofyear("time")), "name", ["x", "y"], "week", "soil", n_periods=53, min_valid=8 / 53
    )
)
query(
    "zonal_mean",
    f"""SELECT s_suppkey AS id, avg(v) AS mean, count(v) AS n FROM supplier LEFT JOIN
        (SELECT q.id, f.soil AS v FROM fc_norm f JOIN pos_field q ON f.x = q.x AND f.y = q.y) z ON z.id = s_suppkey GROUP BY 1""",
    "mean", tables=SPACE,
)(lambda s, d: spatial.zonal_mean(norm(s, d), t.field(s, d), "id", "soil", size=100.0))

BOXES = f"SELECT AS_17, p.N_COORD, p.E_COORD, E_COORD - 100 AS minx, E_COORD AS maxx, N_COORD - 100 AS miny, N_COORD AS maxy FROM landuse p"
TILES = f"""SELECT DISTINCT tile_minx, tile_maxy, tile_minx AS minx, tile_minx + 1280 AS maxx, tile_maxy - 1280 AS miny, tile_maxy AS maxy FROM s2_pixel"""


def tile_boxes(s, d):
    c = F.col
    return t.s2_pixel(s, d).select("tile_minx", "tile_maxy").distinct().select(
        "tile_minx", "tile_maxy", c("tile_minx").alias("minx"), (c("tile_minx") + 1280).alias("maxx"),
        (c("tile_maxy") - 1280).alias("miny"), c("tile_maxy").alias("maxy"),
    )


query(
    "box_join",
    f"""SELECT a.tile_minx, a.tile_maxy, b.AS_17, b.E_COORD, b.N_COORD FROM ({TILES}) a JOIN ({BOXES}) b
        ON a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy""",
)(
    lambda s, d: spatial.box_join(tile_boxes(s, d), spatial.square_box(t.landuse(s, d)), 1280.0).select(
        F.col("a_tile_minx").alias("tile_minx"), F.col("a_tile_maxy").alias("tile_maxy"), F.col("b_AS_17").alias("AS_17"),
        F.col("b_E_COORD").alias("E_COORD"), F.col("b_N_COORD").alias("N_COORD"),
    )
)
FILES = "SELECT DISTINCT 'S2_' || tile_minx || '_' || tile_maxy || '_' || strftime(\"time\", '%Y%m%d') || '.zarr' AS file FROM s2_pixel"


def files(s, d):
    return t.s2_pixel(s, d).select(
        F.concat(F.lit("S2_"), F.col("tile_minx").cast("string"), F.lit("_"), F.col("tile_maxy").cast("string"), F.lit("_"),
                 F.date_format("time", "yyyyMMdd"), F.lit(".zarr")).alias("file")
    ).distinct()


SCAN = f"""SELECT file, CAST(split_part(file, '_', 2) AS INT) AS minx, CAST(split_part(file, '_', 3) AS INT) AS maxy,
    CAST(split_part(file, '_', 2) AS INT) + 1280 AS maxx, CAST(split_part(file, '_', 3) AS INT) - 1280 AS miny,
    CAST(substr(split_part(file, '_', 4), 1, 4) AS INT) AS yr FROM ({FILES})"""
query("tile_scan", SCAN)(lambda s, d: tiles.tile_scan(files(s, d)))
query("tile_select", f"SELECT * FROM ({SCAN}) WHERE yr IN (1996, 1999) AND minx <= 505000 AND maxx >= 502000 AND miny <= 5206000 AND maxy >= 5201000")(
    lambda s, d: tiles.tile_select(tiles.tile_scan(files(s, d)), 502000, 5201000, 505000, 5206000, [1996, 1999])
)
query(
    "skip_done",
    f"SELECT file FROM ({FILES}) WHERE file NOT IN (SELECT 'S2_' || tile_minx || '_' || tile_maxy || '_' || strftime(\"time\", '%Y%m%d') || '.zarr' FROM s2_pixel WHERE s2_SCL = 4)",
)(
    lambda s, d: tiles.skip_done(files(s, d), t.s2_pixel(s, d).where("s2_SCL = 4").select(
        F.concat(F.lit("S2_"), F.col("tile_minx").cast("string"), F.lit("_"), F.col("tile_maxy").cast("string"), F.lit("_"),
                 F.date_format("time", "yyyyMMdd"), F.lit(".zarr")).alias("file")), "file")
)

# --- grids -------------------------------------------------------------------
ST = f"SELECT station, east, north, CAST(floor((east - {X0}) / 100) AS BIGINT) AS cx, CAST(floor((north - {Y0}) / 100) AS BIGINT) AS cy FROM station_meta"
query("point_sample", f"SELECT station, g.elev, g.slope FROM ({ST}) s LEFT JOIN grid_static g USING (cx, cy)", "elev slope")(
    lambda s, d: grid.point_sample(t.station_meta(s, d), t.grid_static(s, d), "east", "north", X0, Y0, 100.0).select("station", "elev", "slope")
)
query(
    "neighbourhood_mean",
    f"SELECT station, avg(g.elev) AS elev FROM ({ST}) s LEFT JOIN grid_static g ON abs(g.cx - s.cx) <= 2 AND abs(g.cy - s.cy) <= 2 GROUP BY 1",
    "elev",
)(lambda s, d: grid.neighbourhood_mean(t.station_meta(s, d), "station", t.grid_static(s, d), "elev", "east", "north", X0, Y0, 100.0))


def valid_cells(s, d):
    return t.grid_static(s, d).where(F.col("slope") > 36)


query(
    "nearest_cell",
    f"""SELECT station, cx, cy, sqrt(d2) AS distance FROM (SELECT s.station, g.cx, g.cy, (g.cx - px) ** 2 + (g.cy - py) ** 2 AS d2,
        row_number() OVER (PARTITION BY s.station ORDER BY (g.cx - px) ** 2 + (g.cy - py) ** 2, g.cy, g.cx) AS rn
        FROM (SELECT station, (east - {X0}) / 100 AS px, (north - {Y0}) / 100 AS py FROM station_meta) s,
        (SELECT * FROM grid_static WHERE slope > 36) g) WHERE rn = 1""",
    "distance",
)(
    lambda s, d: grid.nearest_cell(
        t.station_meta(s, d).select("station", ((F.col("east") - X0) / 100).alias("px"), ((F.col("north") - Y0) / 100).alias("py")),
        ["station"], valid_cells(s, d), [],
    )
)
LAB = "SELECT cx, cy, CASE WHEN slope > 35 THEN CAST(slope AS INT) % 5 + 1 END AS grp FROM grid_static"


def labelled(s, d):
    return t.grid_static(s, d).select("cx", "cy", F.when(F.col("slope") > 35, F.pmod(F.round("slope").cast("int"), F.lit(5)) + 1).alias("grp"))


query(
    "fill_nearest",
    f"""WITH lab AS MATERIALIZED ({LAB}) SELECT cx, cy, grp FROM lab WHERE grp IS NOT NULL UNION ALL
        SELECT cx, cy, grp FROM (SELECT a.cx, a.cy, b.grp, row_number() OVER (PARTITION BY a.cx, a.cy
          ORDER BY (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2, b.cy, b.cx) AS rn
          FROM (SELECT * FROM lab WHERE grp IS NULL) a, (SELECT * FROM lab WHERE grp IS NOT NULL) b) WHERE rn = 1""",
)(lambda s, d: grid.fill_nearest(labelled(s, d), "grp"))
BIL = f"""SELECT station, CASE WHEN count(elev) = count(*) THEN sum(w * elev) END AS elev FROM
    (SELECT station, ix + dx AS cx, iy + dy AS cy, CASE dx WHEN 0 THEN 1 - u ELSE u END * CASE dy WHEN 0 THEN 1 - v ELSE v END AS w FROM
      (SELECT station, floor(fx) AS ix, floor(fy) AS iy, fx - floor(fx) AS u, fy - floor(fy) AS v FROM
        (SELECT station, (east - {X0}) / 100 AS fx, (north - {Y0}) / 100 AS fy FROM station_meta)),
      (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)) k LEFT JOIN grid_static g USING (cx, cy) WHERE w > 0 GROUP BY 1"""
query("interp_at_points", BIL, "elev", digits=9)(lambda s, d: grid.bilinear(t.station_meta(s, d), ["station"], t.grid_static(s, d), ["elev"], fx_(), fy_()))


def fx_():
    return (F.col("east") - X0) / 100


def fy_():
    return (F.col("north") - Y0) / 100


query(
    "resample_bilinear",
    """SELECT cx, cy, CASE WHEN count(elev) = count(*) THEN sum(w * elev) END AS elev FROM
       (SELECT k.cx, k.cy, ix + dx AS jx, iy + dy AS jy, CASE dx WHEN 0 THEN 1 - u ELSE u END * CASE dy WHEN 0 THEN 1 - v ELSE v END AS w FROM
         (SELECT cx, cy, floor(cx * 0.75) AS ix, floor(cy * 0.75) AS iy, cx * 0.75::DOUBLE - floor(cx * 0.75) AS u, cy * 0.75::DOUBLE - floor(cy * 0.75) AS v
          FROM grid_static) k, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)) z
       LEFT JOIN (SELECT cx AS jx, cy AS jy, elev FROM grid_static) g USING (jx, jy) WHERE w > 0 GROUP BY 1, 2""",
    "elev",
)(
    lambda s, d: grid.bilinear(
        t.grid_static(s, d).select("cx", "cy").withColumnsRenamed({"cx": "tx", "cy": "ty"}), ["tx", "ty"], t.grid_static(s, d), ["elev"],
        F.col("tx") * 0.75, F.col("ty") * 0.75,
    ).withColumnsRenamed({"tx": "cx", "ty": "cy"})
)
query(
    "resample_nearest",
    f"""SELECT station, g.elev FROM (SELECT station, CAST(round_even((east - {X0}) / 100, 0) AS BIGINT) AS cx,
        CAST(round_even((north - {Y0}) / 100, 0) AS BIGINT) AS cy FROM station_meta) s LEFT JOIN grid_static g USING (cx, cy)""",
    "elev",
)(lambda s, d: grid.resample_nearest(t.station_meta(s, d), t.grid_static(s, d), fx_(), fy_()).select("station", "elev"))
query("downsample", "SELECT cx // 4 AS cx, cy // 4 AS cy, avg(elev) AS elev, avg(slope) AS slope FROM grid_static GROUP BY 1, 2", "elev slope")(
    lambda s, d: grid.downsample(t.grid_static(s, d), 4, ["elev", "slope"])
)
query(
    "terrain",
    """SELECT cx, cy, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope,
       CASE WHEN NOT (abs(gx) < 1e-9 AND abs(gy) < 1e-9) THEN
         CASE WHEN round(degrees(atan2(-gx, -gy)), 9) < 0 THEN round(degrees(atan2(-gx, -gy)), 9) + 360 ELSE round(degrees(atan2(-gx, -gy)), 9) END END AS aspect
       FROM (SELECT a.cx, a.cy, sum((b.cx - a.cx) * (2 - abs(b.cy - a.cy)) * b.elev) / 800 AS gx,
         sum((b.cy - a.cy) * (2 - abs(b.cx - a.cx)) * b.elev) / 800 AS gy FROM grid_static a JOIN grid_static b
         ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 GROUP BY 1, 2 HAVING count(*) = 9)""",
    "slope aspect", digits=5,
)(lambda s, d: grid.terrain(grid.screen_heights(t.grid_static(s, d)), 100.0))
query(
    "block_fraction",
    """SELECT cx // 2 AS bx, cy // 2 AS "by", avg(CASE WHEN slope > 20 THEN 1.0 ELSE 0.0 END) AS fraction, count(*) AS n
       FROM grid_static GROUP BY 1, 2 HAVING count(*) = 4""",
    "fraction",
)(lambda s, d: grid.block_fraction(t.grid_static(s, d).withColumn("flag", (F.col("slope") > 20).cast("int")), 2, "flag"))
query(
    "trim_extent",
    """SELECT cx, cy, v FROM (SELECT cx, cy, CASE WHEN cx > 3 AND cy > 2 AND slope > 30 THEN slope END AS v FROM grid_static) g,
       (SELECT min(cx) a, max(cx) b, min(cy) c, max(cy) d FROM grid_static WHERE cx > 3 AND cy > 2 AND slope > 30) WHERE cx BETWEEN a AND b AND cy BETWEEN c AND d""",
    "v",
)(
    lambda s, d: grid.trim_extent(
        t.grid_static(s, d).select("cx", "cy", F.when((F.col("cx") > 3) & (F.col("cy") > 2) & (F.col("slope") > 30), F.col("slope")).alias("v")), "v"
    )
)
query(
    "dense_grid",
    f"""SELECT i AS cx, j AS cy, n FROM (SELECT unnest(range(min(cx), max(cx) + 1)) AS i FROM ({ST})) , (SELECT unnest(range(min(cy), max(cy) + 1)) AS j FROM ({ST}))
        LEFT JOIN (SELECT cx, cy, CAST(count(*) AS DOUBLE) AS n FROM ({ST}) GROUP BY 1, 2) c ON c.cx = i AND c.cy = j""",
    "n",
)(
    lambda s, d: grid.dense_grid(
        t.station_meta(s, d).groupBy(grid.cell_of(F.col("east"), X0, 100.0).alias("cx"), grid.cell_of(F.col("north"), Y0, 100.0).alias("cy"))
        .agg(F.count(F.lit(1)).cast("double").alias("n")), ["n"],
    )
)
query(
    "spatial_grid_id",
    "SELECT station, CAST(floor(east / 1000) AS BIGINT) AS grid_x, CAST(floor(north / 1000) AS BIGINT) AS grid_y FROM station_meta",
)(lambda s, d: grid.grid_id(t.station_meta(s, d), "east", "north", 1000.0).select("station", "grid_x", "grid_y"))
query("cell_mean", f"SELECT cx, cy, avg(height) AS height, count(height) AS n FROM ({ST}) JOIN station_meta USING (station) GROUP BY 1, 2", "height")(
    lambda s, d: grid.cell_mean(t.station_meta(s, d), "east", "north", X0, Y0, 100.0, "height")
)
query(
    "morans_i",
    """WITH z AS (SELECT cx, cy, elev - avg(elev) OVER () AS z FROM grid_static)
       SELECT (SELECT count(*) FROM z) AS n, count(*) AS w, (SELECT count(*) FROM z) / count(*) * sum(a.z * b.z) / (SELECT sum(z * z) FROM z) AS morans_i
       FROM z a JOIN z b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND NOT (a.cx = b.cx AND a.cy = b.cy)""",
    "morans_i",
)(lambda s, d: grid.morans_i(t.grid_static(s, d), "elev"))

PROD = """SELECT p_partkey % 50 AS cx, CAST(floor(p_partkey / 50) AS BIGINT) AS cy, CAST(m AS INT) AS month, p_retailprice / m AS product
    FROM part, range(1, 13) r(m)"""


def product(s, d):
    m = F.explode(F.sequence(F.lit(1), F.lit(12)))
    return t.table(s, d, "part").select(
        F.pmod("p_partkey", F.lit(50)).alias("cx"), F.floor(F.col("p_partkey") / 50).alias("cy"), m.alias("month"), "p_retailprice"
    ).select("cx", "cy", "month", (F.col("p_retailprice") / F.col("month")).alias("product"))


query(
    "product_compare",
    f"""SELECT s.station, c.month, c.EI_month, p.product FROM (SELECT station, CAST(month(DATE '2021-01-01' + CAST(doy - 1 AS INT)) AS INT) AS month,
        sum(EI_daily_avg) AS EI_month FROM station_curve GROUP BY 1, 2) c JOIN ({ST}) s USING (station) LEFT JOIN ({PROD}) p
        ON p.cx = s.cx AND p.cy = s.cy AND p.month = c.month""",
    "EI_month product",
)(
    lambda s, d: grid.product_compare(
        rain.monthly_ei(t.station_curve(s, d), ["station"]), t.station_meta(s, d), product(s, d), "station", "east", "north", X0, Y0, 100.0, "product"
    )
)
query(
    "majority_group",
    """SELECT s_suppkey AS poly, coalesce(grp, 0) AS majority FROM supplier JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem) ON k = s_suppkey LEFT JOIN
       (SELECT k, grp FROM (SELECT l_suppkey AS k, CAST(l_partkey % 6 AS INT) AS grp, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey % 6) AS rn
        FROM lineitem WHERE l_partkey % 6 <> 5 GROUP BY l_suppkey, l_partkey % 6) WHERE rn = 1) m ON m.k = s_suppkey""",
)(
    lambda s, d: stats.majority_group(
        t.table(s, d, "lineitem").select(
            F.col("l_suppkey").alias("poly"), F.when(F.pmod("l_partkey", F.lit(6)) != 5, F.pmod("l_partkey", F.lit(6)).cast("int")).alias("grp")
        ), ["poly"], "grp",
    )
)
query(
    "change_detect",
    """SELECT cx, cy, CAST(slope AS INT) % 5 AS label_a, CAST(elev AS INT) % 5 AS label_b,
       CASE WHEN CAST(slope AS INT) % 5 <> CAST(elev AS INT) % 5 THEN 1 ELSE 0 END AS changed FROM grid_static""",
)(
    lambda s, d: stats.change_detect(
        t.grid_static(s, d).select("cx", "cy", F.pmod(F.bround("slope").cast("int"), F.lit(5)).alias("g")),
        t.grid_static(s, d).select("cx", "cy", F.pmod(F.bround("elev").cast("int"), F.lit(5)).alias("g")), ["cx", "cy"], "g",
    )
)
