"""Masking, scene and field filters, classes and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.catalog import tables as t
from terrafold.catalog.registry import query
from terrafold.functions import classes, indices, text
from terrafold.functions import timeparts as tp
from terrafold.operators import cover, lookup, masks

BANDS = ["s2_B02", "s2_B03", "s2_B04", "s2_B08", "s2_B11", "s2_B12"]
SCENE = ["tile_minx", "tile_maxy", "time"]
DAY = "strftime(\"time\", '%Y-%m-%d') AS day"


def day(df):
    return df.withColumn("day", tp.iso_date(F.col("time"))).drop("time")


MASKED = """((s2_B02 = 65535 AND s2_B03 = 65535 AND s2_B04 = 65535 AND s2_B08 = 65535 AND s2_B11 = 65535 AND s2_B12 = 65535)
    OR s2_mask = 1 OR s2_SCL IN (8, 9, 10) OR s2_mask = 2 OR s2_SCL = 3 OR s2_mask = 3 OR s2_SCL = 11
    OR (s2_SCL = 10 AND s2_B02 > {c}))"""

query(
    "nodata_to_null",
    """SELECT field_id, count(*) AS n, count(nullif(s2_B02, 65535)) AS n_b02, CAST(sum(nullif(s2_B12, 65535)) AS BIGINT) AS sum_b12
       FROM s2_pixel GROUP BY 1""",
)(
    lambda s, d: masks.nodata_to_null(masks.drop_all_zero(t.s2_pixel(s, d), BANDS), BANDS).groupBy("field_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("s2_B02").alias("n_b02"), F.sum("s2_B12").alias("sum_b12")
    )
)
query(
    "scale_reflectance",
    "SELECT field_id, px, py, " + ", ".join(f"nullif({b}, 65535) / 10000 AS {b}" for b in BANDS) + " FROM s2_pixel",
    " ".join(BANDS),
)(
    lambda s, d: masks.scale_reflectance(masks.nodata_to_null(t.s2_pixel(s, d), BANDS), BANDS).select("field_id", "px", "py", *BANDS)
)
query(
    "pixel_mask", f"SELECT field_id, px, py, {DAY}, s2_mask, s2_SCL, s2_B02 FROM s2_pixel WHERE NOT {MASKED.format(c=1000)}"
)(lambda s, d: day(masks.pixel_mask(t.s2_pixel(s, d), BANDS, 1000).select("field_id", "px", "py", "time", "s2_mask", "s2_SCL", "s2_B02")))

QUAL = """SELECT tile_minx, tile_maxy, "time", count(*) AS n, count(*) FILTER (s2_mask <> 4) AS nv,
    count(*) FILTER (s2_mask = 1 OR s2_SCL IN (8, 9, 10)) AS nc, count(*) FILTER (s2_mask = 2 OR s2_SCL = 3) AS ns,
    count(*) FILTER (s2_mask = 3 OR s2_SCL = 11) AS nw,
    count(*) FILTER (s2_mask <> 4 AND (s2_B03 / 10000 - s2_B11 / 10000) / (s2_B03 / 10000 + s2_B11 / 10000) > 0.4) AS nd,
    count(*) FILTER (s2_mask <> 4 AND (s2_B03 / 10000 - s2_B11 / 10000) / (s2_B03 / 10000 + s2_B11 / 10000 + 1e-9) > 0.4) AS nde,
    avg(CASE WHEN s2_SCL = 10 THEN s2_B02 END) AS cb,
    """ + " OR ".join(f"count(*) FILTER ({b} = 65535) = count(*)" for b in BANDS) + " AS empty FROM s2_pixel GROUP BY ALL"


def scene_sql(base: str, snow: str, empty: bool) -> str:
    return f"""SELECT tile_minx, tile_maxy, field_id, px, py, {DAY}, s2_mask FROM s2_pixel SEMI JOIN
        (SELECT * FROM qual WHERE NOT (nc > 0.45 * {base} OR ns > 0.4 * {base} OR {snow} > 0.4 * {base}
         OR coalesce(cb > 8000, FALSE){" OR empty" if empty else ""})) USING (tile_minx, tile_maxy, "time")"""


def scenes(s, d, **kw):
    df = masks.scene_filter(
        t.s2_pixel(s, d), SCENE, BANDS, cloud_max=0.45, shadow_max=0.4, snow_max=0.4, cirrus_max=8000, **kw
    )
    return day(df.select(*SCENE, "field_id", "px", "py", "s2_mask"))


query("scene_filter", scene_sql("n", "nw", True), tables={"qual": QUAL})(lambda s, d: scenes(s, d))
query("scene_filter_valid_only", scene_sql("nv", "nd", True), tables={"qual": QUAL})(lambda s, d: scenes(s, d, valid_only=True))
query("scene_filter_guarded", scene_sql("greatest(nv, 1)", "nde", False), tables={"qual": QUAL})(
    lambda s, d: scenes(s, d, valid_only=True, guarded=True)
)

FDATE = f"""SELECT field_id, px, py, "time", {MASKED.format(c=500)} AS masked,
    avg(CASE WHEN {MASKED.format(c=500)} THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY field_id, "time") AS share FROM s2_pixel"""


def field_dates(s, d):
    return masks.field_date_filter(t.s2_pixel(s, d), ["field_id", "time"], masks.masked(BANDS, 500), 0.5)


query("field_date_filter", f"SELECT field_id, px, py, {DAY} FROM fdate WHERE share <= 0.5", tables={"fdate": FDATE})(
    lambda s, d: day(field_dates(s, d).select("field_id", "px", "py", "time"))
)
query(
    "field_keep",
    f"""SELECT field_id, px, py, {DAY} FROM fdate WHERE share <= 0.5 AND field_id IN
        (SELECT field_id FROM fdate GROUP BY 1 HAVING 1 - count(*) FILTER (share <= 0.5) / count(*) <= 0.973)""",
    tables={"fdate": FDATE},
)(lambda s, d: day(masks.field_keep(t.s2_pixel(s, d), field_dates(s, d), ["field_id"], 0.973).select("field_id", "px", "py", "time")))
query(
    "semi_by_key",
    f"""SELECT field_id, px, py, product_uri FROM s2_pixel WHERE product_uri IN
        (SELECT product_uri FROM s2_pixel WHERE NOT {MASKED.format(c=1000)})""",
)(
    lambda s, d: masks.semi_by_key(t.s2_pixel(s, d), masks.pixel_mask(t.s2_pixel(s, d), BANDS), ["product_uri"])
    .select("field_id", "px", "py", "product_uri")
)
query(
    "field_mean_series",
    f"""SELECT field_id, {DAY}, count(*) AS n_raw, avg(s2_B08) AS s2_B08_raw,
        count(*) FILTER (NOT m) AS n_clean, avg(s2_B08) FILTER (NOT m) AS s2_B08_clean
        FROM (SELECT *, {MASKED.format(c=1000)} AS m FROM s2_pixel) GROUP BY ALL""",
    "s2_B08_raw s2_B08_clean",
)(
    lambda s, d: day(cover.field_mean_series(
        t.s2_pixel(s, d), masks.pixel_mask(t.s2_pixel(s, d), BANDS), ["field_id", "time"], ["s2_B08"]
    ))
)
query(
    "mosaic_merge",
    """WITH p AS (SELECT l_suppkey AS tile, CAST(year(l_shipdate) AS INT) AS t, l_partkey AS cell,
           CASE WHEN l_partkey % 7 = 0 THEN 65535 ELSE CAST(l_quantity AS INT) END AS v FROM lineitem)
       SELECT s.tile, s.t, c.cell, coalesce(m.v, 65535) AS v FROM (SELECT DISTINCT tile, t FROM p) s
       JOIN (SELECT DISTINCT tile, cell FROM p) c ON s.tile = c.tile
       LEFT JOIN (SELECT tile, t, cell, min(nullif(v, 65535)) AS v FROM p GROUP BY ALL) m
       ON m.tile = s.tile AND m.t = s.t AND m.cell = c.cell""",
)(
    lambda s, d: masks.mosaic_merge(
        t.table(s, d, "lineitem").select(
            F.col("l_suppkey").alias("tile"), F.year("l_shipdate").alias("t"), F.col("l_partkey").alias("cell"),
            F.when(F.pmod("l_partkey", F.lit(7)) == 0, 65535).otherwise(F.col("l_quantity").cast("int")).alias("v"),
        ),
        ["t"], ["cell"], ["tile"], ["v"],
    )
)
query(
    "product_id_fields",
    """SELECT product_uri, CAST(CAST(strptime(substr(split_part(product_uri, '_', 3), 1, 8), '%Y%m%d') AS DATE) AS VARCHAR) AS day,
       split_part(product_uri, '_', 6) AS tile_id, split_part(split_part(product_uri, '_', -1), '.', 1) AS granule_id FROM s2_pixel""",
)(
    lambda s, d: t.s2_pixel(s, d).select(
        "product_uri", F.date_format(text.product_date(F.col("product_uri")), "yyyy-MM-dd").alias("day"),
        text.product_tile(F.col("product_uri")).alias("tile_id"), text.product_granule(F.col("product_uri")).alias("granule_id"),
    )
)
query(
    "time_slice",
    """SELECT field_id, px, py, product_uri FROM s2_pixel WHERE "time" BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'""",
)(
    lambda s, d: __import__("terrafold.sources.tiles", fromlist=["x"]).time_slice(t.s2_pixel(s, d), "time", "1996-03-01", "1998-06-30")
    .select("field_id", "px", "py", "product_uri")
)
FLAGS = """SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN npv > pv AND npv > soil THEN 1 ELSE 0 END AS nd,
    CASE WHEN pv IS NULL THEN NULL WHEN soil > pv AND soil > npv THEN 1 ELSE 0 END AS sd FROM fc_norm"""


def norm(s, d):
    return cover.normalize_fractions(t.fc_raw(s, d), ["pv", "npv", "soil"], "")


query(
    "dominant_class",
    """SELECT poly_id, yr, count(nd) AS n, CAST(sum(nd) AS BIGINT) AS npv_dominant, CAST(sum(sd) AS BIGINT) AS soil_dominant,
       CAST(sum(CASE WHEN npv > 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS npv_over, CAST(sum(CASE WHEN soil > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS soil_over
       FROM flags GROUP BY 1, 2""",
    tables={"flags": FLAGS},
)(
    lambda s, d: cover.dominant_class(
        cover.dominant_class(norm(s, d), "pv", "npv", "soil", "a"), "pv", "npv", "soil", "b", soil_threshold=0.5, npv_threshold=0.4
    ).groupBy("poly_id", "yr").agg(
        F.count("npv_dominant_a").alias("n"), F.sum("npv_dominant_a").alias("npv_dominant"), F.sum("soil_dominant_a").alias("soil_dominant"),
        F.coalesce(F.sum("npv_dominant_b"), F.lit(0)).alias("npv_over"), F.coalesce(F.sum("soil_dominant_b"), F.lit(0)).alias("soil_over"),
    )
)
query(
    "drop_border_rows",
    "SELECT poly_id, count(*) AS n FROM fc_norm WHERE pv IS NOT NULL AND npv IS NOT NULL AND soil IS NOT NULL AND NOT (pv = 0 AND npv = 0 AND soil = 0) GROUP BY 1",
)(lambda s, d: cover.drop_border_rows(norm(s, d), ["pv", "npv", "soil"]).groupBy("poly_id").agg(F.count(F.lit(1)).alias("n")))
query(
    "combine_models",
    """SELECT g.l_orderkey, g.l_partkey, g.d AS day, g.v AS pv_global, q.v AS pv_soil FROM
       (SELECT l_orderkey, l_partkey, l_shipdate::DATE::VARCHAR AS d, max(l_discount) AS v FROM lineitem GROUP BY ALL) g LEFT JOIN
       (SELECT l_orderkey, l_partkey, l_shipdate::DATE::VARCHAR AS d, max(l_tax) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) q
       ON g.l_orderkey = q.l_orderkey AND g.l_partkey = q.l_partkey AND g.d = q.d""",
    "pv_global pv_soil",
)(lambda s, d: _models(s, d))


def _models(s, d):
    li = t.table(s, d, "lineitem").withColumn("day", tp.iso_date(F.col("l_shipdate")))
    k = ["l_orderkey", "l_partkey", "day"]
    g = li.groupBy(*k).agg(F.max("l_discount").alias("pv"))
    q = li.where(F.col("l_returnflag") != "R").groupBy(*k).agg(F.max("l_tax").alias("pv"))
    return cover.combine_models(g, q, k, ["pv"])


query(
    "pixel_week_stats",
    """SELECT x, y, CAST(week("time") AS INT) AS week, avg(pv) AS pv_mean, stddev_pop(pv) AS pv_std, count(pv) AS pv_count,
       avg(soil) AS soil_mean, stddev_pop(soil) AS soil_std, count(soil) AS soil_count FROM fc_norm GROUP BY 1, 2, 3""",
    "pv_mean pv_std soil_mean soil_std", digits=9,
)(lambda s, d: cover.pixel_period_stats(norm(s, d).withColumn("week", F.weekofyear("time")), ["x", "y", "week"], ["pv", "soil"]))
query(
    "hex_mean",
    """WITH p AS (SELECT pv / 0.1 AS sx, npv / (0.1 * 3 ** 0.5) AS sy, soil FROM fc_norm WHERE pv IS NOT NULL AND npv IS NOT NULL),
       h AS (SELECT *, (sx - round_even(sx, 0)) ** 2 + 3 * (sy - round_even(sy, 0)) ** 2 <
         (sx - floor(sx) - 0.5) ** 2 + 3 * (sy - floor(sy) - 0.5) ** 2 AS f FROM p)
       SELECT CASE WHEN f THEN round_even(sx, 0) ELSE floor(sx) + 0.5 END * 0.1 AS hex_x,
         CASE WHEN f THEN round_even(sy, 0) ELSE floor(sy) + 0.5 END * (0.1 * 3 ** 0.5) AS hex_y, avg(soil) AS mean, count(soil) AS n
       FROM h GROUP BY 1, 2""",
    "hex_x hex_y mean",
)(lambda s, d: cover.hex_mean(norm(s, d), "pv", "npv", "soil", 0.1))

query(
    "code_filter", "SELECT * FROM parcel WHERE lnf_code IN (1, 4, 9, 16) AND Gemeinde NOT IN (2, 3)",
    "elevation_m Flaeche er_pot p_factor",
)(lambda s, d: lookup.code_filter(lookup.code_filter(t.parcel(s, d), "lnf_code", [1, 4, 9, 16]), "Gemeinde", [2, 3], keep=False))
query(
    "relabel",
    "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'cereal' WHEN 1 THEN 'cereal' WHEN 2 THEN 'maize' ELSE n_name END AS crop FROM nation",
)(
    lambda s, d: lookup.relabel(
        t.table(s, d, "nation"), "n_regionkey", {0: "cereal", 1: "cereal", 2: "maize"}, "crop", F.col("n_name")
    ).select("n_nationkey", "crop")
)
query(
    "bin_cut",
    """SELECT poly_id, CASE WHEN Flaeche >= 0 AND Flaeche <= 5000 THEN '<0.5ha' WHEN Flaeche <= 10000 THEN '0.5–1ha'
       WHEN Flaeche <= 30000 THEN '1–3ha' WHEN Flaeche <= 100000 THEN '3–10ha' WHEN Flaeche > 100000 THEN '>10ha' END AS size_class,
       CASE WHEN er_pot > -0.001 AND er_pot <= 0.25 THEN 'low' WHEN er_pot > 0.25 AND er_pot <= 2 THEN 'medium'
       WHEN er_pot > 2 AND er_pot <= 8 THEN 'high' WHEN er_pot > 8 AND er_pot <= 20 THEN 'very_high' WHEN er_pot > 20 THEN 'extreme' END AS risk
       FROM parcel""",
)(
    lambda s, d: t.parcel(s, d).select(
        "poly_id", classes.bin_cut(F.col("Flaeche"), classes.SIZE_BINS, classes.SIZE_LABELS, True).alias("size_class"),
        classes.bin_cut(F.col("er_pot"), classes.RISK_BINS, classes.RISK_LABELS).alias("risk"),
    )
)
query(
    "terrain_class",
    """SELECT cx, cy, CASE WHEN e < 600 AND slope < 5 THEN 'valley' WHEN e < 600 THEN 'plateau' WHEN e < 1500 AND slope < 15 THEN 'hill'
       WHEN e < 1500 THEN 'steep_hill' WHEN e < 2200 THEN 'mountain' ELSE 'alpine' END AS terrain
       FROM (SELECT *, (elev - 1300) * 8 AS e FROM grid_static)""",
)(lambda s, d: t.grid_static(s, d).select("cx", "cy", classes.terrain_class((F.col("elev") - 1300) * 8, F.col("slope")).alias("terrain")))
query(
    "region_class",
    """SELECT poly_id, CASE WHEN elevation_m > 600 THEN 'Berg' ELSE 'Tal' END AS region, coalesce(tillage, 'Pflug') AS tillage FROM parcel""",
)(
    lambda s, d: t.parcel(s, d).select(
        "poly_id", classes.region_class(F.col("elevation_m")).alias("region"), F.coalesce("tillage", F.lit("Pflug")).alias("tillage")
    )
)
query(
    "crop_names",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[(){}\[\],;:.\-/]', ' ', 'g'), '\s+', ' ', 'g')) AS name_a
       FROM documents""",
)(lambda s, d: t.table(s, d, "documents").select("doc_id", text.crop_name_a(F.col("text")).alias("name_a")))
query(
    "crop_names_plain",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), '{text.ACCENTED}', '{text.BASE}'),
       '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name_b FROM documents""",
)(lambda s, d: t.table(s, d, "documents").select("doc_id", text.crop_name_b(F.col("text")).alias("name_b")))
query(
    "melt",
    """SELECT crop_name, split_part(k, '_', 1) AS region, split_part(k, '_', 2) AS tillage, v AS C_old_mgmt
       FROM (UNPIVOT c_table ON Tal_Pflug, Tal_Mulch, Berg_Pflug, Berg_Mulch INTO NAME k VALUE v)""",
    "C_old_mgmt",
)(
    lambda s, d: lookup.melt(t.c_table(s, d), ["crop_name"], r"^((?:Tal|Berg)_(?:Pflug|Mulch))$", "C_old_mgmt", "k", "string")
    .select("crop_name", F.split("k", "_")[0].alias("region"), F.split("k", "_")[1].alias("tillage"), "C_old_mgmt")
)
query(
    "pivot",
    "SELECT Gemeinde, " + ", ".join(f"min(CASE WHEN tillage = '{v}' THEN Flaeche END) AS \"{v}\"" for v in ("Mulch", "Pflug"))
    + " FROM parcel GROUP BY 1", "Mulch Pflug",
)(lambda s, d: lookup.pivot_first(t.parcel(s, d), ["Gemeinde"], "tillage", ["Mulch", "Pflug"], "Flaeche"))
query(
    "year_areas",
    """SELECT lnf_code, avg(v) / 1e4 AS area_ha FROM (UNPIVOT lnf_label ON "2021_Area_m22", "2022_Area_m23" INTO NAME k VALUE v) GROUP BY 1""",
    "area_ha", digits=9,
)(lambda s, d: lookup.year_areas(t.lnf_label(s, d), "lnf_code", [2021, 2022]))
query(
    "spectral_indices",
    """SELECT field_id, px, py, (b8 - b4) / nullif(b8 + b4, 0) AS ndvi, b12 / nullif(b11, 0) AS swir_ratio,
       (b3 - b11) / nullif(b3 + b11, 0) AS ndsi FROM (SELECT field_id, px, py, nullif(s2_B03, 65535) b3, nullif(s2_B04, 65535) b4,
       nullif(s2_B08, 65535) b8, nullif(s2_B11, 65535) b11, nullif(s2_B12, 65535) b12 FROM s2_pixel)""",
    "ndvi swir_ratio ndsi", digits=9,
)(
    lambda s, d: __import__("terrafold.functions.indices", fromlist=["x"]).with_indices(masks.nodata_to_null(t.s2_pixel(s, d), BANDS))
    .select("field_id", "px", "py", "ndvi", "swir_ratio", "ndsi")
)
query(
    "scalar_functions",
    """SELECT o_orderkey, exp(-0.05 * v / 1e4) AS slr, sin(2 * pi() * doy / 365) AS doy_sin, cos(2 * pi() * doy / 365) AS doy_cos,
       sin(radians(o_custkey % 360)) AS asp_sin, cos(radians(o_custkey % 360)) AS asp_cos, ln(1 + v) AS log_ei,
       exp(ln(1 + v)) - 1 AS back, CAST(floor(o_custkey / 10) * 10 AS BIGINT) AS dn, CAST(ceil(o_custkey / 10) * 10 AS BIGINT) AS up,
       CAST(round_even(o_custkey / 10, 0) * 10 AS BIGINT) AS near,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS star
       FROM (SELECT *, o_totalprice AS v, dayofyear(o_orderdate) AS doy, o_totalprice / 5e6 AS p FROM orders)""",
    "slr doy_sin doy_cos asp_sin asp_cos log_ei back", digits=5,
)(
    lambda s, d: __import__("terrafold.functions.indices", fromlist=["x"]).scalar_demo(t.table(s, d, "orders"))
)
query(
    "derived_features",
    """SELECT o_orderkey, o_totalprice AS elev, sin(radians(o_custkey % 360)) AS aspect_sin, cos(radians(o_custkey % 360)) AS aspect_cos,
       sin(2 * pi() * dayofyear(o_orderdate) / 365) AS doy_sin, cos(2 * pi() * dayofyear(o_orderdate) / 365) AS doy_cos FROM orders""",
    "elev aspect_sin aspect_cos doy_sin doy_cos",
)(
    lambda s, d: indices.with_derived(
        t.table(s, d, "orders").select(
            "o_orderkey", F.col("o_totalprice").alias("elev"), F.pmod("o_custkey", F.lit(360)).alias("aspect"), F.dayofyear("o_orderdate").alias("doy")
        ),
        ["o_orderkey"], ["elev", "aspect", "doy", "aspect"],
    )
)
query(
    "date_parts",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(dayofyear(l_shipdate), 365) AS INT) AS doy365,
       CAST(month(DATE '2021-01-01' + CAST(least(dayofyear(l_shipdate), 365) - 1 AS INT)) AS INT) AS doy_month,
       strftime(strptime(strftime(l_shipdate, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M'), '%Y-%m-%d %H:%M') AS parsed FROM lineitem""",
)(
    lambda s, d: t.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tp.doy365(F.col("l_shipdate")).alias("doy365"),
        tp.month_of_doy(tp.doy365(F.col("l_shipdate"))).alias("doy_month"),
        tp.iso_minute(
            F.to_timestamp_ntz(F.date_format("l_shipdate", "dd.MM.yyyy HH:mm"), F.lit("dd.MM.yyyy HH:mm"))
        ).alias("parsed"),
    )
)
