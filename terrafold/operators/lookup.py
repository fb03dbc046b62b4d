"""Crop, management and reference lookups, and reshaping of wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import classes, text
from terrafold.plans.ordered import first_per_key


def code_filter(df: DataFrame, col: str, codes: list, keep: bool = True) -> DataFrame:
    cond = F.col(col).isin(*codes)
    return df.where(cond if keep else ~cond)


def code_filter_table(df: DataFrame, codes: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """The same with codes in a table, which may be large."""
    return df.join(codes.select(on).distinct(), on, "left_semi" if keep else "left_anti")


def relabel(df: DataFrame, col: str, mapping: dict, out: str, default: Column | None = None) -> DataFrame:
    """Map ids or category names to new names; unmapped keep ``default``."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    hit = F.try_element_at(F.create_map(*pairs), F.col(col))
    return df.withColumn(out, hit if default is None else F.coalesce(hit, default))


def melt(df: DataFrame, ids: list[str], pattern: str, value: str, key: str = "key", as_type: str = "int") -> DataFrame:
    """Wide columns matching ``pattern`` to rows; its first group is the key."""
    import re

    cols = [c for c in df.columns if re.match(pattern, c)]
    long = df.unpivot(ids, cols, "_name", value)
    return long.withColumn(key, F.regexp_extract("_name", pattern, 1).cast(as_type)).drop("_name")


def pivot_first(df: DataFrame, index: list[str], column: str, values: list, value: str) -> DataFrame:
    """Long to wide with given column values; smallest value on duplicates."""
    return df.groupBy(*index).pivot(column, values).agg(F.min(value))


# fixed values: the pattern of the area columns
def year_areas(df: DataFrame, key: str, years: list[int], pattern: str = r"^(\d{4})_Area_m") -> DataFrame:
    """Mean area over the chosen years' columns, square metres to hectares."""
    long = melt(df, [key], pattern, "_area", "_year")
    return long.where(F.col("_year").isin(*years)).groupBy(key).agg((F.avg("_area") / 1e4).alias("area_ha"))


def reference_bridge(labels: DataFrame, c_table: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Reference value per crop code: exact name, else normalised name; overrides win.

    Unresolved codes are dropped. Of several entries with one normalised name
    the alphabetically first counts.
    """
    ref = c_table.select("crop_name", "C_ref").where(F.col("C_ref").isNotNull() & F.col("crop_name").isNotNull())
    exact = ref.groupBy("crop_name").agg(F.min("C_ref").alias("_exact"))
    norm = first_per_key(
        ref.withColumn("_norm", text.crop_name_a(F.col("crop_name"))), ["_norm"], F.struct("crop_name", "C_ref")
    ).select("_norm", F.col("C_ref").alias("_fuzzy"))
    out = (
        labels.where(F.col("crop_name").isNotNull())
        .withColumn("_norm", text.crop_name_a(F.col("crop_name")))
        .join(exact, "crop_name", "left").join(norm, "_norm", "left")
        .withColumns({"_over": F.lit(None).cast("double"), "_name": F.lit(None).cast("string")})
    )
    if overrides is not None:
        ov = overrides.join(exact, "crop_name").select(
            "lnf_code", F.col("_exact").alias("_over"), F.col("crop_name").alias("_name")
        )
        out = out.drop("_over", "_name").join(ov, "lnf_code", "left")
    return (
        out.withColumn("C_ref", F.coalesce("_over", "_exact", "_fuzzy"))
        .withColumn("crop_name", F.coalesce("_name", "crop_name"))
        .where(F.col("C_ref").isNotNull())
        .drop("_over", "_exact", "_fuzzy", "_norm", "_name")
    )


def attach_reference(df: DataFrame, labels: DataFrame, c_table: DataFrame) -> DataFrame:
    """Code to normalised name to reference value, all rows kept."""
    ref = first_per_key(
        c_table.select("crop_name", "C_ref").withColumn("_norm", text.crop_name_b(F.col("crop_name"))),
        ["_norm"], F.struct("crop_name", "C_ref"),
    ).select("_norm", "C_ref")
    names = labels.select("lnf_code", text.crop_name_b(F.col("crop_name")).alias("_norm"))
    return df.join(names, "lnf_code", "left").join(ref, "_norm", "left").drop("_norm")


def management_table(c_table: DataFrame, total: str = "C_ref") -> DataFrame:
    """Wide region_tillage columns to rows of (name, region, tillage, value)."""
    cols = [c for c in c_table.columns if c.startswith(("Tal_", "Berg_"))]
    long = c_table.unpivot(["crop_name", total], cols, "_rt", "C_old_mgmt")
    return long.select(
        text.crop_name_b(F.col("crop_name")).alias("_norm"), F.col(total).alias("C_old_total"),
        F.split("_rt", "_")[0].alias("Region"), F.split("_rt", "_")[1].alias("Bodenbearbeitung"), "C_old_mgmt",
    )


def management_lookup(
    parcels: DataFrame, labels: DataFrame, c_table: DataFrame, c_new: DataFrame,
    tillage: str | None = "tillage", limit: float = 600.0, default_tillage: str = "Pflug",
) -> DataFrame:
    """Parcels with legacy values by (crop, region, tillage) and their new value."""
    till = F.lit(default_tillage) if tillage is None else F.coalesce(F.col(tillage), F.lit(default_tillage))
    p = parcels.withColumns({"Region": classes.region_class(F.col("elevation_m"), limit), "Bodenbearbeitung": till})
    names = labels.select("lnf_code", text.crop_name_b(F.col("crop_name")).alias("_norm"))
    p = p.join(names, "lnf_code", "left").join(
        management_table(c_table), ["_norm", "Region", "Bodenbearbeitung"], "left"
    )
    out = p.drop("_norm").join(c_new, ["lnf_code", "poly_id"], "inner")
    if "Jahr" in out.columns and "yr" in out.columns:
        out = out.where(F.col("Jahr") == F.col("yr"))
    return out


def export_join(df: DataFrame, export: DataFrame, cols: dict[str, str], on: list[str]) -> DataFrame:
    """Left-join another system's results by text keys; unchanged when columns are absent."""
    if set(cols) - set(export.columns):
        return df
    e = export.select(*[F.col(a).alias(b) for a, b in cols.items()])
    e = e.withColumns({k: F.col(k).cast("string") for k in on})
    return df.withColumns({k: F.col(k).cast("string") for k in on}).join(e, on, "left")


def calendar_join(parcels: DataFrame, calendar: DataFrame, activities: DataFrame, parcel_key: str, activity: str | None = None) -> DataFrame:
    """Parcels with their dated management actions, translated by the dictionary."""
    cal = calendar.join(activities, "massnahme", "left").withColumn("activity", F.coalesce("activity", "massnahme"))
    if activity is not None:
        cal = cal.where(F.col("activity") == activity)
    return parcels.join(cal, parcels[parcel_key] == cal["parzellen_id"], "inner").drop("parzellen_id")


def json_dictionary(df: DataFrame, col: str, key: str, value: str) -> DataFrame:
    """A JSON object of strings to a two-column lookup table."""
    m = F.from_json(F.col(col), "map<string,string>")
    return df.select(F.explode(m).alias(key, value))
