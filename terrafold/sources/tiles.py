"""Tile manifests: extents from file names, selection, and time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_M = 1280


def tile_scan(files: DataFrame, col: str = "file", size: int = TILE_M) -> DataFrame:
    """Extent and year from names ``<sensor>_<minx>_<maxy>_<yyyy...>``."""
    p = F.split(col, "_")
    return files.withColumns(
        {
            "minx": p[1].cast("int"), "maxy": p[2].cast("int"), "maxx": p[1].cast("int") + size,
            "miny": p[2].cast("int") - size, "yr": F.substring(p[3], 1, 4).cast("int"),
        }
    )


def tile_select(tiles: DataFrame, minx: float, miny: float, maxx: float, maxy: float, years: list[int]) -> DataFrame:
    """Tiles that touch an area of interest in the given years."""
    return tiles.where(
        F.col("yr").isin(*years) & (F.col("minx") <= maxx) & (F.col("maxx") >= minx)
        & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
    )


def time_slice(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows of a closed date range; the end day counts whole."""
    return df.where(F.col(time).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def skip_done(inputs: DataFrame, outputs: DataFrame, on: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(outputs.select(on).distinct(), on, "left_anti")


def in_years(time: Column, years: list[int]) -> Column:
    return F.year(time).isin(*years)
