"""Readers and writers for delimited files and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.text import number
from terrafold.session import cut_lineage, scratch_path  # noqa: F401


def read_stations(
    spark: SparkSession, path: str, time: str = "time", value: str = "rre150z0", fmt: str = "yyyy-MM-dd HH:mm:ss", folder: bool = False
) -> DataFrame:
    """Many per-station CSV files as one table (station, time, value).

    Headers may differ between files, so columns are found by each file's own
    header line; files without the two columns are left out. The station is the
    last ``_`` token of the file name, or of the folder name with ``folder``.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"))
    )
    cells = raw.select("_file", F.transform(F.split("value", ","), lambda c: F.trim(F.translate(c, "\"'", ""))).alias("_c"))
    is_head = F.array_contains("_c", time)
    heads = cells.where(is_head & F.array_contains("_c", value)).groupBy("_file").agg(F.min("_c").alias("_h"))
    j = cells.where(~is_head).join(heads, "_file")
    at = lambda name: F.try_element_at("_c", F.array_position("_h", name).cast("int"))
    part = F.element_at(F.split("_file", "/"), -2 if folder else -1)
    station = F.regexp_replace(F.element_at(F.split(part, "_"), -1), r"\.csv$", "")
    return j.select(
        station.alias("station"), F.to_timestamp_ntz(at(time), F.lit(fmt)).alias("time"), number(at(value)).alias("rain")
    )


def read_delimited(
    spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1", columns: list[str] | None = None, numeric: list[str] | None = None
) -> DataFrame:
    """Delimited text with a header; chosen columns, non-numbers in numeric columns are null."""
    df = spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).csv(path)
    if columns:
        df = df.select(*columns)
    return df.withColumns({c: number(F.col(c)) for c in numeric or []})


#: Cells on each side of a block of the grid's layout.
GRID_BLOCK = 64
_BLOCK = ["block_x", "block_y"]


def _blocks(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({b: F.floor(F.col(c) / size).cast("int") for b, c in zip(_BLOCK, ("cx", "cy"))})


def write_grid(grid: DataFrame, path: str, size: int = GRID_BLOCK) -> None:
    """A grid table (cx, cy, any columns) laid out by blocks of size x size cells, one partition each."""
    write_partitioned(_blocks(grid, size), path, _BLOCK)


def read_grid_subset(grid: DataFrame, cells: DataFrame, columns: list[str], size: int = GRID_BLOCK) -> DataFrame:
    """Wanted columns of wanted cells (cx, cy) of a large grid table.

    Of a table written by ``write_grid`` with the same ``size``, only the blocks
    that hold a wanted cell are opened: the blocks wanted are written first, so
    their known size lets the planner broadcast them and prune the partitions
    with them. Other tables are scanned for their columns. Cells without
    coordinates are wanted by nobody.
    """
    cells = cells.select("cx", "cy").dropna().distinct()
    if set(_BLOCK) <= set(grid.columns):
        wanted = cut_lineage(_blocks(cells, size).select(*_BLOCK).distinct())
        # a filter on the blocks tells the planner that they are a selection
        wanted = wanted.where((F.abs("block_x") < 2**31 - 1) & (F.abs("block_y") < 2**31 - 1))
        grid = grid.join(wanted, _BLOCK, "left_semi")
    return grid.select(*columns).join(cells, ["cx", "cy"], "left_semi")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition columns, replacing only the partitions present in ``df``.

    Rows of a partition are brought together by size: small ones share a task,
    a large one is written by several.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
