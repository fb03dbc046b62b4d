"""Collects (Spark query, SQL check) pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.catalog.tables import with_tables

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Entry] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double: the two engines add floats in different orders."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def query(
    name: str, sql: str | None = None, doubles: str = "", digits: int = 6, tables: dict[str, str] | None = None, settled: bool = False
):
    """Register a query; ``doubles`` names the columns the SQL side rounds. With ``settled`` the query has rounded its own."""

    def add(fn: QueryFn) -> QueryFn:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            body = sql
            if doubles:
                rep = ", ".join(f'round("{c}", {digits}) + 0.0::DOUBLE AS "{c}"' for c in doubles.split())
                body = f"SELECT * REPLACE ({rep}) FROM ({sql}) q"
            text = with_tables(body, tables)
        CATALOG[name] = Entry(fn if settled else lambda s, d: rounded(fn(s, d), digits), text)
        return fn

    return add
