"""What the corpus operators share.

A document is a row with ``doc_id`` and ``text``. Throughout this subpackage a
null text counts as the empty text, a null ``doc_id`` as smaller than any id,
and only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST = -(2**63)
#: ASCII white space, the only white space most of the operators know.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LOWEST))


def shown_id(c: Column) -> Column:
    """The id that ``key_id`` stands for."""
    return F.when(c != LOWEST, c)


def body(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that on pure ASCII, and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that reach Python together. The JVM and Python each hold a batch several times over, and 10,000 texts are some 50 MB.
TEXT_ROWS = 500


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Arrow batches of at most so many rows from here on, for plans that are run later. Results don't depend on it."""
    spark.conf.set(BATCH, min(rows, int(spark.conf.get(BATCH))))


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)
