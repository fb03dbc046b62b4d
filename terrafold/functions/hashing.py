"""Repeatable randomness: numbers derived from row keys, not from a generator.

A retried task must redraw the same numbers, and a SQL engine must be able to
reproduce them, so draws are the leading 32 bits of an md5 of the key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_digest(*parts: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit_hash(*parts: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) fixed by ``parts`` and ``seed``."""
    lead = F.substring(key_digest(*parts, seed=seed), 1, 8)
    return F.conv(lead, 16, 10).cast("double") / F.lit(4294967296.0)


def row_salt(n: int, *cols: Column) -> Column:
    """Salt that spreads the rows of one hot key, fixed by other columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
