"""Line dedup: lines that several documents hold stay only in the first of them."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import SPACE, ascii_lower, body, key_id
from terrafold.session import cut_lineage

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, key): the line keys that each document loses; ``key`` is the MD5 of the line's key."""
    lines = docs.select(key_id().alias("id"), F.explode(F.split(body(), "\n", -1)).alias("line"))
    keys = lines.select("id", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    # one row for each document and key, however often it repeats the line
    held = cut_lineage(keys.select("id", F.unhex(F.md5("k")).alias("key")).distinct())
    many = held.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # written, so that the join reads plain shuffles and a very common line can be split
    return held.join(cut_lineage(many.select("key", "first")), "key").where("id > first").select("id", "key")


OUT = T.StructType().add("n_lines", T.LongType()).add("n_dropped", T.LongType()).add("kept", T.StringType())


@F.pandas_udf(OUT)
def without_lines(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for text, drop in zip(texts, drops):
        lines = text.split("\n")
        if drop is None or not len(drop):
            out.append((len(lines), 0, text))
            continue
        gone = {bytes(k) for k in drop}
        kept = [x for x in lines if hashlib.md5(x.strip(SPACE).encode().lower()).digest() not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """row (all columns of ``docs``), n_lines, n_dropped, kept (the text that is left).

    Keys of at least ``min_chars`` code points that at least ``min_docs``
    documents hold lose all their lines except in the document of the smallest
    doc_id. Keys are counted through combinable aggregates on their hash; the
    lines to drop come back as one set of hashes per document, bounded by that
    document's own lines, and the text is put together again in its order.

    A null or empty text is one empty line, which is too short to be dropped. A
    null doc_id is the smallest id. Rows that share a doc_id are one document:
    a line is dropped from all of them or from none.
    """
    drops = shared_lines(docs, min_chars, min_docs).groupBy("id").agg(F.collect_set("key").alias("drops"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key_id().alias("id"), body().alias("text"))
    return rows.join(drops, "id", "left").select("row", without_lines("text", "drops").alias("out")).select("row", "out.*")
