"""Exact duplicates by progressive refinement: length, then prefix, then everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import body, key_id, shown_id
from terrafold.session import cut_lineage

#: Code points that the second round looks at.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def duplicate_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Groups of at least two rows with equal normalised texts.

    Returns text_sha256, keep_id (smallest doc_id), group_size (rows). Each
    round hashes only what the round before left in a group of two or more,
    and only short keys are shuffled until the last round: the texts that reach
    it are those whose length and prefix another row shares. All three rounds
    are combinable counts, so a group of any size is fine.

    Null and empty texts are equal to each other; a null doc_id is smaller than
    any other id; an empty table gives an empty table. Repeated rows count as
    often as they occur.
    """
    norm = normalised(body())
    rows = docs.select(key_id().alias("id"), body().alias("text"), norm.alias("norm"))
    short = rows.select(F.char_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head"))

    # counted by both first, so that a common length is no hot key
    per = cut_lineage(short.groupBy("len", "head").agg(F.count("*").alias("n")))
    lengths = cut_lineage(per.groupBy("len").agg(F.sum("n").alias("rows")).where("rows > 1").select("len"))
    # written, so that measured sizes decide how rows are matched, and a hot key can be split
    heads = cut_lineage(per.where("n > 1").join(lengths, "len", "left_semi").select("len", "head"))
    left = rows.select(
        "id", "text", F.char_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")
    ).join(heads, ["len", "head"], "left_semi")
    full = left.select("id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    groups = full.groupBy("text_sha256").agg(F.min("id").alias("keep"), F.count("*").alias("group_size"))
    return cut_lineage(groups.where("group_size > 1").select("text_sha256", "keep", "group_size"))


def exact_dedup(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Verdict on every row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows of one doc_id and one text share the verdict: all of them are kept if
    theirs is the smallest id. See ``duplicate_groups`` for nulls and ties.
    """
    rows = docs.select(key_id().alias("id"), F.sha2(normalised(body()), 256).alias("text_sha256"))
    keep = F.coalesce("keep", "id")
    return rows.join(duplicate_groups(docs, prefix), "text_sha256", "left").select(
        shown_id(F.col("id")).alias("doc_id"),
        shown_id(keep).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (keep == F.col("id")).alias("kept"),
        "text_sha256",
    )
