"""Near duplicates by SimHash, matched through an index of fingerprint bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import body, key_id
from terrafold.llm.graph import components
from terrafold.session import cut_lineage

WORDS = 3
SEED = 42
#: Bits that linked fingerprints may differ in; they spoil at most as many of the eight bytes.
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS


def simhash(text: str) -> int:
    """Signed 64-bit SimHash of a text's word shingles; 0 without words."""
    words = text.encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # a slice at a time: 64 bytes a shingle
        bits += np.unpackbits(h[i : i + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n).view(np.dtype(">i8"))[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def _byte_mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _signed(bit: int) -> int:
    return -(1 << 63) if bit == 63 else 1 << bit


def _postings(fp: Column) -> Column:
    """The fingerprint's index entries: each choice of MIN_BYTES positions with their bytes."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(_byte_mask(c))).alias("bytes"))
            for i, c in enumerate(combinations(range(8), MIN_BYTES))
        ]
    )


def _neighbours(choice: Column, fp: Column) -> Column:
    """The fingerprint, and it with one of the bits outside the choice's bytes turned over."""
    free = [
        F.array(*[F.lit(0).cast("long"), *[F.lit(_signed(8 * p + b)) for p in range(8) if p not in c for b in range(8)]])
        for c in combinations(range(8), MIN_BYTES)
    ]
    return F.transform(F.element_at(F.array(*free), choice + 1), lambda m: fp.bitwiseXOR(m))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes agree."""
    x = a.bitwiseXOR(b)
    return sum((x.bitwiseAND(F.lit(_byte_mask((p,)))) == 0).cast("int") for p in range(8))


def links(nodes: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (node, fp) of at most MAX_BITS differing bits.

    Two such fingerprints agree in at least MIN_BYTES of their eight positional
    bytes, so some choice of MIN_BYTES positions has equal bytes in both. A
    posting list of a single position would hold one 256th of the corpus, so
    lists are kept for whole choices: a pair's tally over single positions is
    MIN_BYTES or more exactly if it meets in such a list. A list holds distinct
    fingerprints that differ in the two other bytes, so never more than 2^16.

    Pairs inside a list are not enumerated. Each member is entered at itself
    and at the 16 values one bit away; members that meet at a value are within
    two bits of each other, and any two that are within two bits meet. At most
    65 fingerprints meet at one value, and each is paired with the smallest of
    them: 64 pairs in place of 2080, and the same components. Tally and
    distance of each pair are then checked.
    """
    entry = F.struct("node", "fp")
    lists = (
        nodes.select(entry.alias("m"), F.explode(_postings(F.col("fp"))).alias("p"))
        .groupBy("p.choice", "p.bytes").agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)
    )
    at = lists.select("choice", F.explode("members").alias("m")).select(
        "m", F.explode(_neighbours(F.col("choice"), F.col("m.fp"))).alias("value")
    )
    meet = at.groupBy("value").agg(F.collect_set("m").alias("members")).where(F.size("members") > 1)
    pairs = meet.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("b.node <> a.node")
    pairs = pairs.select("a", "b").distinct()
    tally = pairs.where(shared_bytes(F.col("a.fp"), F.col("b.fp")) >= MIN_BYTES)
    near = tally.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
    return near.select(F.col("b.node").alias("src"), F.col("a.node").alias("dst"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed 64-bit), component.

    Documents whose fingerprints differ in at most two bits are linked;
    ``component`` is the smallest id reachable, a null doc_id counting as the
    smallest. Copies share a fingerprint and are one node of the graph, so a
    large group of copies costs one row. Texts without words have the
    fingerprint zero, which is linked like any other. Rows that share a doc_id
    but not a text are separate rows with their own components.
    """
    prints = cut_lineage(docs.select(key_id().alias("id"), simhash_udf(body()).alias("fp")))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("id")).select(F.col("id"), "fp"))
    # a doc_id with several texts has several fingerprints, so nodes are told apart by fp as well
    nodes = nodes.select(F.struct("id", "fp").alias("node"), "fp")
    found = components(links(nodes))
    labels = nodes.join(found, nodes.node == found.member, "left").select(
        "fp", F.coalesce("root.id", "node.id").alias("component")
    )
    return prints.join(labels, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
