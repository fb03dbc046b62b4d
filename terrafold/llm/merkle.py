"""Merkle manifest of a dataset: a tree of eights per key, the keys' roots in a tree of their own.

Rows are ranked within their key by ranges, so a key may hold any share of the
rows. A rank's base-8 digits are then grouped away one after the other inside
blocks of 8^3 ranks: each step nests the structs below it and hashes their
hashes. The blocks' hashes are the leaves of the next round, until each key has
one. On the way down, each block's nested struct is unfolded by ``transform`` and
``explode``, which see a node's siblings beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrafold.llm.common import ascii_lower, key_id, shown_id
from terrafold.session import cut_lineage

FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Left and right siblings of a node, their digests put together.
SIDES = T.ArrayType(T.StructType().add("left", T.StringType()).add("right", T.StringType()))
_ROW_BITS = 33  # monotonically_increasing_id holds the partition above these


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of the values, each with its UTF-8 byte count, ``-`` for a null."""
    told = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told])


def _ordered_key(c: Column) -> Column:
    """Sorts nulls first, then by bytes; never null itself."""
    return F.struct(c.isNotNull().alias("has"), F.coalesce(c.cast("string"), F.lit("")).alias("value"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``key``) and rank (from 0 within the key by ``order``), n (rows of the key).

    Rows are written in ranges of (key, order); a row's place in its range less
    the place where its key begins there, plus the key's rows in the ranges
    before, is its rank. What is summed has one row for each key in each range.
    """
    at = F.monotonically_increasing_id()
    placed = cut_lineage(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("_at", at))
    part, place = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    starts = placed.groupBy("key", part.alias("part")).agg(F.min(place).alias("start"), F.count("*").alias("c"))
    whole = Window.partitionBy("key")
    before = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    starts = cut_lineage(starts.select("key", "part", (before - F.col("start")).alias("shift"), F.sum("c").over(whole).alias("n")))
    out = placed.withColumn("part", part).join(starts, ["key", "part"])
    return out.withColumn("rank", place + F.col("shift")).drop("_at", "part", "shift")


def _hashes(kids: Column) -> Column:
    return F.transform(kids, lambda k: k["hash"])


def _blocks(nodes: DataFrame, load: list[str]) -> DataFrame:
    """(key, n, block, hash, kids) from (key, n, rank, hash, *load): nested structs of up to BLOCK ranks.

    One shuffle by (key, block) serves all groupings, which have more keys. A
    level that would have a single node to begin with doesn't exist: the node
    passes through.
    """
    digit = [F.expr(f"(rank div {FAN**i}) % {FAN}").cast("int").alias(f"d{i}") for i in range(DIGITS)]
    here = nodes.select("key", "n", F.expr(f"rank div {BLOCK}").alias("block"), *digit, "hash", *load).repartition("key", "block")
    inner = ["hash", *load]
    for i in range(DIGITS):
        keys = ["key", "n", "block", *[f"d{j}" for j in range(i + 1, DIGITS)]]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), *inner)))
        here = here.groupBy(*keys).agg(kids.alias("kids"))
        made = F.sha2(F.array_join(_hashes(F.col("kids")), ""), 256)
        here = here.withColumn("hash", F.when(F.col("n") > FAN**i, made).otherwise(F.col("kids")[0]["hash"]))
        inner = ["hash", "kids"]
    return here


def _rounds(leaves: DataFrame, load: list[str]) -> list[DataFrame]:
    """Written blocks, the leaves' first; the last round has one block a key, whose hash is the key's root."""
    out, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        out.append(cut_lineage(_blocks(nodes, load)))
        if most <= BLOCK:
            return out
        most, load = -(-most // BLOCK), []
        nodes = out[-1].select("key", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "hash")


def _unfolded(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, rest, node) for each leaf; ``tops`` has (key, rest), and rest.proof gains the siblings of all levels, the leaf's own first.

    Blocks and what lies above them meet by grouping on their common key.
    """
    above = tops.select("key", F.lit(0).cast("long").alias("block"), "rest")
    kind = tops.schema["rest"].dataType
    others = [f.name for f in kind if f.name != "proof"]
    for blocks in reversed(rounds):
        tree = F.struct("n", "kids")
        tree_kind = blocks.select(tree.alias("t")).schema["t"].dataType
        both = blocks.select("key", "block", tree.alias("tree"), F.lit(None).cast(kind).alias("rest"))
        both = both.union(above.select("key", "block", F.lit(None).cast(tree_kind), "rest"))
        met = both.groupBy("key", "block").agg(F.any_value("tree", True).alias("tree"), F.any_value("rest", True).alias("rest"))
        here = met.select("key", F.col("tree.n").alias("n"), "block", F.col("tree.kids").alias("kids"), "rest")
        for i in reversed(range(DIGITS)):
            kids, hashes = F.col("kids"), _hashes(F.col("kids"))
            told = F.transform(
                kids,
                lambda k, j: F.struct(
                    k.alias("node"),
                    F.array_join(F.slice(hashes, F.lit(1), j), "").alias("left"),
                    F.array_join(F.slice(hashes, j + 2, F.lit(FAN)), "").alias("right"),
                ),
            )
            here = here.select("key", "n", "block", "rest", F.explode(told).alias("k"))
            level = F.when(F.col("n") > FAN**i, F.array(F.struct("k.left", "k.right"))).otherwise(F.array().cast(SIDES))
            rest = F.struct(F.concat(level, F.col("rest.proof")).alias("proof"), *[F.col(f"rest.{c}").alias(c) for c in others])
            down = [F.col("k.node.kids").alias("kids")] if i else [F.col("k.node").alias("node")]
            here = here.select("key", "n", (F.col("block") * FAN + F.col("k.node.d")).alias("block"), rest.alias("rest"), *down)
        above = here
    return above.select("key", "rest", "node")


def folded(start: Column, proof: Column) -> Column:
    """Root that follows from a leaf and its siblings."""
    return F.aggregate(proof, start, lambda acc, p: digest(p["left"], acc, p["right"]))


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "lang", order: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """One row for each row: id, leaf, subroot, root, proof (siblings from the leaf up to the root), changed.

    Leaves hash ``fields`` and ascend by ``order``, an integer column, within ``key``; each
    eight in a row become a node until one is left, the key's subroot. The
    subroots, nulls first and then bytewise, likewise give the root. ``tampered``
    is an optional leaf to be checked in place of the true one; it comes back as
    ``changed``.

    A null in any field hashes as such; null keys are a key of their own, a null
    order value is the smallest. Rows that share key and order value follow each
    other by leaf, so equal rows take neighbouring places; columns other than
    ``fields`` have no influence. An empty table gives an empty table, a single
    row is its own root. Texts are read once and never shuffled; what moves has
    a fixed size per row.
    """
    own = tampered if tampered is not None else F.lit(None)
    leaves = rows.select(
        _ordered_key(F.col(key)).alias("key"), key_id(order).alias("id"), leaf([F.col(c) for c in fields]).alias("hash"),
        own.cast("string").alias("changed"),
    )
    leaves = ranked(cut_lineage(leaves), ["id", "hash"])
    rounds = _rounds(leaves, ["id", "changed"])
    subroots = rounds[-1].select(F.lit(0).alias("key"), F.col("key").alias("of"), "hash")
    upper = _rounds(ranked(subroots, ["of"]), ["of"])
    nothing = F.array().cast(SIDES).alias("proof")
    roots = upper[-1].select("key", F.struct(nothing, F.col("hash").alias("root")).alias("rest"))
    tops = _unfolded(upper, roots).select(
        F.col("node.of").alias("key"), F.struct("rest.proof", "rest.root", F.col("node.hash").alias("subroot")).alias("rest")
    )
    return _unfolded(rounds, cut_lineage(tops)).select(
        "node.id", F.col("node.hash").alias("leaf"), "rest.subroot", "rest.root", "rest.proof", "node.changed"
    )


def lower_cased(rows: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", text: str = "text", one_in: int = 3) -> Column:
    """Leaf of the row with A-Z of its text in lower case where ``one_in`` divides the id's checksum, else null."""
    chosen = F.crc32(F.col(order).cast("string")) % one_in == 0
    return F.when(chosen, leaf([ascii_lower(F.col(c)) if c == text else F.col(c) for c in fields]))


def verified(rows: DataFrame) -> DataFrame:
    """The manifest with every proof folded from the tampered leaf, or else from the leaf itself."""
    out = manifest(rows, tampered=lower_cased(rows))
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), "")
    out = out.select(
        shown_id(F.col("id")).alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
