"""Links inside candidate groups of any size, without all pairs of a group.

Candidates come as groups: nodes that share a key of a sketch. Many groups hold
the same nodes and some hold very many, so groups are worked through in two ways
that together lose no link between two nodes of a group:

* *Leaders.* A group's members are compared with one of them. Members that are
  linked to it are one component and need not be compared with each other.
* *Blocks.* What leaders leave open are pairs of different components. One end of
  such a pair lies outside the group's largest component, so only those nodes
  search, against all members, a block of searchers and a block of members at a
  time. A block compares sketches, then the sets of those that may be alike with
  some member, and puts out what joins two components: a forest, however many of
  its pairs are alike.

Both verify on whole sets, which are made once, for the nodes of groups alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import batches
from terrafold.llm.graph import components
from terrafold.plans.ordered import spread
from terrafold.session import cut_lineage

#: Members of a block, and shingles of their sets, on average. A block compares as many sketches with as many.
BLOCK, BLOCK_SHINGLES = 256, 100_000
#: Rounds of leaders at most; they go on while some group leaves more searchers than this.
ROUNDS, SEARCHERS = 4, 2048

#: Rows that reach Python together: pairs of sets, and pairs of blocks, of about two megabytes each; rows that hold many sets are large.
PAIR_ROWS, BLOCK_ROWS = 1000, 16

#: For two matrices of sketches: for each row of the first, how likely each row of the second is alike, below 0 if not at all.
Likely = Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]
#: From the sizes of a set and of others, and how much they have in common: which are alike.
Alike = Callable[[int, np.ndarray, np.ndarray], np.ndarray]
Frames = Callable[[DataFrame], DataFrame]


def _groups(nodes: DataFrame) -> DataFrame:
    """(key, node, lead, n) for the keys that at least two nodes share; of groups with the same members one is taken."""
    entries = nodes.select("node", F.explode("keys").alias("key"))
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))) for i in range(2)]
    keys = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead"), *[m.alias(f"m{i}") for i, m in enumerate(mark)])
    one = keys.where("n > 1").groupBy("n", "lead", "m0", "m1").agg(F.min("key").alias("key"))
    one = cut_lineage(one.select("key", "n", "lead"))
    return cut_lineage(entries.join(one, "key").select("key", "node", "lead", "n"))


def _around_leads(held: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, comp, main) for the groups that have nodes not linked to their leader; main is the leader, others are components of their own."""
    pair = found.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    met = held.join(pair, (F.least("lead", "node") == F.col("_a")) & (F.greatest("lead", "node") == F.col("_b")), "left")
    with_lead = (F.col("node") == F.col("lead")) | F.col("_a").isNotNull()
    now = cut_lineage(met.select("key", "node", F.when(with_lead, F.col("lead")).otherwise(F.col("node")).alias("comp"), F.col("lead").alias("main")))
    # read several times over
    return cut_lineage(now.join(cut_lineage(now.where("comp <> main").select("key").distinct()), "key", "left_semi"))


def _parted(held: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, comp, main) for the groups that are in several components; main is the largest, of equal ones the smallest."""
    found = components(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    now = held.join(found, held.node == found.member, "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    now = cut_lineage(now)
    counts = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    # the least of (-count, comp) is the largest component
    main = counts.groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("c"), "comp")).alias("m"), F.count("*").alias("comps"))
    main = cut_lineage(main.where("comps > 1").select("key", F.col("m.comp").alias("main")))
    return cut_lineage(now.join(main, "key"))


class Postings:
    """The hashes of several sets in one ascending array, each with the set it is from."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], owner[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many hashes of ``own`` each set has."""
        a, b = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def _joined(a: list, b: list, likely: Likely, alike: Alike) -> list[tuple[int, int]]:
    """Index pairs of searchers ``a`` and members ``b`` (component, sketch, set) that are alike and join two components."""
    sketches = [np.frombuffer(b"".join(bytes(x[1]) for x in s), np.uint16).reshape(len(s), -1) for s in (a, b)]
    members = Postings([np.frombuffer(x[2], np.uint64) for x in b])
    # components of the block's codes so far, as a label of each; a pair within one needs no look at its sets
    label, code = np.unique(np.array([x[0] for x in [*a, *b]]), return_inverse=True)
    label, own_code, codes = np.arange(len(label)), code[: len(a)], code[len(a) :]
    out = []
    for i, score in enumerate(likely(*sketches)):
        mine = own_code[i]
        near = (score >= 0) & (label[codes] != label[mine])
        if not near.any():
            continue
        own = np.frombuffer(a[i][2], np.uint64)
        for j in np.flatnonzero(near & alike(len(own), members.sizes, members.shared(own))).tolist():
            if label[codes[j]] != label[mine]:
                label[label == label[mine]] = label[codes[j]]
                out.append((i, j))
    return out


def _verified(pairs: DataFrame, own: DataFrame, likely: Likely, alike: Alike) -> DataFrame:
    """The pairs (a, b) that are alike; sketches decide first, and only what they leave moves with its sets."""

    @F.pandas_udf(T.BooleanType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = (next(likely(np.frombuffer(p, np.uint16)[None], np.frombuffer(q, np.uint16)[None]))[0] >= 0 for p, q in zip(a, b))
        return pd.Series(list(rows), dtype=bool)

    @F.pandas_udf(T.BooleanType())
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(bool(alike(len(x), np.array([len(y)]), np.array([both]))[0]))
        return pd.Series(out, dtype=bool)

    def both(rows: DataFrame, column: str) -> DataFrame:
        left, right = (own.select(F.col("node").alias(c), F.col(column).alias(f"_{c}")) for c in "ab")
        return rows.join(right, "b").join(left, "a")

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut_lineage(both(pairs, "sketch").where(near("_a", "_b")).select("a", "b"))
    with batches(pairs.sparkSession, PAIR_ROWS):
        return cut_lineage(both(pairs, "hashes").where(same("_a", "_b")).select("a", "b"))


def _by_blocks(parted: DataFrame, own: DataFrame, likely: Likely, alike: Alike, block: int) -> DataFrame:
    """Links (a, b) that join different components of a group, found block by block."""

    @F.pandas_udf(T.ArrayType(T.StructType().add("i", T.IntegerType()).add("j", T.IntegerType())))
    def found(sc: pd.Series, sk: pd.Series, ss: pd.Series, mc: pd.Series, mk: pd.Series, ms: pd.Series) -> pd.Series:
        rows = (_joined(list(zip(*r[:3])), list(zip(*r[3:])), likely, alike) for r in zip(sc, sk, ss, mc, mk, ms))
        return pd.Series([[{"i": i, "j": j} for i, j in r] for r in rows], dtype=object)

    # else the filter that an explode implies goes below the shuffle, and every block is worked through twice, first where the join left it
    found = found.asNondeterministic()
    seeks = F.col("comp") != F.col("main")
    one = parted.select("key", "node", F.xxhash64("comp").alias("code"), seeks.alias("seeks"))
    one = one.join(own.select("node", F.octet_length("hashes").alias("bytes")), "node")
    blocks = lambda rows, size: F.greatest(F.ceil(rows / block), F.ceil(size / (8 * BLOCK_SHINGLES)))
    sizes = one.groupBy("key").agg(
        blocks(F.count("*"), F.sum("bytes")).alias("nb"), blocks(F.count_if("seeks"), F.sum(F.when(F.col("seeks"), F.col("bytes")))).alias("kb")
    )
    used = parted.select("key", "node", F.xxhash64("comp").alias("code"), seeks.alias("seeks")).join(cut_lineage(sizes), "key").join(own, "node")

    def lists(rows: DataFrame, n: Column, side: str) -> DataFrame:
        of = F.pmod(F.xxhash64("node", F.lit(side)), n)
        return rows.groupBy("key", of.alias(f"{side}_block")).agg(F.collect_list(F.struct("node", "code", "sketch", "hashes")).alias(side))

    searching, members = lists(used.where("seeks"), F.col("kb"), "s"), lists(used, F.col("nb"), "m")
    # blocks cost much for their bytes: a task for each few of them
    met = spread(cut_lineage(searching).join(cut_lineage(members), "key"), "key", "s_block", "m_block")
    told = met.select(F.col("s.node").alias("s"), F.col("m.node").alias("m"), found("s.code", "s.sketch", "s.hashes", "m.code", "m.sketch", "m.hashes").alias("f"))
    pairs = told.select("s", "m", F.explode("f").alias("p"))
    pairs = pairs.select(F.get("s", F.col("p.i")).alias("a"), F.get("m", F.col("p.j")).alias("b"))
    with batches(pairs.sparkSession, BLOCK_ROWS):
        return cut_lineage(pairs)


def links(nodes: DataFrame, likely: Likely, alike: Alike, sets: Frames, block: int = BLOCK, searchers: int = SEARCHERS) -> DataFrame:
    """Verified links (a, b) that connect whatever pairs of a common key are alike.

    ``nodes`` is a written table of node (a number), sketch (uint16 registers as
    binary), keys (array of longs). ``likely`` tells from sketches which nodes may
    be alike, ``alike`` from the sets' sizes and common part which are, and ``sets`` gives (node, hashes)
    for a table of nodes: ascending uint64 as binary.
    The components of the result are those of all alike pairs of a common key.
    Repeated keys of a node count once. Nodes without keys have no links.
    """
    held = _groups(nodes.withColumn("keys", F.array_distinct("keys")))
    used = cut_lineage(held.select("node").distinct())
    own = cut_lineage(sets(used).join(nodes.select("node", "sketch").join(used, "node", "left_semi"), "node"))
    found = _verified(held.select(F.col("lead").alias("a"), F.col("node").alias("b")), own, likely, alike)
    parted = _around_leads(held, found)
    for turn in range(1, ROUNDS):
        most = parted.where("comp <> main").groupBy("key").count().agg(F.max("count")).first()[0] or 0
        if most <= searchers:
            break
        # the next leader is drawn outside the largest component
        drawn = F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("next")
        leads = cut_lineage(parted.where("comp <> main").groupBy("key").agg(drawn))
        pairs = parted.join(leads, "key").where("comp <> next.comp").select(F.col("next.node").alias("a"), F.col("node").alias("b"))
        found = cut_lineage(found.union(_verified(pairs, own, likely, alike)).distinct())
        parted = _parted(held, found)
    if parted.isEmpty():
        return found
    return cut_lineage(found.union(_by_blocks(parted, own, likely, alike, block)).distinct())
