"""Near duplicates by HyperMinHash: compressed minima, banded, estimated, verified.

A sketch has 256 buckets. A shingle's hash goes to the bucket of its top bits, and
of the smallest hash in a bucket a register keeps the count of leading zeros and
the ten bits after them. Two sets' registers agree in about their resemblance's
share of the buckets, and by chance in a share that depends on the sets' sizes
alone, which the estimate takes off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm import grouped
from terrafold.llm.common import TEXT_ROWS, batches, body, key_id
from terrafold.llm.graph import components
from terrafold.session import cut_lineage

WORDS = 3
#: Texts are linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
#: Registers of a band, and the chance below which a pair at the limit may agree in no band, its registers taken as independent:
#: 24 bands at 0.85. Those of small sets are not quite (an empty bucket borrows), so that at 0.8 of 24 bands 1e-4 of the pairs
#: are lost in place of 7e-5, of 35 2e-6 in place of 9e-7, and of all 51 none of 666,667 drawn.
BAND_ROWS, LOSS = 5, 1e-6
BANDS = BUCKETS // BAND_ROWS
#: An estimate may fall short of the limit by so many standard deviations before a pair is given up unverified.
SLACK = 5.0
EMPTY = np.uint16(0xFFFF)

_rng = np.random.default_rng(12)
#: Order in which an empty bucket looks for one to borrow from, as ranks; its own comes first.
_RANK = np.argsort(np.argsort(_rng.random((BUCKETS, BUCKETS)) - np.eye(BUCKETS), axis=1), axis=1).astype(np.uint16)
#: Which registers the bands take, one band after the other.
_BAND = _rng.permutation(BUCKETS)[: BANDS * BAND_ROWS]
_SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Sets:
    """Sets of a text's distinct shingles of ``width`` words (up to five), as sorted 64-bit hashes; remembers the hashes of words.

    A-Z counts as a-z, words are parted by ASCII white space. A text of fewer
    words is one shingle, one without words the empty set.
    """

    LIMIT = 100_000

    def __init__(self, width: int = WORDS) -> None:
        self.known: dict[bytes, int] = {}
        self.width = width

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # on bytes both touch ASCII only
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 12)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(self.width, len(h))
        n = len(h) - width + 1
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total = _mixed(total + h[i : i + n] * np.uint64(_SPREAD[i]))
        return np.unique(total)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of ascending hashes: per bucket, leading zeros and mantissa of its smallest hash."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))  # ascending, so the first of a bucket is its smallest
    value, at = hashes[first] << np.uint64(BUCKET_BITS), bucket[first]
    low = np.uint64(1) << np.uint64(BUCKET_BITS + MANTISSA_BITS)
    value = np.maximum(value, low)  # values this small are one register
    high = (value >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    zeros = 53 - np.frexp(high)[1]
    mantissa = ((value << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)).astype(np.int64)
    out[at] = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union: more zeros win, and of equal ones the smaller mantissa."""
    mask = np.uint16((1 << MANTISSA_BITS) - 1)
    order = lambda r: np.where(r == EMPTY, -1, (r.astype(np.int32) | int(mask)) - (r & mask))
    return np.where(order(a) >= order(b), a, b)


def bands(percent: int, loss: float = LOSS) -> int:
    """How many bands keep the chance of losing a pair of this resemblance below ``loss``, or all bands."""
    few = np.log(loss) / np.log1p(-min(percent / 100, 1 - 1e-9) ** BAND_ROWS) if percent > 0 else np.inf
    return int(min(np.ceil(few), BANDS))


def band_keys(regs: np.ndarray) -> list[int]:
    """One key for each of ``BANDS`` bands, of which a limit takes the first (``bands``); none for an empty set. An empty bucket takes the register of
    the first filled one in an order of its own, the same in every sketch, so
    that sets of few shingles have whole bands as well."""
    filled = np.flatnonzero(regs != EMPTY)
    if not len(filled):
        return []
    if len(filled) < BUCKETS:
        bare = np.flatnonzero(regs == EMPTY)
        regs = regs.copy()
        regs[bare] = regs[filled[_RANK[np.ix_(bare, filled)].argmin(axis=1)]]
    rows = np.ascontiguousarray(regs[_BAND].reshape(BANDS, BAND_ROWS))
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - 2**63 for b, r in enumerate(rows)]


_ZEROS = 2.0 ** -np.arange(1, 65 - BUCKET_BITS - MANTISSA_BITS)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of registers on which unrelated sets with ``a`` and ``b`` shingles a bucket agree.

    A bucket's smallest hash is nearly exponential. Hashes with z leading zeros
    lie in [2^-(z+1), 2^-z), which the mantissa cuts into equal steps; two of
    them agree with the chance that both smallest fall into one step.
    """
    a, b = np.asarray(a, float)[..., None], np.asarray(b, float)[..., None]
    both = np.maximum(a + b, 1e-12)
    width = _ZEROS / 2**MANTISSA_BITS
    return (width * a * b / both * (np.exp(-both * _ZEROS) - np.exp(-both * 2 * _ZEROS))).sum(axis=-1)


def load(regs: np.ndarray) -> np.ndarray:
    """Shingles a bucket, from how many buckets are empty, or else from the mean smallest value."""
    full = regs != EMPTY
    share = full.mean(axis=-1)
    zeros, mantissa = regs >> np.uint16(MANTISSA_BITS), regs & np.uint16((1 << MANTISSA_BITS) - 1)
    value = np.where(full, (1 + (mantissa + 0.5) / 2**MANTISSA_BITS) * 2.0 ** -(zeros.astype(float) + 1), 0).sum(axis=-1)
    many = full.sum(axis=-1) / np.maximum(value, 1e-300)
    return np.where(share < 0.95, -np.log1p(-np.minimum(share, 0.95)), many)


def corrected(share: np.ndarray, by_chance: np.ndarray) -> np.ndarray:
    """Resemblance from the share of buckets that agree."""
    return (share - by_chance) / (1 - by_chance)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance of two sketches; of two empty ones 0."""
    used = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & used).sum() / max(used.sum(), 1)
    return float(corrected(share, chance(load(a), load(b))))


def floor(percent: int, used: np.ndarray) -> np.ndarray:
    """The lowest estimate of a pair at the limit, from how many buckets are used.

    The buckets' smallest hashes are drawn from the union without putting back: of
    small sets they are nearly all, so that the estimate varies little.
    """
    t, n = percent / 100, np.maximum(used, 1)
    union = -BUCKETS * np.log1p(-np.minimum(n / BUCKETS, 0.999))
    left = np.where(n < 0.95 * BUCKETS, 1 - n / np.maximum(union, n + 1e-9), 1.0)
    return t - SLACK * np.sqrt(t * (1 - t) / n * left) - 1 / n  # one bucket more for what rounding of small sets may hide


def likely(some: np.ndarray, many: np.ndarray, percent: int = PERCENT) -> Iterator[np.ndarray]:
    """For each sketch of ``some``, the estimates for the rows of ``many``; -1 where they fall short of the limit by over SLACK standard deviations."""
    loads, filled = load(many), many != EMPTY
    for one, own in zip(some, load(some)):
        used = (filled | (one != EMPTY)).sum(axis=1)
        share = ((many == one) & filled).sum(axis=1) / np.maximum(used, 1)
        least = floor(percent, used)
        at = np.flatnonzero(share >= least)  # the correction only lowers the share
        score = np.full(len(many), -1.0)
        j = corrected(share[at], chance(own, loads[at]))
        score[at] = np.where(j >= least[at], np.maximum(j, 0.0), -1.0)
        yield score


_PRINT = T.StructType().add("set", T.BinaryType()).add("size", T.LongType()).add("sketch", T.BinaryType()).add("keys", T.ArrayType(T.LongType()))


def _prints(texts: str, words: int) -> Column:
    @F.pandas_udf(_PRINT)
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for part in parts:
            out = []
            for t in part:
                s = sets.of(t)
                regs = registers(s)
                out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), regs.tobytes(), band_keys(regs)))
            yield pd.DataFrame(out, columns=["set", "size", "sketch", "keys"])

    return prints(texts)


def alike(size: int, sizes: np.ndarray, both: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets of ``sizes`` are linked with one of ``size``, by what they have in common."""
    return (both > 0) & (100 * both >= percent * (size + sizes - both))


def _hashes(texts: str, words: int) -> Column:
    @F.pandas_udf(T.StructType().add("set", T.BinaryType()).add("hashes", T.BinaryType()))
    def hashes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sets = Sets(words)
        for part in parts:
            all_ = [sets.of(t).tobytes() for t in part]
            yield pd.DataFrame({"set": [xxhash.xxh3_128_digest(s) for s in all_], "hashes": all_})

    return hashes.asNondeterministic()(texts)  # else the join's filter on the set hashes every text once more


def near_dedup(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, empty_alike: bool = False, loss: float = LOSS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets
    of ``words``-word shingles (``Sets``); ``component`` is the smallest id
    reachable, a null doc_id counting as the smallest. Texts without words, null
    ones among them, are linked with nothing, not even each other, or else, if
    ``empty_alike``, are all copies of the first of them. Equal sets
    are one node, so a group of copies of any size costs one row. Rows that
    share a doc_id but not a set are separate rows; an empty table gives an
    empty table.

    Candidates share the registers of a band. In a group of candidates, leaders
    and blocks (``grouped``) leave the pairs that may count, the estimate drops
    those far below the limit, and full sets decide on the others. Only the
    bands and the estimate's slack can lose a link: a pair at the limit with a
    chance of about ``loss``, or the least that all bands give.
    """
    told = _classes(docs, percent, words, loss)
    if not empty_alike:
        told = told.withColumn("component", F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")))
    return told.select("id", F.col("size").alias("n_shingles"), "component")


def first_rows(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, loss: float = LOSS) -> DataFrame:
    """Of each component of near copies (``near_dedup``, with texts without words alike) one row of ``docs``, all its columns kept.

    It is a row of the smallest doc_id. Rows that share a doc_id are rows of their own:
    of those that are near copies one stays, by its set and then its content, and others stay beside it.
    """
    told = cut_lineage(_classes(docs, percent, words, loss).select("id", "set", "class"))
    first = told.groupBy("class").agg(F.min(F.struct("id", "set")).alias("f")).select("f.id", "f.set")
    first = cut_lineage(first.join(told.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id"))
    alone = first.where("n = 1").select(F.col("id").alias("_first"))
    out = docs.join(alone, key_id() == alone["_first"], "left_semi")
    several = first.where("n > 1").select("id", "set")
    if several.isEmpty():
        return out
    rows = docs.select(F.struct("*").alias("row"), key_id().alias("id"), body().alias("text"))
    rows = rows.join(several.select("id").distinct(), "id", "left_semi").select("row", "id", "text", _hashes("text", words)["set"].alias("set"))
    order = F.struct("text", F.to_json("row"))
    one = rows.join(several, ["id", "set"], "left_semi").groupBy("id", "set").agg(F.min_by("row", order).alias("row"))
    return out.unionByName(one.select("row.*"))


def _classes(docs: DataFrame, percent: int, words: int, loss: float) -> DataFrame:
    """One row per row of ``docs``: id, size and set, component, and class, a number that no other component has (ids may repeat)."""
    with batches(docs.sparkSession, TEXT_ROWS):
        return _near_dedup(docs, percent, words, loss)


def _near_dedup(docs: DataFrame, percent: int, words: int, loss: float) -> DataFrame:
    texts = docs.select(key_id().alias("id"), body().alias("text"))
    prints = cut_lineage(texts.withColumn("_p", _prints("text", words)).select("id", "_p.*").withColumn("keys", F.slice("keys", 1, bands(percent, loss))))
    some = prints.where("size > 0")
    nodes = some.groupBy("set").agg(F.min("id").alias("id"), F.min("sketch").alias("sketch"), F.any_value("keys").alias("keys"))
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("node"), "id", "set", "sketch", "keys"))

    def sets(used: DataFrame) -> DataFrame:
        """A node's set is made again from its text: texts are read twice, and move once, but are never written."""
        wanted = cut_lineage(nodes.select("node", "id", "set").join(used, "node", "left_semi"))
        rows = texts.join(wanted.select("id").distinct(), "id", "left_semi").select("id", _hashes("text", words).alias("h"))
        # a node has one id and set: what repeats is left out before the join, so that sets move once
        once = rows.select("id", "h.set", "h.hashes").groupBy("id", "set").agg(F.any_value("hashes").alias("hashes"))
        return once.join(wanted, ["id", "set"]).select("node", "hashes")

    links = grouped.links(nodes, lambda a, b: likely(a, b, percent), lambda n, m, both: alike(n, m, both, percent), sets)
    found = components(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    rooted = nodes.join(found, nodes.node == found.member, "left").select("set", "id", F.coalesce("root", "node").alias("root"))
    rooted = cut_lineage(rooted)
    labels = rooted.select("set", "root").join(cut_lineage(rooted.groupBy("root").agg(F.min("id").alias("component"))), "root")
    labels = cut_lineage(labels.select("set", "component", F.col("root").alias("class")))
    out = some.select("id", "size", "set").join(labels, "set").select("id", "size", "set", "component", "class")
    bare = prints.where("size = 0")
    first = bare.agg(F.min("id")).scalar()
    return out.union(bare.select("id", "size", "set", first.alias("component"), F.lit(-1).cast("long")))
