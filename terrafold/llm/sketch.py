"""Document fingerprints: bottom-k sketches of hashed word shingles."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import LOWEST, body, key_id, shown_id

WORDS = 5
#: Smallest hashes kept of a document.
K = 256
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (two xor-multiply rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of a text's distinct word shingles; remembers the hashes of words."""

    LIMIT = 500_000

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        if len(self.words) > self.LIMIT:
            self.words.clear()
        known, out = self.words, []
        for w in text.encode().split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        h = self.word_hashes(text)
        if not len(h):
            return h
        n = max(1, len(h) - WORDS + 1)
        total = np.full(n, min(len(h), WORDS), np.uint64)
        for i, odd in enumerate(_ODD[: min(WORDS, len(h))]):
            total = _mix(total + h[i : i + n] * np.uint64(odd))
        return total


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending; all of them if there are fewer."""
    if len(hashes) > 4 * k:  # repeats may hide among the smallest, so look further if too few remain
        m = 2 * k
        few = np.unique(np.partition(hashes, m)[:m])
        if len(few) > k:
            return few[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**64 / (float(s[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in the union; two empty sketches are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a is contained in anything."""
    own = distinct_count(a, k)
    if not own:
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / own)


def to_text(s: np.ndarray) -> str:
    """Printable form: base64 of the hashes as big-endian 64-bit integers."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_text(t: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(t), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, sketch) of each row: ascending 64-bit hashes, stored as signed longs."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Shingler()
        for texts in parts:
            yield pd.Series([bottom(s.shingles(t), k).view(np.int64) for t in texts], dtype=object)

    return docs.select(shown_id(key_id()).alias("doc_id"), run(body()).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch for each key, such as a source, from its documents' sketches.

    The rows of a key are first merged within 32 salts, so a key with a third of
    all documents is spread over as many tasks; a merge keeps k hashes.
    """
    # unsigned order is signed order with the top bit turned over
    turned = F.transform("sketch", lambda h: h.bitwiseXOR(F.lit(LOWEST)))
    hashes = sketches.select(*keys, F.explode(turned).alias("h"), (F.pmod(F.xxhash64("doc_id"), F.lit(32))).alias("_salt"))

    def least(df: DataFrame, by: list[str]) -> DataFrame:
        return df.distinct().groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias("hs"))

    part = least(hashes, [*keys, "_salt"]).select(*keys, F.explode("hs").alias("h"))
    return least(part, keys).select(*keys, F.transform("hs", lambda h: h.bitwiseXOR(F.lit(LOWEST))).alias("sketch"))


# -- fingerprints of texts and of their edited form -------------------------

EDITED = (
    "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _cut_points(docs: DataFrame, parts: int) -> tuple[list[int], int | None]:
    """Up to ``parts`` ids that cut the ids into even ranges, ascending, the largest id among them."""
    q = [i / parts for i in range(1, parts)]
    row = docs.select(key_id().alias("id")).agg(
        F.percentile_approx("id", q or [0.5], 10_000).alias("cuts"), F.max("id").alias("top")
    ).first()
    if row["top"] is None:
        return [], None
    return sorted({*row["cuts"], row["top"]}), row["top"]


def with_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and likenesses (``EDITED``).

    The edited text is the text with its last half replaced by as much of the
    next document, in descending doc_id (after the last: the first). Texts move
    once, into ranges of doc_id; the first document of each range is also sent
    to the range before, whose last document needs it. The ranges are cut at
    ids found in a pass over the ids alone; there is one cut for each shuffle
    partition, so what the driver sees does not grow with the documents.

    A null text is empty, and an empty text has an empty sketch: alike (1) to
    an empty one, unlike (0) to any other. A null doc_id is the smallest id.
    Rows that share a doc_id follow each other by text. A single row is its own
    next document. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts, top = _cut_points(docs, parts)
    # ranges count up with falling ids; range r holds ids up to edges[r], which is the first id it has
    edges = cuts[::-1] or [LOWEST]
    at = F.array(*[F.lit(e) for e in edges])
    rows = docs.select(key_id().alias("id"), body().alias("text"))
    own = F.size(F.filter(at, lambda e: e >= F.col("id"))) - 1
    # the first id of a range ends the one before; the top id ends the last
    heads = F.when(F.array_contains(at, F.col("id")), F.when(own == 0, F.lit(len(edges) - 1)).otherwise(own - 1))
    sent = rows.select(
        "id", "text",
        F.explode(F.array_compact(F.array(F.struct(own.alias("part"), F.lit(0).alias("halo")), F.when(heads.isNotNull(), F.struct(heads.alias("part"), F.lit(1).alias("halo")))))).alias("to"),
    ).select("to.part", "to.halo", "id", "text")
    # each range is the partition of its number
    ranged = sent.repartitionById(len(edges), F.col("part").cast("int")).sortWithinPartitions("part", "halo", F.desc("id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        part = last = None  # last: the row whose next document is still to come
        closed = False

        def finish(row, text, sketch):
            _, own_text, own_sketch = row
            n = len(own_text) // 2
            edited = own_text[: len(own_text) - n] + text[:n]
            es = bottom(shingler.shingles(edited), k)
            return (
                row[0], len(own_text), edited, to_text(own_sketch), to_text(es),
                resemblance(own_sketch, es, k), resemblance(own_sketch, sketch, k),
            )

        for batch in batches:
            out = []
            for p, halo, doc, text in zip(batch["part"], batch["halo"], batch["id"], batch["text"]):
                if p != part:
                    part, last, closed = p, None, False
                if halo and closed:
                    continue  # of rows that share the next range's first id only the first follows
                sketch = bottom(shingler.shingles(text), k)
                if last is not None:
                    out.append(finish(last, text, sketch))
                last, closed = (doc, text, sketch), bool(halo)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])

    return ranged.mapInPandas(run, EDITED)
