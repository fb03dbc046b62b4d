"""Removal of long repeated byte strings, by suffix arrays over what can repeat.

A string of LENGTH bytes that repeats has the same smallest hashed GRAM wherever
it stands. So each place that a string can start at belongs to the anchor, the
place of that gram in its document, and repeats only at anchors of an equal gram.
The starts of one anchor are consecutive; the bytes they reach are its context.

1. Anchors whose gram stands elsewhere too are kept; text that is unique never moves.
2. Contexts that occur twice as they are repeat as a whole.
3. Of the other contexts of a gram, one each is cut into blocks counted from the
   anchor, so that equal text gives equal blocks. A suffix array of the blocks,
   built by Lyndon grouping, tells which blocks start a run that occurs again,
   and there the strings themselves are compared.
4. Grams with very many different contexts, such as the first one of a passage
   that a third of all documents quote, would make one large bundle. Their
   strings are counted by their hash in a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import body, key_id
from terrafold.llm.gsaca import suffix_array
from terrafold.session import cut_lineage

LENGTH = 200
GRAM = 32
BLOCK = 16
#: Bytes hashed at a time; a longer document is taken in stretches that overlap by a string.
STRETCH = 1 << 20
#: Contexts of one gram that still go through one suffix array (12 MB at most, a few seconds of
#: one task; counting them instead takes a row for each of their starts), and bytes of a bundle.
BUNDLE_CONTEXTS, BUNDLE_BYTES = 1 << 15, 1 << 19

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**62)) * 8 + 5
    n = 2 * STRETCH + LENGTH + 1
    powers = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (base, pow(base, -1, 2**64))]
    return values, powers[0], powers[1]


class Hashes:
    """64-bit hashes of substrings of data.

    ``place`` numbers the bytes where substrings never leave their own piece of
    the data; else the data may have 2 * STRETCH bytes.
    """

    def __init__(self, data: np.ndarray, seed: int = 1, place: np.ndarray | None = None):
        values, up, self.down = _tables(seed)
        self.place = place
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * (up[: len(data)] if place is None else up[place]), out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start if self.place is None else self.place[start]])


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, _ALL)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces of text put together: gram, context hash, first start, starts, anchor's distance.

    ``ends`` are the pieces' ends. Equal contexts have equal distances, so the
    hash covers these as well.
    """
    h = Hashes(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = h.at(starts, starts + GRAM)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_least((grams & ~low) | starts.astype(np.uint64), LENGTH - GRAM + 1)
    s = np.arange(len(data) - LENGTH + 1)
    inside = s + LENGTH <= ends[np.searchsorted(ends, s, side="right")]
    s, anchor = s[inside], (least[inside] & low).astype(np.int64)
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
    lo, a = s[first], anchor[first]
    n = np.diff(first, append=len(s))
    context = h.at(lo, lo + n - 1 + LENGTH) ^ _mix((n * 1024 + a - lo).astype(np.uint64))
    return grams[a], context, lo, n, a - lo


_PLACES = "gram long, context long, id long, place long"


def _pack_place(lo: np.ndarray, n: np.ndarray, to_anchor: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (lo << 32) | (tag << 16) | (n << 8) | to_anchor


def place_parts(place: Column) -> tuple[Column, Column, Column, Column]:
    """First start, number of starts, anchor's distance, and the tag that tells rows of one doc_id apart."""
    return (
        F.shiftrightunsigned(place, 32), F.shiftright(place, 8).bitwiseAND(F.lit(255)),
        place.bitwiseAND(F.lit(255)), F.shiftright(place, 16).bitwiseAND(F.lit(65535)),
    )


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(p[3]) for p in pieces])
        ends = np.cumsum(sizes)
        gram, context, lo, n, to_anchor = anchors(np.frombuffer(b"".join(p[3] for p in pieces), np.uint8), ends)
        of = np.searchsorted(ends, lo, side="right")
        ids, tags, offsets = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
        place = _pack_place(lo - (ends - sizes)[of] + offsets[of], n, to_anchor, tags[of])
        cols = [gram.view(np.int64), context.view(np.int64), ids[of], place]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "context", "id", "place"])

    for batch in batches:
        pieces, size = [], 0
        for doc, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for at in range(0, max(len(text) - LENGTH + 1, 0), STRETCH):
                part = text[at : at + STRETCH + LENGTH - 1]
                if size and size + len(part) > STRETCH + LENGTH:
                    yield rows(pieces)
                    pieces, size = [], 0
                pieces.append((doc, tag, at, part))
                size += len(part)
        if pieces:
            yield rows(pieces)


def _keyed(docs: DataFrame) -> DataFrame:
    """id, a 16-bit tag of the text for rows that share a doc_id, and the text's bytes."""
    text = body()
    return docs.select(
        key_id().alias("id"), F.xxhash64(text).bitwiseAND(F.lit(65535)).alias("tag"), text.cast("binary").alias("bytes")
    )


@F.pandas_udf(T.BinaryType())
def squeezed(texts: pd.Series) -> pd.Series:
    """Texts are shuffled twice; compressed they take under half the room."""
    z = zstandard.ZstdCompressor(level=1)
    return pd.Series([z.compress(t) for t in texts], dtype=object)


_CONTEXTS = "gram long, id long, tag long, lo long, n int, to_anchor int, bytes binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that each wanted context covers."""
    for batch in batches:
        out: list[tuple] = []
        for doc, tag, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = zstandard.decompress(text)
            out += [
                (w["gram"], doc, tag, w["lo"], w["n"], w["to_anchor"], text[w["lo"] : w["lo"] + w["n"] + LENGTH - 1])
                for w in wanted
            ]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        cols = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _CONTEXTS.split(", ")])


_STARTS = "id long, tag long, start long, n long"


def _repeats_in(contexts: list[bytes], counts: np.ndarray, to_anchor: np.ndarray) -> list[np.ndarray]:
    """Of each context, which of its starts begin a string that also begins elsewhere among the contexts."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # blocks counted from the anchor, those of one context next to each other
    skip = to_anchor % BLOCK
    blocks = np.maximum((sizes - skip) // BLOCK, 0)
    of = np.repeat(np.arange(len(contexts)), blocks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begins[of] + skip[of] + number * BLOCK
    place = np.arange(len(data), dtype=np.int32) - np.repeat(begins, sizes).astype(np.int32)
    h = Hashes(data, 1, place)
    symbol, times = np.unique(h.at(at, at + BLOCK), return_inverse=True, return_counts=True)[1:]
    # a string holds at least so many whole blocks; only runs of blocks that occur twice can hold one
    depth = LENGTH // BLOCK - 1
    twice = times[symbol] > 1
    edge = (np.diff(of, prepend=-1) != 0) | (np.diff(twice.astype(np.int8), prepend=-1) != 0)
    run = np.cumsum(edge) - 1
    keep = twice & (np.bincount(run, minlength=1)[run] >= depth) if len(of) else twice
    out = [np.zeros(c, bool) for c in counts.tolist()]
    if not keep.any():
        return out
    at, of, run = at[keep], of[keep], run[keep]
    # runs one after the other, each closed by a symbol of its own
    cut = np.flatnonzero(np.diff(run, append=-1) != 0) + 1
    string = np.insert(symbol[keep].astype(np.int64), cut, len(times) + np.arange(len(cut)))
    back = np.insert(np.arange(len(at)), cut, -1)
    sa = suffix_array(string)
    fits = sa + depth <= len(string)
    sa = sa[fits]
    same = np.ones(max(len(sa) - 1, 0), bool)
    for k in range(depth):
        same &= string[sa[1:] + k] == string[sa[:-1] + k]
    shared = np.append(same, False) | np.insert(same, 0, False)
    block = back[sa[shared]]
    # strings whose first whole block is one of these; the bytes before and after it are compared here
    start = (at[block][:, None] - np.arange(BLOCK)).ravel()
    ctx = np.repeat(of[block], BLOCK)
    inside = (start >= begins[ctx]) & (start < begins[ctx] + counts[ctx])
    start, ctx = start[inside], ctx[inside]
    key = np.stack([h.at(start, start + LENGTH), Hashes(data, 2, place).at(start, start + LENGTH)], axis=1)
    _, which, seen = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    again = seen[which.ravel()] > 1
    for c, s in zip(ctx[again].tolist(), (start - begins[ctx])[again].tolist()):
        out[c][s] = True
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: suffix arrays over as many grams as fit a bundle."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        counts, to_anchor = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        found: list[list[int]] = [[], [], [], []]
        for r, hit in zip(rows, _repeats_in([r[6] for r in rows], counts, to_anchor)):
            edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            for a, b in edges.tolist():
                for c, v in zip(found, (r[1], r[2], r[3] + a, b - a)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "tag", "start", "n"])

    rows: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[0] != last and size >= BUNDLE_BYTES:
                yield solve(rows)
                rows, size = [], 0
            last = row[0]
            rows.append(row)
            size += len(row[6])
    if rows:
        yield solve(rows)


def repeated_starts(docs: DataFrame, bundle_contexts: int = BUNDLE_CONTEXTS) -> DataFrame:
    """(id, tag, start, n): runs of starts, in bytes, of strings that start at another place too."""
    keyed = _keyed(docs)
    rows = keyed.where(F.octet_length("bytes") >= LENGTH).mapInArrow(_anchor_rows, _PLACES)
    common = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    held = cut_lineage(rows.join(common, "gram"))
    lo, n, to_anchor, tag = place_parts(F.col("place"))

    kinds = cut_lineage(
        held.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(F.struct("id", "place")).alias("one"))
    )
    # whole contexts that occur twice
    twice = kinds.where("times > 1").select("gram", "context")
    whole = held.join(twice, ["gram", "context"], "left_semi").select("id", tag.alias("tag"), lo.alias("start"), n.alias("n"))

    # the different contexts of one gram, each by one of its places
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    one = kinds.join(several, "gram").select("gram", "kinds", "one.id", "one.place")
    wanted = one.select("gram", "kinds", "id", tag.alias("tag"), lo.alias("lo"), n.cast("int").alias("n"), to_anchor.cast("int").alias("to_anchor"))

    def contexts(of: DataFrame) -> DataFrame:
        by_doc = of.groupBy("id", "tag").agg(F.collect_list(F.struct("gram", "lo", "n", "to_anchor")).alias("w"))
        texts = keyed.select("id", "tag", squeezed("bytes").alias("text"))
        return texts.join(by_doc, ["id", "tag"]).select("id", "tag", "text", "w").mapInArrow(_cut_contexts, _CONTEXTS)

    few = contexts(wanted.where(F.col("kinds") <= bundle_contexts))
    bundled = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(_bundles, _STARTS)

    many = contexts(wanted.where(F.col("kinds") > bundle_contexts)).select(
        "id", "tag", "lo", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    ).select("id", "tag", (F.col("lo") + F.col("k")).alias("start"), F.unhex(F.md5(F.substring("bytes", F.col("k") + 1, F.lit(LENGTH)))).alias("key"))
    again = many.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    counted = many.join(again, "key", "left_semi").select("id", "tag", "start", F.lit(1).cast("long").alias("n"))
    return whole.union(bundled).union(counted)


OUT = T.StructType().add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept", T.BinaryType())


@F.pandas_udf(OUT)
def without_repeats(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, run in zip(texts, runs):
        text = zstandard.decompress(text)
        if run is None or not len(run):
            out.append((len(text), 0, 0, text))
            continue
        steps = np.zeros(len(text) + 1, np.int64)
        starts = np.array([r["start"] for r in run])
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + np.array([r["n"] for r in run]) - 1 + LENGTH, -1)
        gone = np.cumsum(steps[:-1]) > 0
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
    return pd.DataFrame(out, columns=OUT.names)


def repeat_dedup(docs: DataFrame, bundle_contexts: int = BUNDLE_CONTEXTS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (bytes) of each row of ``docs``.

    Every byte goes that a string of LENGTH bytes covers which also starts
    elsewhere, in another row or the same one. ``kept`` is what remains and may
    end within a character. Null, empty and shorter texts lose nothing; repeated
    rows repeat each other, so both lose all strings they have; a null doc_id
    stands as the lowest id. ``bundle_contexts`` changes the way, not the result.
    """
    runs = repeated_starts(docs, bundle_contexts)
    by_doc = runs.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    texts = _keyed(docs).select("id", "tag", squeezed("bytes").alias("text"))
    return texts.join(by_doc, ["id", "tag"], "left").select("id", without_repeats("text", "runs").alias("out")).select("id", "out.*")
