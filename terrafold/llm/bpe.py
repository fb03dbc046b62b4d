"""BPE over a table of distinct words: each is encoded once, ids come back by position."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import body, key_id
from terrafold.session import cut_lineage

#: Code points of text that share one word list, if no single document is longer.
BLOCK_CHARS = 8_000_000
#: Words whose ids are gathered at a time.
GATHER = 1 << 18

CODED = "block long, seal long, id long, bucket int, payload binary"


def spaced_words(text: str) -> list[bytes]:
    """Words between ASCII white space, for tokenizers that drop white space."""
    return text.encode().split()


#: White space as Unicode defines it; the tokenizers' ``\s`` is no wider, so a word
#: with the white space before it is always a sequence of whole pre-tokens.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LEADING = re.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")


def leading_space_words(text: str) -> list[str]:
    """Words with the white space before them, for byte-level tokenizers; nothing is lost."""
    return _LEADING.findall(text)


def _pack(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]
    head = np.array([len(raw), *map(len, raw)], "<u4").tobytes()
    return zstandard.compress(head + b"".join(raw), 1)


def _unpack(payload: bytes) -> list[bytes]:
    raw = zstandard.decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + 4 * n, []
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _ints(planes: bytes) -> np.ndarray:
    """Unsigned 32-bit integers from their four byte planes."""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _coder(split: Callable, buckets: int, block_chars: int) -> Callable:
    """Replace texts by codes into the word list of their block, and emit the lists by bucket.

    A block's rows carry its number within the table and a seal, the hash of
    all that it holds. Equal seals mean equal codes.
    """

    def lists(words) -> Iterator[tuple[int, bytes]]:
        each = [w if isinstance(w, bytes) else w.encode() for w in words]
        of = np.fromiter((zlib.crc32(w) for w in each), np.int64, len(each)) % buckets
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            codes = order[a:b]
            part = [each[c] for c in codes.tolist()]
            sizes = np.fromiter(map(len, part), np.uint32, len(part))
            yield int(of[codes[0]]), _pack(np.diff(codes, prepend=0), sizes, b"".join(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        ids, payload, words, chars = [], [], {}, 0

        def close() -> pa.RecordBatch:
            found = list(lists(words))
            docs = len(ids)
            parts = payload + [p for _, p in found]
            seal = xxhash.xxh64()
            for p in parts:
                seal.update(p)
            seal.update(np.array(ids, np.int64).tobytes())
            cols = [
                pa.array([block] * len(parts), pa.int64()),
                pa.array([seal.intdigest() - 2**63] * len(parts), pa.int64()),
                pa.array(ids + [None] * len(found), pa.int64()),
                pa.array([-1] * docs + [b for b, _ in found], pa.int32()),
                pa.array(parts, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["block", "seal", "id", "bucket", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc)
                payload.append(_pack(np.array([words.setdefault(w, len(words)) for w in split(text)], np.uint32)))
                chars += len(text)
                if chars >= block_chars:
                    yield close()
                    block += 1
                    ids, payload, words, chars = [], [], {}, 0
        if ids:
            yield close()

    return run


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer at ``path``, loaded once in each worker, without truncation or padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        _loaded[path] = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return _loaded[path]


def _list_encoder(path: str) -> Callable:
    """Word lists to id lists; the rows of a bucket meet in one task, so each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizer(path), {}
        for batch in batches:
            payload = []
            for p in batch.column("payload").to_pylist():
                codes, sizes, text = _unpack(p)
                ends = np.cumsum(_ints(sizes), dtype=np.int64)
                words = [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 4096):
                    some = new[i : i + 4096]
                    for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                payload.append(_pack(codes, counts, np.frombuffer(b"".join(ids), "<u4")))
            keys = [batch.column("block"), batch.column("seal")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(payload, pa.binary())], names=["block", "seal", "payload"])

    return run


def _block_ids(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: where each code's ids start, how many there are, and all ids."""
    codes, counts, flat = [], [], []
    for p in payloads:
        c, n, i = _unpack(p)
        codes.append(np.cumsum(_ints(c), dtype=np.int64))
        counts.append(_ints(n).astype(np.int64))
        flat.append(_ints(i))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    code, n = np.concatenate(codes), np.concatenate(counts)
    starts, count = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    starts[code], count[code] = np.cumsum(n) - n, n
    return starts, count, np.concatenate(flat)


def block_documents(docs: pa.Table, lists: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(id, token ids) of each document of a block, joined back by position."""
    if not docs.num_rows:
        raise RuntimeError("a word list has lost its documents: the table's rows came in another order when they were read again")
    starts, count, flat = _block_ids(lists.column("payload").to_pylist())
    ids, payloads, at = docs.column("id").to_pylist(), docs.column("payload").to_pylist(), 0
    while at < len(ids):
        some, words = [], 0
        while at + len(some) < len(ids) and (not some or words < GATHER):
            some.append(_ints(_unpack(payloads[at + len(some)])[0]))
            words += len(some[-1])
        codes = np.concatenate(some)
        if len(codes) and not len(count):
            raise RuntimeError("documents have lost their word list: the table's rows came in another order when they were read again")
        n = count[codes]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        got = flat[np.repeat(starts[codes] - end + n, n) + np.arange(total)]
        cut = np.concatenate(([0], end))[np.cumsum([0, *map(len, some)])]
        for k in range(len(some)):
            yield ids[at + k], got[cut[k] : cut[k + 1]]
        at += len(some)


def word_coded(
    docs: DataFrame, path: str, split: Callable, block_chars: int = BLOCK_CHARS, written: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Documents as codes into their block's word list, and the lists' token ids.

    A block is a run of documents of a bounded size within one task. What is
    shuffled are compressed codes and, for each block, its distinct words: first
    by word, so that each is encoded once, then by block. Nothing is broadcast.

    The codes are either ``written`` once for both uses, or made twice, which
    spares the disk. Then a block is only joined with the list of the same seal,
    so a table whose rows change their order between two reads is an error and
    never a wrong result.
    """
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    coded = docs.select(key_id().alias("id"), body().alias("text")).mapInArrow(_coder(split, buckets, block_chars), CODED)
    if written:
        coded = cut_lineage(coded)
    lists = coded.where("bucket >= 0").repartition(buckets, "bucket").select("block", "seal", "payload")
    return coded.where("bucket < 0"), lists.mapInArrow(_list_encoder(path), "block long, seal long, payload binary")


def by_block(coded: DataFrame, lists: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` on each block: its documents and its word lists."""
    return coded.groupBy("block", "seal").cogroup(lists.groupBy("block", "seal")).applyInArrow(fn, schema)


def encode(
    docs: DataFrame, path: str, split: Callable = leading_space_words, block_chars: int = BLOCK_CHARS, decoded: bool = False
) -> DataFrame:
    """(id, ids): each document's token ids, as the tokenizer at ``path`` gives for the whole text.

    With ``decoded`` also ``text``, which the ids decode to. Null and empty
    texts have no ids; a null doc_id stands as the lowest id; repeated rows come
    back as often as they occur; an empty table gives none.
    """

    def run(d: pa.Table, lists: pa.Table) -> pa.Table:
        piece = byte_pieces(path) if decoded else None
        names, parts, texts = [], [], []
        for name, ids in block_documents(d, lists):
            names.append(name)
            parts.append(ids)
            if decoded:
                texts.append(joined(ids, piece))
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = pa.array(np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.int32))
        out = pa.table({"id": pa.array(names, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), flat)})
        return out.append_column("text", pa.array(texts, pa.string())) if decoded else out

    schema = "id long, ids array<int>" + ", text string" * decoded
    return by_block(*word_coded(docs, path, split, block_chars, written=False), run, schema)


@lru_cache(maxsize=2)
def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: a table of a fixed size.

    Printable Latin-1 characters stand for their own byte, the other bytes for
    the characters from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        known = all(c in byte for c in piece)
        pieces[i] = bytes(byte[c] for c in piece) if known else piece.encode()
    return pieces


def joined(ids: np.ndarray, piece: list[bytes]) -> str:
    """The pieces of ids put together; invalid UTF-8 becomes U+FFFD."""
    return b"".join([piece[i] for i in ids.tolist()]).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with ``ids``) and ``text``: each id joined with its piece, in order.

    The id-to-piece table has one row for each vocabulary entry, so the join
    runs inside the task on a copy of it. Null ids are no text.
    """

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = byte_pieces(path)
        for part in parts:
            yield pd.Series([None if ids is None else joined(ids, piece) for ids in part], dtype=object)

    return encoded.withColumn("text", run("ids"))
