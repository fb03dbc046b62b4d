"""Packing of tokenised documents into training sequences of several context sizes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrafold.llm.bpe import BLOCK_CHARS, block_documents, by_block, spaced_words, word_coded

#: Context sizes, each a power of two; the last is the length of a full sequence.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Sequences of one training step.
STEP = 16

PIECES = (
    "id long, start long, length long, token_bytes binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)

Piece = tuple[int, int, int]  # document, start, length


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    return next(t for t in tiers if t >= length)


def _fill(tails: list[Piece], tiers: tuple[int, ...]) -> dict[int, list[list[Piece]]]:
    """Windows of whole tails by tier: each tail goes to the tightest window that holds it,
    or opens one of its own tier's size.

    Tails come longest first, so each tier opens its windows before the
    shorter tiers fill what they leave. ``open_`` has a bit for each gap.
    """
    windows: list[list[Piece]] = []
    by_tier: dict[int, list[list[Piece]]] = {t: [] for t in tiers}
    by_gap: dict[int, list[int]] = {}
    open_ = 0
    for p in sorted(tails, key=lambda p: (-p[2], p)):
        fits = open_ >> p[2]
        if fits:
            gap = p[2] + (fits & -fits).bit_length() - 1
            w = by_gap[gap].pop()
            if not by_gap[gap]:
                open_ ^= 1 << gap
        else:
            gap, w = tier_of(p[2], tiers), len(windows)
            windows.append([])
            by_tier[gap].append(windows[w])
        windows[w].append(p)
        if left := gap - p[2]:
            by_gap.setdefault(left, []).append(w)
            open_ |= 1 << left
    return by_tier


def _close_gaps(windows: list[list[Piece]], size: int) -> list[list[Piece]]:
    """Take the emptiest windows apart and cut their pieces to fit the gaps of the fullest."""
    used = {i: sum(p[2] for p in w) for i, w in enumerate(windows)}
    order = sorted(used, key=lambda i: -used[i])
    i, j = 0, len(order) - 1
    while i < j:
        full, donor = windows[order[i]], windows[order[j]]
        gap = size - used[order[i]]
        while gap and donor:
            doc, start, n = donor.pop()
            take = min(n, gap)
            full.append((doc, start, take))
            if take < n:
                donor.append((doc, start + take, n - take))
            gap -= take
            used[order[j]] -= take
        used[order[i]] = size - gap
        if not donor:
            j -= 1
        if not gap:
            i += 1
    return [w for w in windows if w]


def _by_powers(window: list[Piece]) -> list[list[Piece]]:
    """A window that stays short, cut into sequences whose lengths are powers of two."""
    left = sum(p[2] for p in window)
    rest, out = window[::-1], []
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, n = rest.pop()
            take = min(n, room)
            out[-1].append((doc, start, take))
            if take < n:
                rest.append((doc, start + take, n - take))
            room -= take
    return out


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """(tier, pieces) of each sequence, for documents of these numbers of tokens.

    A document gives full windows first. What is left of it is routed to the
    smallest tier that holds it and packed whole, into a gap of a longer window
    or into a window of its tier; only the gaps that then remain are closed by
    cutting, within a tier. At most one window of each tier ends short; it is
    cut into powers of two, which need no padding.
    """
    size = tiers[-1]
    out: list[tuple[int, list[Piece]]] = []
    tails: list[Piece] = []
    for doc, n in enumerate(lengths):
        whole = n // size * size
        out += [(size, [(doc, s, size)]) for s in range(0, whole, size)]
        if n > whole:
            tails.append((doc, whole, n - whole))
    for tier, windows in _fill(tails, tiers).items():
        for w in _close_gaps(windows, tier):
            if sum(p[2] for p in w) == tier:
                out.append((tier, w))
            else:
                out += [(tier_of(sum(p[2] for p in part), tiers), part) for part in _by_powers(w)]
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], step: int = STEP) -> list[int]:
    """A step group for each sequence: one tier, about ``step`` sequences, even attention cost.

    Cost is the sum of the squared piece lengths. Within a tier, sequences are
    dealt out from the costliest on, forth and back over the groups.
    """
    group, first = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}):
        own = [i for i, (t, _) in enumerate(sequences) if t == tier]
        own.sort(key=lambda i: -sum(p[2] ** 2 for p in sequences[i][1]))
        n = -(-len(own) // step)
        for k, i in enumerate(own):
            lap, at = divmod(k, n)
            group[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return group


def _packer(tiers: tuple[int, ...], end_id: int, step: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        names, tokens = [], []
        for name, ids in block_documents(docs, lists):
            names.append(name)
            tokens.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
        sequences = pack_lengths([len(t) for t in tokens], tiers)
        groups = step_groups(sequences, step)
        first = docs.column("block")[0].as_py() << 20
        cols: list[list] = [[] for _ in range(9)]
        for k, (tier, pieces) in enumerate(sequences):
            at = 0
            for doc, start, n in pieces:
                row = (names[doc], start, n, tokens[doc][start : start + n].tobytes(), len(tokens[doc]), first + k, at, tier, first + groups[k])
                for c, v in zip(cols, row):
                    c.append(v)
                at += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(
    docs: DataFrame, path: str, split: Callable = spaced_words, tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID, step: int = STEP, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pieces of documents and their places in sequences (``PIECES``); ``token_bytes`` are the
    piece's ids as little-endian unsigned 32-bit integers.

    Documents are tokenised through the distinct-word table (``bpe``) and packed
    within blocks of a bounded size, so no task sees more than a block and none
    waits for another. Every id lies in one piece. A block leaves at most one
    window of each tier short, which is cut into powers of two.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they occur; a null doc_id stands as the lowest id; an empty table gives
    no pieces.
    """
    return by_block(*word_coded(docs, path, split, block_chars), _packer(tiers, end_id, step), PIECES)
