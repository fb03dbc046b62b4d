"""Fill-in-middle: a text cut into prefix, middle and suffix, told in another order.

Cuts are made on the UTF-8 bytes, where a line ends at a newline byte. What a
cut is worth in code points comes from an index that holds the exceptions only:
the places of the multibyte characters and the bytes that each has beyond one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import body

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Texts in a hundred that are rearranged, and of these those that start with the suffix.
FIM_RATE, SPM_RATE = 100, 50
SEED = 7


class Exceptions:
    """Positions of a text's multibyte characters and the excess bytes up to each.

    Between exceptions a code point is a byte, so positions convert by one
    subtraction; ``searchsorted`` finds how many exceptions lie before a cut. An
    ASCII text has none.
    """

    def __init__(self, raw: np.ndarray):
        self.bytes = np.flatnonzero(raw >= 0xC0)  # lead bytes
        lead = raw[self.bytes]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))))
        self.points = self.bytes - self.excess[:-1]

    def point(self, at: int) -> int:
        """Code points before byte ``at``, the start of a character or the end of the text."""
        return int(at - self.excess[np.searchsorted(self.bytes, at)]) if len(self.bytes) else int(at)

    def byte(self, at: int) -> int:
        """Bytes before code point ``at``."""
        return int(at + self.excess[np.searchsorted(self.points, at)]) if len(self.bytes) else int(at)


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte positions after each line; the last line may lack its newline."""
    ends = np.flatnonzero(raw == 0x0A) + 1
    return ends if not len(raw) or (len(ends) and ends[-1] == len(raw)) else np.append(ends, len(raw))


def draws(doc_id: str | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 from the document's id; a null id counts as no digits."""
    told = f"{seed}:{'' if doc_id is None else doc_id}"
    return np.frombuffer(hashlib.sha256(told.encode()).digest(), ">u4", 4).tolist()


def _check(marks: tuple[str, str, str]) -> None:
    """Marks can be found again if none can begin inside a mark or reach over its end."""
    firsts = {m[:1] for m in marks}
    if len(set(marks)) < 3 or "" in marks or any(c in firsts for m in marks for c in m[1:]):
        raise ValueError("marks must differ, and their first characters occur nowhere else in them")


OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def rearranged(
    docs: DataFrame, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """row (all columns of ``docs``), n, form, prefix_chars, middle_chars, output.

    A text of n lines is cut after two numbers of lines drawn from its doc_id. The
    form is ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first), each
    part behind its mark; or ``plain``, the text as it is, if the draw says so
    or the text is empty or holds a mark. Lengths are in code points and null in
    plain texts.

    A null text is empty, a null doc_id draws as no digits; rows that share a
    doc_id draw alike, so equal rows have equal results. An empty table gives an
    empty table. Every row stands for itself: there is no shuffle, and a text
    costs time and memory in proportion to its length.
    """
    _check(marks)
    names = [x.encode() for x in marks]
    prefix_mark, suffix_mark, middle_mark = names

    @F.pandas_udf(OUT)
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, doc_id in zip(*batch):
                h1, h2, h3, h4 = draws(doc_id, seed)
                data = text.encode()
                raw = np.frombuffer(data, np.uint8)
                ends = line_ends(raw)
                n = len(ends)
                if not n or h3 % 100 >= fim_rate or any(x in data for x in names):
                    out.append((n, "plain", None, None, text))
                    continue
                index = Exceptions(raw)
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
                # told in code points, and the parts taken at the bytes that these stand for
                p, m = index.point(a), index.point(b)
                a, b = index.byte(p), index.byte(m)
                prefix, suffix = prefix_mark + data[:a], suffix_mark + data[b:]
                form = "spm" if h4 % 100 < spm_rate else "psm"
                start = suffix + prefix if form == "spm" else prefix + suffix
                out.append((n, form, p, m - p, (start + middle_mark + data[a:b]).decode()))
            frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(F.struct(*docs.columns).alias("row"), cut(body(), F.col("doc_id").cast("string")).alias("out"))
    return rows.select("row", "out.*")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from."""
    _check(marks)
    # rearranged texts hold each mark once, so splitting gives what stood before the first mark (nothing) and the three parts
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return (
        F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
    )
