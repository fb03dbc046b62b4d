"""Near copies by their word shingles: candidates by MinHash bands, verified by exact resemblance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm import grouped
from terrafold.llm.common import body, key_id
from terrafold.llm.graph import components
from terrafold.llm.sketch import Shingler
from terrafold.session import cut_lineage

SIMILARITY = 0.8
#: A pair of resemblance 0.8 agrees in none of the bands with a chance of 7e-5, one of 0.3 in some with 6e-2.
BANDS, BAND_ROWS = 24, 5
#: Sketches may agree in less than the limit by so many standard deviations before a pair is given up unverified.
SLACK = 5.0

_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64)


def shingle_set(shingler: Shingler, text: str) -> np.ndarray:
    """Hashes of the distinct five-word shingles, ascending; A-Z counts as a-z."""
    return np.unique(shingler.shingles(text.encode().lower().decode()))


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each of the bands' functions the smallest value of a set."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        for k, (f, t) in enumerate(zip(_FACTORS, _TERMS)):
            least[k] = min(least[k], (part * f + t).min())
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One key for each band of minima."""
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - 2**63 for b, r in enumerate(rows)]


def likely(some: np.ndarray, many: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """For each sketch of ``some``, the share of minima that the rows of ``many`` agree in; -1 where it is well below ``similarity``."""
    floor = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / len(_FACTORS))
    for one in some:
        share = (many == one).mean(axis=1)
        yield np.where(share >= floor, share, -1.0)


@F.pandas_udf(T.StructType().add("set", T.LongType()).add("sketch", T.BinaryType()).add("keys", T.ArrayType(T.LongType())))
def _prints(texts: pd.Series) -> pd.DataFrame:
    """A set's hash, 16 bits of each of its minima, and its bands' keys; an empty set has no bands."""
    shingler, out = Shingler(), []
    for t in texts:
        s = shingle_set(shingler, t)
        least = minima(s)
        sketch = (least >> np.uint64(40)).astype(np.uint16)
        out.append((xxhash.xxh64_intdigest(s.tobytes()) - 2**63, sketch.tobytes(), band_keys(least) if len(s) else []))
    return pd.DataFrame(out, columns=["set", "sketch", "keys"])


def alike(size: int, sizes: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets of ``sizes`` have a share of at least ``similarity`` of the union in common with one of ``size``."""
    return both / np.maximum(size + sizes - both, 1) >= similarity


@F.pandas_udf(T.StructType().add("set", T.LongType()).add("hashes", T.BinaryType()))
def _hashes(texts: pd.Series) -> pd.DataFrame:
    shingler = Shingler()
    all_ = [shingle_set(shingler, t).tobytes() for t in texts]
    return pd.DataFrame({"set": [xxhash.xxh64_intdigest(s) - 2**63 for s in all_], "hashes": all_})


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, component.

    Documents whose sets of five-word shingles have a resemblance of at least
    ``similarity`` are linked; ``component`` is the smallest id reachable, a
    null doc_id counting as the smallest. Texts of fewer words are one shingle,
    texts without words are alike. Rows that share a doc_id but not a text are
    separate rows.

    Texts of one set are one node, so a null text is alike with any text without
    words, and repeated rows cost nothing. Nodes that agree in a band are candidates.
    In groups of any size, leaders and blocks (``grouped``) leave the pairs that
    may count, and each of these is verified exactly. An empty table gives an empty table.
    """
    texts = docs.select(key_id().alias("id"), body().alias("text"))
    prints = cut_lineage(texts.withColumn("_p", _prints("text")).select("id", "_p.*"))
    nodes = prints.groupBy("set").agg(F.min("id").alias("id"), F.min("sketch").alias("sketch"), F.any_value("keys").alias("keys"))
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("node"), "id", "set", "sketch", "keys"))

    def sets(used: DataFrame) -> DataFrame:
        wanted = cut_lineage(nodes.select("node", "id", "set").join(used, "node", "left_semi"))
        rows = texts.join(wanted.select("id").distinct(), "id", "left_semi").select("id", _hashes("text").alias("h"))
        return rows.select("id", "h.set", "h.hashes").join(wanted, ["id", "set"]).groupBy("node").agg(F.any_value("hashes").alias("hashes"))

    links = grouped.links(nodes, lambda a, b: likely(a, b, similarity), lambda n, m, both: alike(n, m, both, similarity), sets)
    found = components(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    rooted = cut_lineage(nodes.join(found, nodes.node == found.member, "left").select("set", "id", F.coalesce("root", "node").alias("root")))
    labels = rooted.select("set", "root").join(cut_lineage(rooted.groupBy("root").agg(F.min("id").alias("component"))), "root")
    return prints.select("id", "set").join(cut_lineage(labels.select("set", "component")), "set").select("id", "component")
