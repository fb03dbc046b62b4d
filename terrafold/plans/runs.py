"""Python work on whole series at little cost for each.

``groupBy.applyInPandas`` builds a frame for every group, which takes far longer
than the numbers of a short series do. Here a task's rows come ordered by key,
as Arrow batches; a series is a run of rows with one key, cut out as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from terrafold.plans.ordered import spread

Arrays = dict[str, np.ndarray]


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose key differs from that of the row before; nulls are equal to each other."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        c = table[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, n - 1)
        differs = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _array(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    return column.to_numpy()


def map_runs(
    df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fn: Callable[..., Arrays], outputs: dict[str, str], together: bool = False
) -> DataFrame:
    """All columns of ``df`` and those that ``fn`` adds to each series.

    ``fn`` gets the ``inputs`` of one series in ``order`` as arrays (dates as day
    counts, nulls as NaN) and returns an array of the same length for each
    output. With ``together`` it gets the whole series of a batch as they follow
    each other, and where each one starts. A series must fit into a task; what a task holds at a time is one
    batch and the series that it ends in.
    """
    rows = spread(df, *keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{c}` {t}" for c, t in outputs.items()])

    def done(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = {c: _array(table[c]) for c in inputs}
        ends = [*starts[1:].tolist(), table.num_rows]
        parts: dict[str, list[np.ndarray]] = {c: [] for c in outputs}
        if together:
            parts = {c: [v] for c, v in fn(columns, starts).items()}
        for a, b in [] if together else zip(starts.tolist(), ends):
            for c, v in fn({k: v[a:b] for k, v in columns.items()}).items():
                parts[c].append(v)
        for c in outputs:
            table = table.append_column(c, pa.array(np.concatenate(parts[c])))
        return table.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the series that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(_starts(pa.Table.from_batches([batch]), keys)[-1])
            if held and not cut:
                both = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
                if len(_starts(both, keys)) == 1:  # all of the batch continues the held series
                    held.append(batch)
                    continue
            table = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if table.num_rows:
                yield done(table, _starts(table, keys))
            held = [batch.slice(cut)]
        if held:
            table = pa.Table.from_batches(held)
            yield done(table, _starts(table, keys))

    return rows.mapInArrow(run, schema)
