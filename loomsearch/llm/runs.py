"""Groups of consecutive equal keys in the sorted batches of a task, without a call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """(batch, start, stop) of each group; the first ``keys`` columns are integers and the rows are sorted by them."""
    rest: pa.Table | None = None
    for batch in [*batches, None] if isinstance(batches, list) else _ended(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None or not table.num_rows:
            continue
        whole = table.combine_chunks().to_batches()[0]
        n = whole.num_rows
        change = np.zeros(n, bool)
        for c in range(keys):
            x = whole.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        stops = np.append(starts[1:], n)
        if batch is not None:
            rest = pa.Table.from_batches([whole.slice(starts[-1])])
            starts, stops = starts[:-1], stops[:-1]
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            yield whole, a, b


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
