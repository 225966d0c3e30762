"""Sorted Arrow rows, a run of equal keys at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The sorted rows again, such that no value of ``column`` is in two of the tables."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= 20_000:
            table = pa.Table.from_batches(held)
            keys = table.column(column).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield table.slice(0, last)
                held, rows = table.slice(last).to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
