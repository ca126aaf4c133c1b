"""Groups of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows with equal first column, of a stream sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(key)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if at == to:
                continue
            if held and held[-1].column(0)[0].as_py() != key[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)
