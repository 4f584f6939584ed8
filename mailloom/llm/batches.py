"""Cut Arrow batches so that a task's memory follows a bound and not the length of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text is worked on alone.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], *columns: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts in the given columns take about `most` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(np.nan_to_num(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(float)) for c in columns)
        part = (np.cumsum(size) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
