"""Arrow batches in slices of bounded size, for work that makes Python objects of each row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice, and what a row counts besides its text.
BYTES = 1 << 20
ROW = 64


def slices(batches: Iterable[pa.RecordBatch], *texts: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about `most` bytes of the text columns `texts`; a longer row is a slice of its own.

    A batch holds up to ten thousand rows however long they are, so objects made of all of its rows
    at once grow with the length of texts and with how full batches are.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.full(batch.num_rows, ROW, dtype=np.int64)
        for i in texts:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64)
        part = np.cumsum(size) // most
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
            yield batch.slice(int(a), int(b - a))
