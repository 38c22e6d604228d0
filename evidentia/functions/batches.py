"""Arrow batches worked off in slices, so that a worker holds Python objects for a few texts and not for a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts whose Python objects are held at a time, and rows that leave together.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 50_000


def slices(batch: pa.RecordBatch, texts: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """The batch in parts of SLICE_BYTES in the named columns, beyond their last row; nothing of it is copied."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts))
    begin = done = 0
    while begin < batch.num_rows:
        end = min(int(np.searchsorted(ends, done + SLICE_BYTES)) + 1, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin, done = end, int(ends[end - 1])


def row_batches(batch: pa.RecordBatch, found: Callable[[str], Iterable[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, *found) of the batch's texts; null texts give none. At most SLICE_ROWS rows are held."""
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ((),) * len(schema), schema, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for part in slices(batch):
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            for row in found(text) if text is not None else ():
                out.append((doc_id, *row))
                if len(out) >= SLICE_ROWS:
                    yield rows()
    yield rows()
