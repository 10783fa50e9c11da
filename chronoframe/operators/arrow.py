"""Helpers for kernels over sorted Arrow batches."""

import pyarrow as pa
import pyarrow.compute as pc


def bounds(batch: pa.RecordBatch, by: list[str]) -> list[int]:
    """Row numbers at which the values of ``by`` differ from the row before, with 0 and the end. Nulls are equal."""
    n = batch.num_rows
    new = None
    for name in by:
        c = batch.column(name)
        x = pc.not_equal(c.slice(1), c.slice(0, n - 1))
        if c.null_count:
            x = pc.or_(pc.fill_null(x, False), pc.not_equal(c.slice(1).is_null(), c.slice(0, n - 1).is_null()))
        new = x if new is None else pc.or_(new, x)
    return [0, *(int(i) + 1 for i in pc.indices_nonzero(new).to_pylist()), n]


def spans(col: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a binary column and the offset of each row in them."""
    col = col if pa.types.is_large_binary(col.type) else col.cast(pa.large_binary())
    offsets = memoryview(col.buffers()[1]).cast("q")[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b""), list(offsets)
