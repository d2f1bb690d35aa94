"""Arrow and NumPy helpers that work on whole batches of texts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; longer single texts are handled alone.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts take about ``limit`` bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column, compact and with null as the empty text."""
    return pa.concat_arrays([pc.fill_null(batch[column].cast(pa.string()), "")])


def data_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a compact string array."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32, len(strings) + 1, strings.offset * 4)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends.astype(np.int64) - ends[0], body[ends[0]:ends[-1]]


def strings_of(offsets: np.ndarray, body: np.ndarray) -> pa.Array:
    """String array over given bytes."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body)))


def words(lowered: pa.Array, table: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order and the number of words of each text.

    Words are runs without ASCII white space; ``table`` first replaces bytes one by one.
    """
    offsets, body = data_of(lowered)
    if table is not None:
        lowered = strings_of(offsets, table[body])
    parts = pc.ascii_split_whitespace(lowered)
    flat, ends = parts.values, parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(upto[ends])


def lists_of(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """List array with ``counts`` values per row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def batch_like(batch: pa.RecordBatch, keep: list[str], **added: pa.Array) -> pa.RecordBatch:
    """Kept columns of ``batch`` and new ones."""
    return pa.RecordBatch.from_arrays([batch[c] for c in keep] + list(added.values()), names=keep + list(added))


def add_lists(df, names: list[str], element: str = "int"):
    """Schema of ``df`` with list columns appended, as a DDL-free StructType."""
    from pyspark.sql import types as T
    kind = {"int": T.IntegerType(), "long": T.LongType()}[element]
    return T.StructType(list(df.schema.fields) + [T.StructField(n, T.ArrayType(kind, False)) for n in names])
