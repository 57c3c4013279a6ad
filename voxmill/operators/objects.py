"""Objects as runs of flat rows: a task's rows are sorted by object, and Python takes one object after the other off the stream.

So neither the JVM nor a worker holds more than one object and one batch of rows, however many there are in a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows of a batch that goes back to the JVM, about.
BYTES, ROWS = 4_000_000, 2000


def _pieces(batches: Iterable[pa.RecordBatch], n_keys: int = 1) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of batches with one key in the first columns each, and if the key is not that of the slice before; null equals null."""
    last = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for key in batch.columns[:n_keys]:
            value, known = np.asarray(key.fill_null(0)), np.asarray(key.is_valid())
            new |= (value[1:] != value[:-1]) | (known[1:] != known[:-1])
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for i, j in zip(ends, ends[1:], strict=False):
            now = tuple(key[i].as_py() for key in batch.columns[:n_keys])
            yield now != last, batch.slice(i, j - i)
            last = now


def runs(batches: Iterable[pa.RecordBatch], n_keys: int = 1) -> Iterator[tuple[int | None, pa.Table]]:
    """(first key, rows) of each run of equal values in the first columns."""
    held: list[pa.RecordBatch] = []
    for new, piece in _pieces(batches, n_keys):
        if new and held:
            yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
            held = []
        held.append(piece)
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def run_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[pa.RecordBatch]]]:
    """The same, with the rows as an iterator of batches that must be used up before the next run."""
    stream = _pieces(batches)
    ahead = next(stream, None)

    def parts() -> Iterator[pa.RecordBatch]:
        nonlocal ahead
        while ahead is not None:
            yield ahead[1]
            ahead = next(stream, None)
            if ahead is not None and ahead[0]:
                return

    while ahead is not None:
        yield ahead[1].column(0)[0].as_py(), parts()


def numbers(rows: pa.Table, *names: str) -> np.ndarray:
    """Columns side by side; of whole numbers, or with not-a-number for null."""
    return np.column_stack([rows[n].to_numpy() for n in names])


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches that stay small, also where a value is large."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, bytes) else 8 for x in row)
        if size > BYTES or len(held) >= ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def lists(values: np.ndarray, width: int) -> pa.ListArray:
    """Rows of so many values as an array of arrays, without Python objects for them."""
    flat = np.ascontiguousarray(values).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def nested(each: list[np.ndarray], width: int, kind: type) -> pa.ListArray:
    """One array of arrays for each object."""
    ends = np.cumsum([0, *(len(x) for x in each)]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, kind).reshape(-1, width) for x in each]) if each else np.zeros((0, width), kind)
    return pa.ListArray.from_arrays(pa.array(ends), lists(flat, width))


def opened(column: pa.ListArray, row: int, width: int) -> np.ndarray:
    """An object's array of arrays as rows of an array, without Python objects for them."""
    held = column[row].values
    return np.asarray(held.flatten()).reshape(-1, width) if held is not None else np.zeros((0, width))
