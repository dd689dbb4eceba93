"""Packing numpy arrays into binary columns, so that a task's many small facts travel as one row per bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tesserae.llm.blocks import utf8


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)])


def unpack(data, kinds: list) -> list[np.ndarray]:
    data = memoryview(data)
    ends = 8 * len(kinds) + np.concatenate([[0], np.cumsum(np.frombuffer(data[: 8 * len(kinds)], np.int64))])
    return [np.frombuffer(data[a:b], k) for a, b, k in zip(ends[:-1], ends[1:], kinds)]


def by_byte(x: np.ndarray) -> np.ndarray:
    """The lowest byte of each number, then the next of each, so that small numbers leave runs of zeros that compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).ravel()


def from_bytes(x: np.ndarray, kind) -> np.ndarray:
    """The numbers that by_byte took apart."""
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_texts: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in order, together until their texts reach a size: the rows without ``column``, bytes, offsets.
    A longer text is a block of its own."""
    waiting: list[pa.RecordBatch] = []
    size = count = 0

    def block():
        table = pa.Table.from_batches(waiting)
        return (table.drop_columns([column]), *utf8(pa.concat_arrays([w.column(column) for w in waiting])))

    for batch in batches:
        place = batch.schema.get_field_index(column)
        batch = batch.set_column(place, column, batch.column(place).cast(pa.large_string()))
        texts = batch.column(place)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        i = 0
        while i < len(texts):
            j = int(np.searchsorted(ends, ends[i] + most_bytes - size, "right")) - 1
            j = min(max(j, i + (not waiting)), i + most_texts - count, len(texts))
            if j > i:
                waiting.append(batch.slice(i, j - i))
                size, count = size + int(ends[j] - ends[i]), count + j - i
            if j < len(texts):
                yield block()
                waiting, size, count = [], 0, 0
            i = j
    if waiting:
        yield block()


def spans_union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[head], reach[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(starts) - 1]])]
