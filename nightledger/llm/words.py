"""Words, lines and counts of many texts at once, as flat arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space between words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PIECE = 2 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, and where each row begins; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of text; a longer text is a run of its own."""
    _, at = flat(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of every text: ``start`` and ``end`` in ``data``, and ``first[i]``, the first word of text i."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        space = SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        before[inner], after[inner - 1] = True, True
        self.space = space
        self.start, self.end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, at)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def values(self) -> pa.BinaryArray:
        """Every word as bytes."""
        kept = self.data[~self.space]
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])

    def ids(self) -> np.ndarray:
        """A number for every word; equal numbers mean equal words."""
        return self.values().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the marked places lie in each [at[i], at[i + 1])."""
    run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return run[at[1:]] - run[at[:-1]]


def mixed(values: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits (the finalizer of splitmix64), one to one."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit mark for each word [start, end) of the bytes: a sum of numbers scattered by byte and place in the word.

    A polynomial would give words of a regular build (such as two letters in the order of Thue and Morse) equal marks
    whatever its factor; here every place has numbers of its own.
    """
    place = np.zeros(len(data), np.int64)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data)), place, out=place)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed((place << 8) | data), out=run[1:])
    return mixed(run[end] - run[start] + (end - start).astype(np.uint64))


def grams(symbols: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit mark for each run of ``length`` symbols; runs may cross texts."""
    out = np.zeros(max(0, len(symbols) - length + 1), np.uint64)
    for j in range(length):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + symbols[j : j + len(out)].astype(np.uint64) + np.uint64(j + 1))
    return out
