"""Arrow string batches as flat byte arrays: words, hashes and 64-bit mixing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_POSITIONS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters neighbouring values (splitmix64)."""
    x = np.asarray(x).astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x += U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


# One random word for each byte value at each of the first positions of a word.
_TABLE = mix(np.arange(_POSITIONS * 256, dtype=U64) + U64(1 << 40))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256, true for the byte values in the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches by bytes of one string column, so that work arrays stay small.

    A single longer text is a batch of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, at = flat_bytes(batch.column(column))
        first = 0
        while first < n:
            last = int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1
            last = min(n, max(last, first + 1))
            yield batch.slice(first, last - first)
            first = last


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes; a run also ends where a text ends."""
    n = len(is_word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] = is_word[edges]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    edges = edges[edges > 0] - 1
    ends[edges] = is_word[edges]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: equal spans, equal hashes wherever they stand.

    Spans are in order and do not overlap. Each byte adds a random word chosen by
    its value and its place in the span; the sum and the length are scattered.
    """
    if len(starts) == 0:
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    total = int(first[-1] + lengths[-1])
    place = np.arange(total, dtype=np.int32 if total < 2**31 else np.int64)
    shift = np.repeat((starts - first).astype(place.dtype), lengths)
    chars = data[place + shift]
    place -= np.repeat(first.astype(place.dtype), lengths)
    if int(lengths.max()) <= _POSITIONS:
        values = _TABLE[(place << 8) | chars]
    else:
        near = place < _POSITIONS
        values = np.empty(total, U64)
        values[near] = _TABLE[(place[near] << 8) | chars[near]]
        far = ~near
        values[far] = mix((place[far].astype(U64) << U64(8)) + chars[far] + U64(1 << 41))
    sums = np.add.reduceat(values, first)
    return mix(sums ^ (lengths.astype(U64) << U64(56)))


class Words:
    """Words of a batch of texts: `doc` (row), `start`, `end` and `hash` of each, `first` (n + 1) by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        self.start, self.end = spans(word_bytes[data], offsets)
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.hash = span_hashes(data, self.start, self.end)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, end to end."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def window_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values, rows given by n + 1 offsets; empty rows are 0."""
    if values.dtype == np.float32:
        values = values.astype(np.float64)
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return running[first[1:]] - running[first[:-1]]
