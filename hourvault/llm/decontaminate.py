"""Benchmark windows in documents by Wu-Manber matching over words (operator 10).

Texts become words (A-Z lower-cased; runs of digits, letters and non-ASCII
bytes). Every 10 consecutive words of an item, or a shorter item as a whole, is
a pattern; patterns of one length m form a matcher with blocks of two words:

- the shift table tells, by the hash of the two words that end a window, how
  many words the window may move on before it could end a pattern (up to m - 1);
- where the shift is 0, the suffix bucket of that block names the patterns that
  end so;
- each is then compared with the text directly, word length by word length and
  byte by byte.

Texts are scanned in lanes that move on together, so numpy does each step for
thousands of windows. Tasks build the patterns from blocks of items of bounded
size and write them as files to the shared folder, each attempt under names of
its own; the driver gets the names. A task scans with one block after another,
so nobody holds more than one. With several blocks, each is loaded once for
every CHUNK_BYTES of text.

Documents are read once and not shuffled; items are dealt evenly over the tasks
that build blocks.

Defined cases: a null or wordless text has no words and no hits; a wordless
item has no window. Rows of one item_id are one item; an item without an id
marks words as hit but is not listed. With no items, nothing is hit.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.llm.flat import LOWER, U64, Words, byte_set, flat_bytes, mix, ragged, small_batches
from hourvault.llm.worker import kept, lean
from hourvault.session import scratch_path
from hourvault.sources.storage import open_storage

WINDOW = 10
BLOCK_WORDS = 2
#: Bytes of item texts that one block of patterns is built from.
BLOCK_BYTES = 16 << 20
#: Text scanned at a time.
BATCH_BYTES = 1 << 20
#: Text that is scanned with one block before the next is loaded, if there are several.
CHUNK_BYTES = 8 << 20
#: Window ends that one lane goes through.
LANE = 256
WORD_BYTES = byte_set((48, 57), (97, 122), (128, 255))
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _join(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several words in their order."""
    out = np.zeros(len(hashes[0]), U64)
    for h in hashes:
        out = mix(out ^ h) + U64(0x9E3779B97F4A7C15)
    return out


class Matcher:
    """Wu-Manber tables for patterns of `m` words."""

    def __init__(self, m: int, words: Words, begins: np.ndarray):
        """Patterns begin at the given words; each distinct one once."""
        self.m, self.block = m, min(BLOCK_WORDS, m)
        hashes = _join([words.hash[begins + k] for k in range(m)])
        self.hash, first, self.pattern_of = np.unique(hashes, return_index=True, return_inverse=True)
        begins = begins[first]
        n = len(begins)
        # Bytes of each pattern's words, for the direct comparison.
        at = begins[:, None] + np.arange(m)
        self.lengths = (words.end - words.start)[at]
        chars = words.data[ragged(words.start[at].ravel(), self.lengths.ravel())]
        self.chars, self.first_char = chars, np.concatenate([[0], np.cumsum(self.lengths.sum(1))])
        # Shift table: the least way from a block's place in any pattern to the pattern's end.
        size = 1 << max(12, int(n * m * 4).bit_length())
        self.mask = U64(size - 1)
        self.shift = np.full(size, m - self.block + 1, np.min_scalar_type(m))
        for end in range(self.block, m + 1):
            block = _join([words.hash[begins + end - self.block + k] for k in range(self.block)])
            np.minimum.at(self.shift, (block & self.mask).astype(np.int64), self.shift.dtype.type(m - end))
            if end == m:
                order = np.argsort(block, kind="stable")
                self.bucket_hash, self.bucket = block[order], order

    def ends(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last word, pattern) of every occurrence in a batch of texts."""
        first, last = words.first[:-1] + self.m - 1, words.first[1:]
        lanes = np.maximum(0, -(-(last - first) // LANE))
        lane = ragged(np.zeros(len(lanes), np.int64), lanes)
        at = np.repeat(first, lanes) + lane * LANE
        stop = np.minimum(at + LANE, np.repeat(last, lanes))
        found_at, found = [], []
        while len(at):
            block = _join([words.hash[at - self.block + 1 + k] for k in range(self.block)])
            shift = self.shift[(block & self.mask).astype(np.int64)]
            stay = np.flatnonzero(shift == 0)
            if len(stay):
                ends, patterns = self._candidates(at[stay], block[stay])
                same = self._same(words, ends, patterns)
                found_at.append(ends[same])
                found.append(patterns[same])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def _candidates(self, ends: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns of the suffix bucket of each window."""
        low = np.searchsorted(self.bucket_hash, block, side="left")
        n = np.searchsorted(self.bucket_hash, block, side="right") - low
        return np.repeat(ends, n), self.bucket[ragged(low, n)]

    def _same(self, words: Words, ends: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """Direct comparison: first by the lengths of all words, then by their bytes."""
        same = np.zeros(len(ends), bool)
        if not len(ends):
            return same
        at = ends[:, None] - self.m + 1 + np.arange(self.m)
        lengths = (words.end - words.start)[at]
        close = np.flatnonzero((lengths == self.lengths[patterns]).all(1))
        if not len(close):
            return same
        lengths = lengths[close]
        text = words.data[ragged(words.start[at[close]].ravel(), lengths.ravel())]
        total = lengths.sum(1)
        pattern = self.chars[ragged(self.first_char[patterns[close]], total)]
        first = np.cumsum(total) - total
        same[close] = np.logical_and.reduceat(text == pattern, first)
        return same


class Patterns:
    """The matchers of a block of items, one for each pattern length."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        data, offsets = flat_bytes(pa.array(texts, pa.large_string()))
        words = Words(data, offsets, WORD_BYTES)
        n = np.diff(words.first)
        length = np.minimum(n, window)
        windows = np.where(n > 0, n - length + 1, 0)
        begins = ragged(words.first[:-1], windows)
        owner = np.repeat(np.arange(len(n)), windows)
        self.ids = ids
        self.matchers: list[tuple[Matcher, np.ndarray, np.ndarray]] = []
        for m in np.unique(length[n > 0]).tolist():
            own = length[owner] == m
            matcher = Matcher(m, words, begins[own])
            # Items of each pattern, as rows of a table: first row by pattern, then items.
            order = np.argsort(matcher.pattern_of, kind="stable")
            items = owner[own][order]
            first = np.concatenate([[0], np.cumsum(np.bincount(matcher.pattern_of, minlength=len(matcher.hash)))])
            self.matchers.append((matcher, first, items))

    def dump(self) -> bytes:
        """As plain arrays, which any worker can load, whether or not it can import this module."""
        return pickle.dumps((self.ids, [(vars(matcher), first, items) for matcher, first, items in self.matchers]), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Patterns:
        out = cls.__new__(cls)
        out.ids, stored = pickle.loads(data)
        out.matchers = []
        for fields, first, items in stored:
            matcher = Matcher.__new__(Matcher)
            vars(matcher).update(fields)
            out.matchers.append((matcher, first, items))
        return out

    def scan(self, words: Words, marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Add hits to `marks` (+1 at a hit's first word, -1 after its last); pairs (text, item) found."""
        pairs = []
        for matcher, first, items in self.matchers:
            ends, patterns = matcher.ends(words)
            np.add.at(marks, ends - matcher.m + 1, 1)
            np.add.at(marks, ends + 1, -1)
            rows = np.searchsorted(words.first, ends, side="right") - 1
            pair = np.unique(np.stack([rows, patterns]), axis=1)
            n = first[pair[1] + 1] - first[pair[1]]
            pairs.append((np.repeat(pair[0], n), items[ragged(first[pair[1]], n)]))
        return pairs


def write_patterns(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> list[str]:
    """Files of pattern blocks in the shared folder, built and written by tasks."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()["bytes"]
    folder = scratch_path(spark, "patterns")
    filesystem, base = open_storage(folder)
    filesystem.create_dir(base, recursive=True)

    def write(ids: list[str | None], texts: list[str]) -> pa.RecordBatch:
        name = f"{folder}/{uuid.uuid4().hex}"
        store, path = open_storage(name)
        with store.open_output_stream(path) as out:
            out.write(Patterns(ids, texts, window).dump())
        return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids += batch.column("item").to_pylist()
            texts += batch.column("text").to_pylist()
            size += batch.column("text").nbytes
            if size >= block_bytes:
                yield write(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield write(ids, texts)

    # At most two names for each block_bytes of items.
    found = rows.repartition(max(1, -(-held // block_bytes))).mapInArrow(lean(build), "file string").collect()
    return sorted(row["file"] for row in found)


def _load(file: str) -> Patterns:
    filesystem, path = open_storage(file)
    with filesystem.open_input_stream(path) as source:
        return Patterns.load(source.read())


class _Scan:
    """Words, hit words and items of the texts of a batch, block of patterns by block."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        self.batch = batch
        self.words = Words(*flat_bytes(batch.column(text)), WORD_BYTES)
        self.marks = np.zeros(len(self.words.start) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(batch.num_rows)]

    def add(self, patterns: Patterns) -> None:
        for rows, found in patterns.scan(self.words, self.marks):
            for row, i in zip(rows.tolist(), found.tolist(), strict=True):
                if patterns.ids[i] is not None:
                    self.items[row].add(patterns.ids[i])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.marks[:-1]) > 0)])
        return np.diff(self.words.first), hit[self.words.first[1:]] - hit[self.words.first[:-1]]


def _scans(batches: Iterator[pa.RecordBatch], text: str, files: list[str]) -> Iterator[_Scan]:
    """Every batch, cut small, scanned with all blocks."""
    most = CHUNK_BYTES if len(files) > 1 else BATCH_BYTES
    waiting: list[_Scan] = []
    size = 0

    def finish() -> Iterator[_Scan]:
        for file in files:
            # A single block stays in the worker; of several, one is held at a time.
            patterns = kept(("patterns", file), lambda: _load(file)) if len(files) == 1 else _load(file)
            for scan in waiting:
                scan.add(patterns)
        yield from waiting

    for batch in small_batches(batches, text, BATCH_BYTES):
        waiting.append(_Scan(batch, text))
        size += len(waiting[-1].words.data)
        if size >= most or len(files) <= 1:
            yield from finish()
            waiting, size = [], 0
    yield from finish()


def find_leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated."""
    files = write_patterns(benchmark, item, item_text, window, block_bytes)
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _scans(batches, "text", files):
            n_words, n_hit = found.counts()
            listed = [sorted(x) for x in found.items]
            yield pa.RecordBatch.from_arrays(
                [
                    found.batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
                    pa.array(n_hit > 0),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"],
            )

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    return rows.mapInArrow(lean(scan), schema)


def without_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a frame, all columns as they are, whose text holds no benchmark window."""
    files = write_patterns(benchmark, "item_id", "text", WINDOW, BLOCK_BYTES)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _scans(batches, text, files):
            yield found.batch.filter(pa.array(found.counts()[1] == 0))

    return df.mapInArrow(lean(keep), df.schema)


def lower_words(text: str) -> list[bytes]:
    """The words of one text, by the same rule; for tests."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    words = Words(data, np.array([0, len(data)]), WORD_BYTES)
    return [data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
