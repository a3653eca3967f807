"""Best-fit-decreasing packing of whole corpora into fixed-length sequences (operator 3).

Documents longer than a sequence are cut into full pieces, the first piece
taking what is left over. Best fit decreasing sees only lengths, and there are
as many lengths as tokens in a sequence, so the plan is made from the counts by
length: for each length, longest first, a segment tree over remaining
capacities finds the tightest open bins in logarithmic time, and a whole class
of equal bins is filled at once, as placing the pieces one by one would. The
plan is a list of runs ("pieces lo to hi of this length go to bins from b, k a
bin, from offset o"), at most a few thousand, whatever the corpus. The pieces
then find their places in parallel: a piece's number in its length is its
number within its task plus the pieces of that length in earlier tasks.

Defined cases: a null text is the end id alone. Repeated rows, and rows without
a key, are packed each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.flat import flat_bytes, small_batches
from hourvault.llm.tokens import default_tokenizer, encoder
from hourvault.llm.worker import lean

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Text encoded at a time.
BATCH_BYTES = 1 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def cut_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE_TOKENS,
    tokenizer: str | None = None, end_id: int = END_ID, ids: bool = False,
) -> DataFrame:
    """Encode every text and cut it: one row a piece, numbered by length within its task. With `ids`, its ids too."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            found, bounds = ids_of.encode(*flat_bytes(batch.column("text")))
            rows: list[list] = [[] for _ in range(6)]
            pieces = []
            for doc in range(batch.num_rows):
                own = np.append(found[bounds[doc] : bounds[doc + 1]].astype("<u4"), np.uint32(end_id)).astype("<u4")
                ends = list(range((len(own) - 1) % capacity + 1, len(own) + 1, capacity))
                begin = 0
                for piece, end in enumerate(ends):
                    length = end - begin
                    values = (doc, piece, begin, length, zlib.crc32(own[begin:end].tobytes()), seen[length])
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    if ids:
                        pieces.append(own[begin:end].astype(np.int32))
                    seen[length] += 1
                    begin = end
            doc, piece, start, length, crc, number = rows
            columns = [
                batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([part] * len(doc), pa.int32()), pa.array(number, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
            if ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lean(cut), _PIECES + (", ids array<int>" if ids else "")
    )


# ------------------------------------------------------------------- planning


class CapacityTree:
    """Segment tree over remaining capacities: how many bin classes are open at each."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.open = np.zeros(2 * self.leaves, np.int64)

    def add(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += change
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest open capacity that is at least this length."""
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces `low` to `high` of a length go to bins from `bin` on, `each` to a bin, the first at `offset`."""

    length: int
    low: int
    high: int
    bin: int
    each: int
    offset: int


def plan_bins(counts: dict[int, int], capacity: int = SEQUENCE_TOKENS) -> tuple[list[Run], int]:
    """Best fit decreasing over counts by length: the runs, and the number of bins."""
    tree, runs, bins = CapacityTree(capacity), [], 0
    classes: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: first bin, number of bins

    def reopen(remaining: int, first: int, number: int) -> None:
        if remaining and number:
            classes.setdefault(remaining, []).append((first, number))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        placed, total = 0, counts[length]
        while placed < total:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, number = bins, -(-(total - placed) // (capacity // length))
                bins += number
            else:
                first, number = classes[room].pop()
                tree.add(room, -1)
            each, left = room // length, total - placed
            full = min(number, left // each)
            fills = [(each, full)]
            if full < number:  # fewer than fill a bin are left: they go to one more
                fills.append((left - full * each, 1))
            for size, take in fills:
                if size and take:
                    runs.append(Run(length, placed, placed + size * take, first, size, capacity - room))
                    placed += size * take
                    reopen(room - size * length, first, take)
                    first, number = first + take, number - take
            if room < capacity:
                reopen(room, first, number)
    return runs, bins


# -------------------------------------------------------------------- packing


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Give each piece of a written table of `cut_documents` its sequence_id and offset."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # One row a length: at most `capacity` of them.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(counts, capacity)
    runs.sort(key=lambda r: (r.length, r.low))
    plan = {f: np.array([getattr(r, f) for r in runs], np.int64) for f in ("length", "low", "bin", "each", "offset")}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_run = np.searchsorted(plan["length"], np.arange(capacity + 2))
        for frame in frames:
            length = frame["length"].to_numpy()
            number = frame["base"].to_numpy() + frame["number"].to_numpy()
            run = np.empty(len(frame), np.int64)
            for value in np.unique(length):
                at = length == value
                a, b = first_run[value], first_run[value + 1]
                run[at] = a + np.searchsorted(plan["low"][a:b], number[at], side="right") - 1
            in_run = number - plan["low"][run]
            frame["sequence_id"] = plan["bin"][run] + in_run // plan["each"][run]
            frame["offset"] = plan["offset"][run] + in_run % plan["each"][run] * length
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame.drop(columns=["base", "number", "part"])

    kept = [c for c in pieces.columns if c not in ("part", "number")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "sequence_id long", "offset long"])
    return pieces.join(bases, ["length", "part"]).select(*pieces.columns, "base").mapInPandas(place, schema)


def packed(df: DataFrame, **options) -> DataFrame:
    """Cut and pack all rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    capacity = options.get("capacity", SEQUENCE_TOKENS)
    return pack(stored.written(cut_documents(df, **options), "pieces"), capacity)
