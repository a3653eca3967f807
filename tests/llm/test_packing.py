from __future__ import annotations

import bisect
import zlib

import numpy as np
import pytest

from hourvault.llm import packing
from hourvault.llm.tokens import default_tokenizer


def best_fit_decreasing(counts, capacity):
    """Bins and remaining capacities, piece by piece."""
    remaining, bins = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(remaining, length)
            room = remaining.pop(at) if at < len(remaining) else capacity
            bins += room == capacity
            if room > length:
                bisect.insort(remaining, room - length)
    return bins, remaining


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_best_fit_decreasing(seed):
    random = np.random.default_rng(seed)
    capacity = int(random.choice([7, 16, 100, 1024]))
    counts = {int(n): int(random.integers(1, 60)) for n in random.integers(1, capacity + 1, random.integers(0, 40))}
    runs, bins = packing.plan_bins(counts, capacity)
    places: dict[int, list[tuple[int, int]]] = {}
    for length, n in counts.items():
        own = sorted((r for r in runs if r.length == length), key=lambda r: r.low)
        assert [r.low for r in own] + [n] == [0] + [r.high for r in own]
        for r in own:
            for i in range(r.high - r.low):
                places.setdefault(r.bin + i // r.each, []).append((r.offset + i % r.each * length, length))
    remaining = []
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
        remaining += [capacity - end] * (end < capacity)
    assert (len(places), sorted(remaining)) == best_fit_decreasing(counts, capacity) and bins == len(places)


def check(rows, got, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    pieces = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        ends = list(range(first, len(ids) + 1, capacity))
        for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            pieces.append((key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda p: (p[0] is not None, p[0] or 0, *p[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(pieces, key=key)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    counts: dict[int, int] = {}
    for p in pieces:
        counts[p[3]] = counts.get(p[3], 0) + 1
    assert len(bins) == best_fit_decreasing(counts, capacity)[0]


def test_pieces_fill_sequences_without_gaps(spark):
    rows = [(i, f"some words {i} " * (i % 13)) for i in range(150)] + [(7, "twice"), (7, "twice"), (None, "no key"), (200, None), (201, "long " * 500)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, length int, part string").repartition(5)
    check(rows, packing.packed(df, capacity=32).collect(), 32)


def test_one_hot_length(spark):
    rows = [(i, "same text here") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(rows, packing.packed(df, capacity=16).collect(), 16)


def test_pieces_may_carry_their_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    for r in packing.packed(df, capacity=4, ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
