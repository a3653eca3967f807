from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourvault.operators import grouping
from hourvault.operators.grouping import (
    apply_summary,
    assign_groups,
    compose,
    group_totals,
    number_files,
    summarise_block,
)


def greedy(sizes, target):
    """The rule, one file after the other."""
    number, used, numbers = -1, None, []
    for size in sizes:
        if used is None or used + size > target:
            number, used = number + 1, 0
        used += size
        numbers.append(number)
    return numbers


@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.one_of(st.just(0), st.integers(0, 20), st.integers(0, 90)), min_size=1, max_size=40),
    st.integers(1, 60),
    st.integers(1, 9),
)
def test_blocks_compose_to_the_sequential_rule(sizes, target, length):
    carry, started, numbers = None, 0, []
    for at in range(0, len(sizes), length):
        block = np.array(sizes[at : at + length])
        found, left, next_started = number_files(block, target, carry, started)
        numbers += found.tolist()
        carry, opened = apply_summary(carry, summarise_block(block, target))
        started += opened
        assert (left, next_started) == (carry, started)
    assert numbers == greedy(sizes, target)


@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.one_of(st.just(0), st.integers(0, 20), st.integers(0, 90)), min_size=3, max_size=60),
    st.integers(1, 80),
    st.lists(st.integers(1, 59), min_size=1, max_size=5),
)
def test_composed_summaries_are_that_of_the_whole(sizes, target, cuts):
    """For every size on entry, and for the start of an hour."""
    edges = sorted({0, len(sizes), *(c for c in cuts if c < len(sizes))})
    parts = [summarise_block(np.array(sizes[a:b]), target) for a, b in zip(edges, edges[1:])]
    folded = parts[0]
    for part in parts[1:]:
        folded = compose(folded, part)
    whole = summarise_block(np.array(sizes), target)
    for carry in [None, *range(target + 95)]:
        assert apply_summary(carry, folded) == apply_summary(carry, whole)
    assert len(folded["thresholds"]) <= len(whole["thresholds"])


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_block_functions_meet_over_a_tree(spark, fan):
    """120 blocks of one hour."""
    rng = random.Random(9)
    sizes = [rng.choice([0, rng.randint(1, 40), rng.randint(1, 500)]) for _ in range(600)]
    rows = [("hot", f"f{i:04d}", s) for i, s in enumerate(sizes)] + [("cold", "a", 3), ("cold", "b", 400)]
    files = spark.createDataFrame(rows, "blob_hour string, blob_path string, size long").repartition(3)
    got = {(r.blob_hour, r.blob_path): r.group_no for r in assign_groups(files, 300, block_rows=5, fan=fan).collect()}
    want = {("hot", f"f{i:04d}"): n for i, n in enumerate(greedy(sizes, 300))}
    assert got == want | {("cold", "a"): 0, ("cold", "b"): 1}


def test_exact_fit_and_oversize(spark):
    sizes = [60, 50, 10, 200, 1, 100, 27]
    files = spark.createDataFrame(
        [("h", f"f{i}", s) for i, s in enumerate(sizes)], "blob_hour string, blob_path string, size long"
    )
    rows = assign_groups(files, 120).orderBy("blob_path").collect()
    assert [r.group_no for r in rows] == [0, 0, 0, 1, 2, 2, 3]
    totals = group_totals(assign_groups(files, 120)).orderBy("group_no").collect()
    assert [(r.files_count, r.input_bytes) for r in totals] == [(3, 120), (1, 200), (2, 101), (1, 27)]


@pytest.mark.parametrize("block_rows", [1, 7, 100, 10_000])
def test_crowded_hour_across_blocks(spark, block_rows):
    """One hour holds most files; the block length must not matter."""
    rng = random.Random(5)
    rows = [("hot", f"f{i:05d}", rng.choice([0, rng.randint(1, 50), rng.randint(1, 400)])) for i in range(900)]
    rows += [(f"h{i % 40}", f"g{i:05d}", rng.randint(0, 300)) for i in range(300)]
    if block_rows == 1:
        rows = rows[::10]
    files = spark.createDataFrame(rows, "blob_hour string, blob_path string, size long").repartition(5)
    got = {(r.blob_hour, r.blob_path): r.group_no for r in assign_groups(files, 256, block_rows=block_rows).collect()}
    hours: dict[str, list] = {}
    for hour, path, size in sorted(rows):
        hours.setdefault(hour, []).append((path, size))
    want = {}
    for hour, members in hours.items():
        for (path, _), number in zip(members, greedy([s for _, s in members], 256)):
            want[hour, path] = number
    assert got == want


def test_block_length_bounds_partitions(spark):
    files = spark.range(1000).select(
        F.lit("hot").alias("blob_hour"), F.format_string("f%05d", "id").alias("blob_path"), F.lit(1).cast("long").alias("size")
    )
    rows = assign_groups(files, 10, block_rows=100)
    assert rows.agg(F.max("group_no"), F.count("*")).head()[:] == (99, 1000)


def test_short_blocks_share_tasks(spark, monkeypatch):
    """The number of tasks does not follow from the length of a block; many short blocks are in one partition."""
    pinned = []
    monkeypatch.setattr(grouping, "pin", lambda df, pin=grouping.pin: pinned.append(pin(df)) or pinned[-1])
    monkeypatch.setattr(grouping, "PART_ROWS", 500, raising=False)
    rng = random.Random(3)
    sizes = [rng.choice([0, rng.randint(1, 90)]) for _ in range(3000)]
    rows = [("hot", f"f{i:05d}", s) for i, s in enumerate(sizes)]
    files = spark.createDataFrame(rows, "blob_hour string, blob_path string, size long").repartition(3)
    got = {r.blob_path: r.group_no for r in assign_groups(files, 300, block_rows=7).collect()}
    assert got == {f"f{i:05d}": n for i, n in enumerate(greedy(sizes, 300))}
    assert max(df.rdd.getNumPartitions() for df in pinned) <= 6


def test_empty_listing(spark):
    files = spark.createDataFrame([], "blob_hour string, blob_path string, size long")
    assert assign_groups(files, 10).count() == 0


def test_arguments(spark):
    files = spark.createDataFrame([], "blob_hour string, blob_path string, size long")
    with pytest.raises(ValueError):
        assign_groups(files, 0)
    with pytest.raises(ValueError):
        assign_groups(files, 10, block_rows=0)
    with pytest.raises(ValueError):
        assign_groups(files, 10, fan=1)
