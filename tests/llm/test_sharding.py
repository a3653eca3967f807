from __future__ import annotations

import hashlib

import pytest

from hourvault.llm import sharding


def expected(rows, limit):
    """By key and bytes: shard, from splitting oversized buckets bit by bit."""
    hashed = [(int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:15], 16), k, len((t or "").encode())) for k, t in rows]
    out = {}

    def split(bucket, depth):
        if sum(n for _, _, n in bucket) <= limit:
            for h, k, n in bucket:
                out[k, n] = (format(h >> (60 - depth), f"0{depth}b") if depth else "", sum(n for _, _, n in bucket), len(bucket))
            return
        for bit in (0, 1):
            part = [x for x in bucket if x[0] >> (59 - depth) & 1 == bit]
            if part:
                split(part, depth + 1)

    split(hashed, 0)
    return out


@pytest.mark.parametrize("limit", [200, 1000, 10**6])
def test_only_oversized_buckets_split(spark, limit):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(200)] + [(900, None), (None, "none")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, h int, depth int")
    got = {(r.doc_id, r.n_bytes): (r.shard, r.shard_bytes, r.shard_rows) for r in sharding.shard_documents(df, limit=limit).collect()}
    assert got == expected(rows, limit)


def test_rows_of_one_key_go_to_overflow_pages(spark):
    rows = [(1, "y" * 30)] * 50 + [(1, "z" * 500), (2, "a"), (3, "b" * 40)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limit=100).collect()
    assert len(got) == len(rows)
    sums: dict[str, int] = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert all(n <= 100 or n == 500 for n in sums.values())
    assert all(sums[r.shard] == r.shard_bytes for r in got)


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, f"text {i}", "own") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards = sharding.write_shards(df, str(tmp_path / "out"), limit=100)
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.in_shard) for r in back.collect()) == rows
    assert sum(r.shard_rows for r in shards.collect()) == 60 and all(r.shard_bytes <= 100 for r in shards.collect())


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_nothing_is_broadcast(spark, monkeypatch, capsys):
    """Few MB of files may hold millions of prefixes; by their size alone, all would pass through the driver."""
    write = sharding.stored.written
    monkeypatch.setattr(sharding.stored, "written", lambda df, name: df.explain() or write(df, name))
    rows = [(i, "x" * (i * 7 % 90)) for i in range(200)] + [(1, "y" * 90)] * 5
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), limit=200)
    assert len(found.collect()) == len(rows)
    found.explain()
    plans = capsys.readouterr().out
    assert "SortMergeJoin" in plans and "Broadcast" not in plans
