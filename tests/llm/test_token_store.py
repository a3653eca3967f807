from __future__ import annotations

import zlib

import numpy as np
import pytest

from hourvault.llm import token_store
from hourvault.llm.tokens import default_tokenizer
from hourvault.session import scratch_path

SCHEMA = "doc_id long, text string, shard string, offset long"


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    out, start = [], 0
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x", 7) for k, t in rows], SCHEMA)


def test_documents_come_back_in_key_order(spark):
    rows = [(i * 37 % 101 - 5, f"text {i} " * (i % 9)) for i in range(101)] + [(500, None), (501, ""), (502, "long " * 30_000)]
    got = token_store.token_table(table(spark, rows).repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_repeated_and_missing_keys_keep_all_rows(spark):
    rows = [(3, "same"), (3, "same"), (1, "a"), (2, None)]
    got = token_store.token_table(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))
    rows = [(None, "no key"), (None, "no key"), (4, "b")]
    got = token_store.token_table(table(spark, rows)).collect()
    assert sorted((r[0] is not None, *r[1:]) for r in got) == sorted((r[0] is not None, *r[1:]) for r in expected(rows))


def test_empty_table(spark):
    assert token_store.token_table(table(spark, [])).collect() == []


def test_lookup_finds_known_keys_and_no_others(spark):
    rows = [(i * i, f"w{i}") for i in range(300)]
    store = token_store.write_tokens(table(spark, rows), scratch_path(spark, "tokens"), shards=3)
    token_store.build_index(store, block_keys=40)
    asked = spark.createDataFrame([(k,) for k in (0, 4, 5, 9, 89401, 89402, -1, 4, None)], "doc_id long")
    found = token_store.look_up(store, asked)
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 4, 9, 89401]
    ids = token_store.read_documents(store, found, ids=True).collect()
    by_key = {k: t for k, t in rows}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    assert {r["doc_id"]: list(r["ids"]) for r in ids} == {
        k: [*tokenizer.encode(by_key[k], add_special_tokens=False).ids, 2] for k in (0, 4, 9, 89401)
    }


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_numbers_all_keys_without_gaps(n):
    hashes = token_store.key_hashes(np.arange(n) * 977 - 12)
    table = token_store.PerfectHash.build(hashes)
    assert sorted(table.numbers(hashes).tolist()) == list(range(n))


def test_equal_hashes_are_refused():
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([5, 5], np.uint64))


def test_block_rejects_other_keys_by_fingerprint():
    keys = np.arange(0, 20_000, 2)
    raw = token_store.pack_block(keys, np.ones(len(keys)), keys % 7, keys + 1, keys * 3)
    found = token_store.find(raw, keys)
    assert (found["rows"] == 1).all() and (found["offset"] == keys * 3).all() and (found["n"] == keys + 1).all()
    assert (token_store.find(raw, keys + 1)["rows"] == 0).all()
