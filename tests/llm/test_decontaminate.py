from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from hourvault.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, window=10):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[i : i + n]))
                if items_here:
                    hit.update(range(i, i + n))
                    found |= items_here
        ids = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(k, t, "x", 0) for k, t in docs], "doc_id long, text string, item_id string, n_hit int").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def corpus(seed):
    random = np.random.default_rng(seed)
    text = lambda n: [f"{random.choice(list('abcde'))}{random.integers(0, 30)}" for _ in range(n)]
    items = [(int(i), " ".join(text(int(random.integers(0, 40))))) for i in range(25)] + [(3, "second row of one item " * 3), (77, None), (78, "...")]
    items += [(40, "tiny"), (41, "two wörds"), (None, " ".join(text(12)))]
    docs = []
    for key in range(120):
        body = text(int(random.integers(0, 700)))
        for _ in range(int(random.integers(0, 3))):
            source = words(items[int(random.integers(0, len(items)))][1])
            a = int(random.integers(0, max(1, len(source) - 8)))
            at = int(random.integers(0, len(body) + 1))
            body[at:at] = source[a : a + int(random.integers(8, 14))]
        docs.append((key, random.choice([" ", "-", ", ", "\n"]).join(body).title()))
    docs += [(500, None), (501, ""), (502, "!!"), (503, "Tiny"), (None, "two WÖRDS two wörds"), (503, "Tiny")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_are_all_occurrences(spark, seed, block_bytes):
    docs, items = corpus(seed)
    got = decontaminate.find_leaks(*frames(spark, docs, items), block_bytes=block_bytes).drop("items")
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


def test_long_runs_of_one_word(spark):
    docs, items = [(1, "la " * 5000), (2, "la " * 9), (3, "la " * 10)], [(1, "la " * 40), (2, "la " * 11)]
    got = decontaminate.find_leaks(*frames(spark, docs, items)).drop("items")
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c")]), ([(1, "a b c")], []), ([], []), ([(1, "a b")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    got = decontaminate.find_leaks(*frames(spark, docs, items)).drop("items")
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


def test_blocks_are_built_in_tasks_and_loaded_once_a_chunk(spark, monkeypatch):
    """Several blocks; the driver only names them, and a task of three batches loads each once."""
    docs, items = corpus(6)
    df, benchmark = frames(spark, docs, items)
    monkeypatch.setattr(type(benchmark), "toLocalIterator", None)
    files = decontaminate.write_patterns(benchmark.repartition(1), "item_id", "text", 10, 300)
    assert len(files) > 2 and len(set(files)) == len(files)
    loads, load = [], decontaminate._load
    monkeypatch.setattr(decontaminate, "_load", lambda file: loads.append(file) or load(file))
    table = df.coalesce(1).toArrow().select(["text"]).combine_chunks().to_batches()[0]
    parts = [table.slice(at, 50) for at in range(0, table.num_rows, 50)]
    hits = [n for found in decontaminate._scans(iter(parts), "text", files) for n in found.counts()[1].tolist()]
    assert sorted(loads) == files
    assert sorted(hits) == sorted(r[2] for r in expected(docs, items))


def test_windows_of_any_length(spark):
    docs, items = [(1, " ".join(f"w{i}" for i in range(900))), (2, "w1 w2")], [(1, " ".join(f"w{i}" for i in range(300, 720)))]
    got = decontaminate.find_leaks(*frames(spark, docs, items), window=400).drop("items")
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items, 400)


def test_clean_rows_stay_as_they_are(spark):
    docs, items = corpus(4)
    df, benchmark = frames(spark, docs, items)
    got = decontaminate.without_leaks(df, benchmark)
    assert got.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r[0]) for r in expected(docs, items) if not r[5])
