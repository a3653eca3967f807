from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourvault.llm import spelling
from hourvault.llm.spelling import Spelling


def brute_counts(rows, rule):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if rule.noise and h % rule.noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= rule.letters and n >= rule.occurrences}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute(rows, rule):
    counts = brute_counts(rows, rule)
    out = {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= rule.ratio * n else None
        out[word] = (form, n, len(others), counts[form] if form else None)
    result = []
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        result.append((word, form, root, n, n_near, form_n))
    return sorted(result)


def texts(seed, n=60, letters="abÀ÷z"):
    """Words over few signs, so that many are near each other, some much more frequent."""
    random = np.random.default_rng(seed)
    words = ["".join(random.choice(list(letters), int(random.integers(6, 12)))) for _ in range(50)]
    weights = 1 / np.arange(1, 51) ** 2
    rows = []
    for i in range(n):
        chosen = list(random.choice(words, 80, p=weights / weights.sum()))
        for k in range(0, 80, 3):
            w = list(chosen[k])
            w[int(random.integers(len(w)))] = str(random.choice(list(letters)))
            chosen[k] = "".join(w).upper() if k % 2 else "".join(w)
        rows.append((i, " ".join(chosen) + ", Żółć-x1y"))
    return rows


CASES = [(None, "banana bananas"), (3, None), (7, ""), (7, "bananas bananas banan"), (8, "q" * 5000 + " " + "q" * 5001), (8, "q" * 5000 + " " + "q" * 5001)]


@pytest.mark.parametrize("noise", [None, 3])
@pytest.mark.parametrize(("list_words", "frequency"), [(256, None), (256, 2), (3, 2), (1, 1)])
def test_equals_brute_force(spark, noise, list_words, frequency):
    """With all lists short, and with most of them too long to be merged pair by pair."""
    rule = Spelling(noise=noise)
    rows = texts(1) + CASES
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("of another column"))
    found = spelling.variants(df.repartition(3), rule=rule, list_words=list_words, frequency=frequency)
    want = brute(rows, rule)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == want
    assert any(r[1] for r in want) and sum(r[4] for r in want) > 100


def test_query_equals_brute_force(spark):
    from hourvault.llm.queries import QUERIES

    found = QUERIES["op12_spelling"](spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, found), key=lambda r: r[0]) == brute(rows, Spelling())


def test_chains_of_forms_end_in_one_root(spark):
    rows = [(i, w) for i, w in enumerate(["lantern"] * 2 + ["lanterns"] * 20 + ["lanternss"] * 200 + ["lanternsss"] * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(df, rule=Spelling(noise=None)).collect()}
    assert found["lantern"] == ("lanterns", "lanternsss") and found["lanternsss"] == (None, "lanternsss")


@pytest.mark.parametrize("seed", range(20))
def test_one_edit_changes_no_more_grams_than_the_bound(seed):
    """Grams of both words that stand at one place from the start or the end are kept; the rest is within the bound."""
    random = np.random.default_rng(seed)
    rule = Spelling()
    words = ["".join(random.choice(list("abc"), int(random.integers(7, 14)))) for _ in range(200)]
    every = spelling.Grams(words, rule)
    hashes, n = np.unique(np.concatenate([h for _, _, h in every.hashes()]), return_counts=True)
    dictionary = hashes[n > 6], n[n > 6]
    for word in words[:30]:
        at = int(random.integers(len(word)))
        edited = random.choice([word[:at] + word[at + 1 :] + "b", word[:at] + "d" + word[at + 1 :], word[:at] + "a" + word[at:]])
        if not near(word, edited) or len(edited) < 7:
            continue
        kept = []
        for text in (word, edited):
            grams = spelling.Grams([text], rule)
            places, sizes, hashed, _ = grams.decompose(*dictionary)
            kept.append((places.tolist(), sizes, hashed.tolist(), int(grams.affected(places, sizes)[0])))
            own, lists = grams.postings(*dictionary)
            kept[-1] += (set(lists.tolist()),)
        assert kept[0][4] & kept[1][4]
        for (places, _, hashed, most, _), other, wide in ((kept[0], kept[1], len(edited) - len(word)), (kept[1], kept[0], len(word) - len(edited))):
            there = set(zip(other[0], other[2], strict=True))
            lost = [p for p, h in zip(places, hashed, strict=True) if (p, h) not in there and (p + wide, h) not in there]
            assert len(lost) <= most


def test_crc_is_that_of_zlib():
    random = np.random.default_rng(2)
    data = random.integers(0, 256, 4000).astype(np.uint8)
    starts = np.array([0, 3, 10, 60, 400, 1500])
    ends = np.array([3, 3, 58, 400, 401, 4000])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(6)], np.uint32)
    want = [zlib.crc32(b"%d:" % i + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert spelling.continued_crc(data, starts, ends, before).tolist() == want


def test_dictionary_is_bounded_and_grams_must_fit(spark, monkeypatch):
    monkeypatch.setattr(spelling, "DICTIONARY_GRAMS", 40)
    monkeypatch.setattr(spelling, "LEAST_FREQUENCY", 1)
    words = spark.createDataFrame([("".join(w), 2) for w in np.random.default_rng(4).choice(list("ab"), (300, 9))], "word string, n long")
    assert 0 < len(spelling.build_dictionary(words, Spelling())[0]) < 40
    with pytest.raises(ValueError):
        Spelling(letters=5)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
