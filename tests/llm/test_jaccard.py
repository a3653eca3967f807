from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from hourvault.llm import jaccard


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def expected(rows, numerator=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= numerator * len(a | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(smallest.get(find(i), key), key)
    return sorted(
        ((k, len(sets[i]), smallest.get(find(i))) if sets[i] else (k, 0, k) for i, (k, _) in enumerate(rows)), key=lambda r: (r[0] is not None, r[0] or 0, r)
    )


def result(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, f1 long, n long, node string").repartition(parts)
    got, _ = jaccard.similarity_classes(df, **options)
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r))


def corpus(seed, n=60):
    """Groups of copies with edits of many sizes, chains, a common passage, short and empty texts."""
    random = np.random.default_rng(seed)
    word = lambda: "w" + str(random.integers(0, 4000))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(n):
        base = [word() for _ in range(int(random.integers(1, 90)))]
        for _ in range(int(random.integers(1, 6))):
            rows.append(" ".join(base))
            for _ in range(int(random.integers(0, 3))):  # each copy from the last one: chains
                base[int(random.integers(0, len(base)))] = word()
        if random.random() < 0.3:
            rows.append(" ".join([*base[:15], *passage]))
    rows += ["", " \t", None, "one", "One", "one two", "ONE two three", "one two three four", rows[0].upper()]
    keys = random.permutation(len(rows) * 3)[: len(rows)]
    return [(int(k), t) for k, t in zip(keys, rows, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_all_links(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == expected(rows)


def test_one_large_group_of_near_copies_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "KEY_ROWS", 2)
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for key in range(150):
        own = list(base)
        for _ in range(int(random.integers(0, 4))):
            own[int(random.integers(0, 120))] = f"x{random.integers(0, 10**6)}"
        rows.append((key, " ".join(own)))
    assert result(spark, rows) == expected(rows)


def test_links_beside_the_smallest_class_of_a_key_are_found(spark):
    # Two chains that share a passage but not a component: round 2 must tell them apart.
    common = [f"c{i}" for i in range(40)]
    rows = []
    for side in "ab":
        own = [f"{side}{i}" for i in range(40)]
        for step in range(6):
            own[step * 6] = f"{side}new{step}"
            rows.append((len(rows), " ".join(common + own)))
    assert result(spark, rows) == expected(rows)


def test_repeated_rows_and_missing_keys(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (9, "other words that are alone here"), (None, "only one without any key at all")]
    assert result(spark, rows) == expected(rows)


def test_very_long_text(spark):
    long = [f"w{i}" for i in range(60_000)]
    near = list(long)
    near[::2000] = [f"y{i}" for i in range(len(near[::2000]))]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:100]))]
    assert result(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_a_lower_threshold(spark):
    rows = corpus(9, 30)
    assert result(spark, rows, similarity=jaccard.Similarity(4, 60, 100)) == expected(rows, 60)


def test_similar_sets_share_a_fragment_key():
    random = np.random.default_rng(2)
    similarity = jaccard.Similarity()
    for _ in range(300):
        n = int(random.integers(1, 200))
        a = [f"w{i}" for i in random.integers(0, 10**6, n)]
        b = list(a)
        for _ in range(int(random.integers(0, 4))):
            b[int(random.integers(0, n))] = "z" + str(random.integers(0, 10**6))
        b = b[: n - int(random.integers(0, max(1, n // 12)))]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        sets = jaccard.Sets(pa.array([" ".join(a), " ".join(b)]), 4)
        row, keys = jaccard.fragment_keys(sets, similarity, np.zeros(2, bool))
        assert x == y or set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())


@pytest.mark.parametrize("similarity", [jaccard.Similarity(), jaccard.Similarity(5, 80, 100)])
def test_similar_sets_share_a_key_that_neither_spares(similarity):
    """Whatever the order of keys, as long as it is one order: common keys may go from both sides."""
    random = np.random.default_rng(8)
    spared = 0
    for _ in range(300):
        a = [f"w{i}" for i in random.integers(0, 500, int(random.integers(1, 700)))]
        b = a[int(random.integers(0, len(a) // 9 + 1)) :]
        for _ in range(int(random.integers(0, 1 + len(b) // 30))):
            b[int(random.integers(0, len(b)))] = "edit"
        x, y = shingles(" ".join(a), similarity.n), shingles(" ".join(b), similarity.n)
        if x == y or similarity.denominator * len(x & y) < similarity.numerator * len(x | y):
            continue
        sets = jaccard.Sets(pa.array([" ".join(a), " ".join(b)]), similarity.n)
        row, keys, spare_row, spares = jaccard.keys_and_spares(sets, similarity, np.zeros(2, bool))
        kept = []
        for i in range(2):
            spare = {int(s) & 255: int(s) >> 8 for s in spares[spare_row == i]}
            spared += sum(spare.values())
            other = set(keys[row == 1 - i].tolist())
            mine = {}
            for k in sorted(set(keys[row == i].tolist()), key=lambda k: (k not in other, k)):  # worst: common keys count as frequent
                mine.setdefault(k & 255, []).append(k)
            kept.append({k for kind, ks in mine.items() for k in ks[spare.get(kind, 0) :]})
        assert kept[0] & kept[1]
    assert spared > 1000


def test_long_texts_with_little_in_common_do_not_meet(spark, monkeypatch):
    """Parity sketches cannot tell sets of 5,000 n-grams apart; common passages and empty fragments must not pair them."""
    random = np.random.default_rng(9)
    words = lambda n: [f"w{i}" for i in random.integers(0, 10**6, n)]
    passages = [words(12) for _ in range(30)]
    texts = []
    for _ in range(24):
        text = words(4700)
        for i in random.choice(30, 12, replace=False):
            text += passages[i]
        texts.append(text)
    copy = list(texts[5])
    for i in range(0, 600, 10):
        copy[i] = "edit"
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, copy])]
    met = []
    candidates, written = jaccard._candidates, jaccard.stored.written
    monkeypatch.setattr(jaccard, "_candidates", lambda pairs, *a: met.append(candidates(pairs, *a)) or met[-1])
    monkeypatch.setattr(jaccard.stored, "written", lambda df, name: (name == "crossing" and met.append(df)) or written(df, name))
    similarity = jaccard.Similarity(5, 80, 100)
    got = result(spark, rows, similarity=similarity)
    assert [r[2] for r in got] == [*range(24), 5]
    assert sum(pairs.count() for pairs in met) <= 5


def test_stored_sets_are_small_beside_their_texts(spark, monkeypatch):
    random = np.random.default_rng(10)
    texts = [" ".join(f"w{i}" for i in random.integers(0, 10**6, 3000)) for _ in range(20)]
    stored_values = []
    written = jaccard.stored.written

    def counted(df, name):
        if name == "sets":
            stored_values.extend(sum(len(v) if isinstance(v, list) else 1 for v in r) for r in df.collect())
        return written(df, name)

    monkeypatch.setattr(jaccard.stored, "written", counted)
    assert len(result(spark, list(enumerate(texts)))) == 20
    assert len(stored_values) == 20 and max(stored_values) < 60


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (7, "some other text of its own", "c"), (None, text, "d"), (8, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hv_x string")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.hv_x) for r in got.collect()) == [(0, "d"), (2, "b"), (7, "c"), (8, "e")]


def test_one_of_each_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 7, 8), (2, text, 9, 9), (3, None, 5, 5)], "doc_id long, text string, hv_row int, HV_ROW_ int")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, text, 7, 8), (3, None, 5, 5)]


def test_different_texts_of_one_key_stay_and_copies_without_a_key_go(spark):
    texts = [" ".join(f"{t}{i}" for i in range(60)) for t in "abcdef"]
    near = texts[1] + " more"
    rows = [(1, texts[0]), (4, texts[0]), (4, texts[1]), (4, near), (4, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[3] + " x"), (None, texts[4])]
    rows += [(4, None), (4, None), (7, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, (r.text or " ")[0]) for r in jaccard.one_of_each(df).collect()))
    assert got == [(0, "d"), (0, "e"), (1, "a"), (4, " "), (4, " "), (4, "b"), (4, "c"), (7, "f")]


def test_colliding_class_hashes_are_refused(spark, monkeypatch):
    sums = jaccard.Sets.sums
    monkeypatch.setattr(jaccard.Sets, "sums", lambda self, salt: sums(self, salt) & np.uint64(1) if salt == 0x1F1F else sums(self, salt))
    rows = [(i, f"text number {i} of some words") for i in range(12)]
    with pytest.raises(ValueError, match="seed"):
        result(spark, rows)


def test_short_counts_are_never_too_low(spark):
    """What two sets can have in common at most is at least what they have, also where many n-grams fall together."""
    import random

    from hourvault.llm import jaccard, stored

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=6000)
    texts = []
    for i in range(8):
        own = list(base)
        for at in rng.sample(range(len(own)), 40 * i):
            own[at] = rng.choice(words)
        texts.append((i, " ".join(own[: 6000 - 500 * (i % 3)])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    similarity = jaccard.Similarity()
    rows = jaccard.summarise(df, "doc_id", "text", similarity).select("row", "f1").collect()
    classes = spark.createDataFrame([(r["f1"], r["row"]) for r in rows], "node long, first_row long")
    nodes = {r["f1"]: r["row"] for r in rows}
    pairs = stored.written(spark.createDataFrame([(a, b) for a in nodes for b in nodes if a < b], "a long, b long"), "pairs")
    grams = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in texts}
    exact = {(r["a"], r["b"]): r for r in jaccard.overlaps(df, "doc_id", "text", classes, pairs, similarity).collect()}
    short = {(r["a"], r["b"]): r for r in jaccard.overlaps(df, "doc_id", "text", classes, pairs, similarity, short=True).collect()}
    assert len(exact) == 28 == len(short)
    for (a, b), row in exact.items():
        x, y = grams[nodes[a]], grams[nodes[b]]
        assert tuple(row)[2:] == (len(x & y), len(x), len(y))
        most = short[a, b]
        assert (most["a_part"], most["b_part"]) == (len(x), len(y))
        assert len(x & y) <= most["overlap"] <= min(len(x), len(y)) + 1200
