from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from hourvault.llm import personal
from hourvault.llm.personal import KINDS, Bootstrap

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def plainly(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def plain_row(doc_id, text):
    base = plainly(text)
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
    n = [sum(k == i for _, k, _ in base) for i in range(4)]
    return (doc_id, *n, hashlib.sha256(listed.encode()).hexdigest(), listed)


ODD = [
    None, "", "a@b", "a@b@c.d", "x@y.z@w.v", "é.a@b.c.", "..@-.-", "a@b..c", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3.256.4", "0001.02.3.0255",
    "4111 1111-1111 1111", "4111  1111", "+1 (017) 555-7713", "+1 (017) 555-7713 2390", "+(1) 2", "+1-----------", "+1+2 345 678 9012",
    "4" * 4000 + ".1.2.3", "a" * 5000 + "@", "1." * 3000, "+1" + "(" * 3000, "a@" + "b." * 2000, "1 " * 4000, "€ 255.255.255.255 €", "1.2.3.4@5.6",
]


@pytest.mark.parametrize("seed", range(6))
def test_seeds_equal_the_plain_rules(spark, seed):
    random = np.random.default_rng(seed)
    pieces = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "25", "256", "4111111111111111", "x@y.de", "+49 30 1234567", "\n", "%", "_", ".5"]
    rows = [(i, "".join(random.choice(pieces, int(random.integers(0, 50))))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "u@v.w"), (5, "same id"), (5, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS row")
    found = personal.digests(personal.find_personal(df.repartition(3), rule=Bootstrap(evidence=1e9)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)


def number(random, luhn):
    while True:
        digits = "".join(map(str, random.integers(0, 10, 16)))
        if passes_luhn(digits) == luhn:
            return digits


def corpus(seed):
    """Cards are said to be charged; some of those numbers fail Luhn's rule. Order numbers stand elsewhere."""
    random = np.random.default_rng(seed)
    words = ["".join(random.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, planted = [], {}
    for i in range(120):
        text = " ".join(random.choice(words, 20))
        if i < 40:
            text += f" please charge card {number(random, True)} today " + " ".join(random.choice(words, 9))
        elif i < 46:
            value = number(random, False)
            text += " ünd please charge card "
            planted[i] = (len(text), len(text) + 16)
            text += f"{value} today. " + " ".join(random.choice(words, 9))
        elif i < 80:
            text += f" with order {number(random, False)} sent and call {random.integers(10**6)}"
        elif i < 85:
            text += f" as order {number(random, True)} sent"
        rows.append((i, text))
    return rows, planted


@pytest.mark.parametrize("seed", range(3))
def test_contexts_discover_what_the_rules_miss(spark, seed):
    rows, planted = corpus(seed)
    found = personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))
    for row in found.collect():
        base = plainly(dict(rows)[row["doc_id"]])
        more = [(a, 2, b) for a, b in [planted[row["doc_id"]]]] if row["doc_id"] in planted else []
        assert list(map(tuple, row["seeds"])) == base
        assert list(map(tuple, row["spans"])) == sorted(base + more)


def test_later_rounds_learn_from_what_earlier_ones_found(spark):
    """Values found beside `card` stand elsewhere beside `konto`, which then finds others."""
    random = np.random.default_rng(9)
    shared = [number(random, False) for _ in range(12)]
    last = number(random, False)
    texts = [f"the card {number(random, True)} is" for _ in range(60)] + [f"the card {v} is" for v in shared]
    texts += [f"our konto {v} was" for v in shared] + [f"our konto {last} was"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_rounds = {}
    for rounds in (1, 2, 3):
        found = personal.find_personal(df, rule=Bootstrap(rounds=rounds)).collect()
        by_rounds[rounds] = {r["doc_id"] for r in found if len(r["spans"]) > len(r["seeds"])}
    assert by_rounds[1] == set(range(60, 84)) and by_rounds[2] == set(range(60, 85)) == by_rounds[3]


def test_copies_are_no_evidence_and_mixed_contexts_none(spark):
    random = np.random.default_rng(8)
    one, other = number(random, True), number(random, False)
    texts = [f"pay card {one} now"] * 50 + [f"pay card {other} now"]
    texts += [f"see {number(random, bool(i % 2))} there" for i in range(60)]
    found = personal.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(r["spans"] == r["seeds"] for r in found.collect())


def graph(edges, rule):
    """The rounds in plain Python."""
    kinds = {(p, v): k for p, v, k in edges}
    accepted = {}
    for _ in range(rule.rounds):
        confident = {}
        for pattern in {p for p, _ in kinds}:
            own = [(v, k) for (p, v), k in kinds.items() if p == pattern]
            sums = [0.0] * 4
            for v, k in own:
                if k is not None:
                    sums[k] += 1
                elif v in accepted:
                    sums[accepted[v][0]] += accepted[v][1]
            best = max(range(4), key=lambda k: (round(sums[k], 6), -k))
            if round(sums[best], 6) >= rule.evidence and sums[best] / (len(own) + 1) >= rule.confidence:
                confident[pattern] = (best, sums[best] / (len(own) + 1))
        scores = {}
        for (p, v), k in kinds.items():
            if k is None and p in confident:
                kind, c = confident[p]
                scores[v, kind] = scores.get((v, kind), 1.0) * (1 - c)
        new = {}
        for (v, kind), doubt in sorted(scores.items(), key=lambda x: (x[0][1])):
            score = round(1 - doubt, 6)
            if score >= rule.accepted and (v not in new or score > new[v][1]):
                new[v] = (kind, score)
        if len(new) == len(accepted):
            return new
        accepted = new
    return accepted


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_brute_force(spark, seed):
    random = np.random.default_rng(seed)
    rule = Bootstrap(rounds=4, evidence=2.0, confidence=0.55, accepted=0.6)
    kind_of = {f"v{i}": (int(random.integers(4)) if random.random() < 0.6 else None) for i in range(150)}
    seen = {(f"p{int(random.integers(60)) if random.random() < .5 else (kind_of[v] or 0) * 10 + int(random.integers(3))}", v) for v in list(kind_of) * 4}
    rows = [([p], v, kind_of[v]) for p, v in sorted(seen)]
    mentions = spark.createDataFrame(rows + rows[:40], "patterns array<string>, value string, kind int")
    found = {r["value"]: (r["kind"], r["score"]) for r in personal.bootstrap(mentions, rule).collect()}
    want = graph([(p[0], v, k) for p, v, k in rows], rule)
    assert {v: k for v, (k, _) in found.items()} == {v: k for v, (k, _) in want.items()} and want
    assert all(abs(found[v][1] - s) < 1e-5 for v, (_, s) in want.items())


def test_query_equals_the_plain_rules(spark):
    from hourvault.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_personal"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found)) == sorted(plain_row(*r) for r in rows) and any(r["n_email"] for r in found)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal.digests(personal.find_personal(df)).collect() == []
