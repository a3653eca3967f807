from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourvault.llm import infill


@pytest.mark.parametrize("seed", range(12))
def test_every_rank_is_reached_exactly(seed):
    random = np.random.default_rng(seed)
    points = random.integers(1, 9, int(random.integers(1, 600)))
    units = infill.SkipList(len(points), points)
    ends = [0, *np.cumsum(points).tolist()]
    assert [units.place(r) for r in range(len(points) + 1)] == ends
    ones = infill.SkipList(len(points))
    assert [ones.place(r) for r in range(len(points) + 1)] == list(range(len(points) + 1))
    with pytest.raises(IndexError):
        units.place(len(points) + 1)


def test_lanes_thin_out_and_widths_add_up(monkeypatch):
    n = 50_000
    points = np.random.default_rng(3).integers(1, 5, n)
    units = infill.SkipList(n, points)
    lengths = [len(wide) for wide, _, _ in units.lanes]
    assert len(lengths) >= 4 and n / 10 < lengths[0] < n / 6
    for below, lane in zip(lengths, lengths[1:], strict=False):
        assert lane < below
    for units_wide, points_wide, _ in units.lanes:
        assert units_wide.sum() == n and points_wide.sum() == points.sum()
    # Heights drawn a few ranks at a time are the same.
    monkeypatch.setattr(infill, "HEIGHT_ROWS", 777)
    assert [len(wide) for wide, _, _ in infill.SkipList(n, points).lanes] == lengths


def plainly(doc_id, text):
    """The contract, without any list."""
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def texts():
    random = np.random.default_rng(11)
    signs = list("ab <>PSM\né€\U0001f600́")
    rows = [(i, "".join(random.choice(signs, int(random.integers(0, 60))))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no key"), (1002, "x" * 300_000 + "é" * 5), (1002, "same id")]
    rows += [(1003, "a <M> inside"), (1003, "a <M> inside"), (1004, "<"), (1005, "<P<S<M>")]
    return rows


def test_whole_table_equals_the_plain_rule(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("of another column"))
    found = infill.fill_in_middle(df.repartition(3))
    want = [(i, *plainly(i, t)) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    forms = {r["form"] for r in found.collect()}
    assert forms == {"plain", "psm", "spm"}


def test_texts_are_rebuilt_from_output_and_form(spark):
    rows = [(i, t) for i, t in texts() if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = infill.fill_in_middle(df).select("doc_id", infill.restored("form", "output").alias("text"))
    assert sorted(map(tuple, found.collect())) == sorted((i, t or "") for i, t in rows)


def test_units_may_be_words(spark):
    rule = infill.Rule(seed="7", unit=r"\s*\S+", prefix="[a]", suffix="[b]", middle="(c)", transformed=100, suffix_first=50)
    random = np.random.default_rng(5)
    rows = [(i, " ".join("éw" * int(k) for k in random.integers(1, 5, int(random.integers(0, 40)))) + "  ") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = infill.fill_in_middle(df, rule=rule)
    for row in found.join(df, "doc_id").withColumn("again", infill.restored("form", "output", rule)).collect():
        words = re.findall(r"\s*\S+", row["text"]) or [row["text"]]
        words[-1] = row["text"][sum(map(len, words[:-1])) :]
        h = infill.draws(str(row["doc_id"]), "7")
        low, high = sorted((h[0] % (len(words) + 1), h[1] % (len(words) + 1)))
        assert row["n"] == len(words) and row["again"] == row["text"]
        assert row["prefix_chars"] == sum(map(len, words[:low])) and row["middle_chars"] == sum(map(len, words[low:high]))


def test_markers_that_could_arise_at_a_seam_are_refused():
    for markers in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.Rule(prefix=markers[0], suffix=markers[1], middle=markers[2])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, output string")
    assert infill.digests(infill.fill_in_middle(df)).collect() == []
