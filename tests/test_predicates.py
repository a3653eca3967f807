from __future__ import annotations

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_search import START, ids, rows

from hourvault.operators import predicates as p
from hourvault.operators.search import search


def like(pattern, value):
    regex = re.sub(r"\\(.)|(%)|(_)|(.)", lambda m: ".*" if m[2] else "." if m[3] else re.escape(m[1] or m[4]), pattern, flags=re.S)
    return None if value is None else re.fullmatch(regex, value, re.S) is not None


def three(op, values):
    """AND (min) and OR (max) with NULL as None."""
    decisive = op == "or"
    if decisive in values:
        return decisive
    return None if None in values else not decisive


USERS = ["ann", "anna", "a_n", "a%b", "Ann", "bob", "", None, "an\\n"]
RAW = ['{"k":1,"s":"x"}', '{"k":"7.5","s":null}', '{"a":[{"k":3}]}', '{"k":"no"}', "{}"]


def events(spark):
    every = [{"event_id": f"{u}-{c}-{i}", "user_id": u, "category": c, "raw_json": RAW[i]} for u in USERS for c in ("x", None) for i in range(5)]
    return rows(spark, *every), {e["event_id"]: e for e in every}


def number(raw, default=None):
    import json

    value = json.loads(raw).get("k")
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


LEAVES = [
    (lambda: p.field_is("user_id", "ann"), lambda e: None if e["user_id"] is None else e["user_id"] == "ann"),
    (lambda: p.field_is("user_id", "ann", "bob"), lambda e: None if e["user_id"] is None else e["user_id"] in ("ann", "bob")),
    (lambda: p.field_missing("category"), lambda e: e["category"] is None),
    (lambda: p.field_like("user_id", "an%"), lambda e: like("an%", e["user_id"])),
    (lambda: p.field_like("user_id", "a_n%"), lambda e: like("a_n%", e["user_id"])),
    (lambda: p.field_like("user_id", "a\\_n"), lambda e: like("a\\_n", e["user_id"])),
    (lambda: p.field_like("user_id", "%n"), lambda e: like("%n", e["user_id"])),
    (lambda: p.field_like("user_id", "AN%", ignore_case=True), lambda e: None if e["user_id"] is None else e["user_id"].lower().startswith("an")),
    (lambda: p.field_matches("user_id", "^an+a?$"), lambda e: None if e["user_id"] is None else re.search("^an+a?$", e["user_id"]) is not None),
    (lambda: p.field_matches("user_id", "^a|b"), lambda e: None if e["user_id"] is None else re.search("^a|b", e["user_id"]) is not None),
    (lambda: p.json_number("$.k", ">=", 1), lambda e: None if number(e["raw_json"]) is None else number(e["raw_json"]) >= 1),
    (lambda: p.json_is("$.s", "x"), lambda e: True if '"s":"x"' in e["raw_json"] else None),
    (lambda: p.json_present("$.a[0].k"), lambda e: '"a"' in e["raw_json"]),
]


def tree(random_, depth):
    kind = random_.choice(["leaf", "all", "any", "none"]) if depth else "leaf"
    if kind == "leaf":
        return random_.choice(LEAVES)
    parts = [tree(random_, depth - 1) for _ in range(random_.randint(1, 3))]
    made = [m for m, _ in parts]
    tests = [t for _, t in parts]
    if kind == "all":
        return lambda: p.all_of(*[m() for m in made]), lambda e: three("and", [t(e) for t in tests])
    either = lambda e: three("or", [t(e) for t in tests])
    if kind == "any":
        return lambda: p.any_of(*[m() for m in made]), either
    return lambda: p.none_of(*[m() for m in made]), lambda e: None if either(e) is None else not either(e)


def test_leaves_and_random_trees(spark):
    frame, by_id = events(spark)
    frame = frame.cache()
    random_ = random.Random(5)
    cases = LEAVES + [tree(random_, 3) for _ in range(25)]
    made = [m() for m, _ in cases]
    flags = frame.select(
        "event_id",
        *[F.coalesce(x.whole, F.lit(False)).alias(f"w{i}") for i, x in enumerate(made)],
        *[F.coalesce(x.implied if x.implied is not None else F.lit(True), F.lit(False)).alias(f"i{i}") for i, x in enumerate(made)],
    )
    for row in flags.collect():
        event = by_id[row["event_id"]]
        for i, (_, test) in enumerate(cases):
            assert row[f"w{i}"] == (test(event) is True), (i, event)
            # What is implied holds wherever the condition does; an exact one says the same.
            assert row[f"i{i}"] or not row[f"w{i}"]
            if made[i].exact:
                assert row[f"i{i}"] == row[f"w{i}"]
    frame.unpersist()


def pushed(frame):
    text = frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    filters = re.search(r"PushedFilters: \[(.*)\]", text)[1]
    columns = re.search(r"ReadSchema: struct<(.*)>", text)[1]
    return filters, columns


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "t")
    frame, _ = events(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def found(stored, where):
    return search(stored, START, START + timedelta(hours=1), limit=1000, where=where)


def test_what_parquet_can_check_is_pushed_however_deep_it_stands(stored):
    deep = p.all_of(p.field_like("user_id", "an%"), p.any_of(p.field_is("category", "x"), p.all_of(p.field_is("event_name", "n"), p.json_number("$.k", ">", 2))))
    filters, columns = pushed(found(stored, deep))
    assert "StringStartsWith(user_id,an)" in filters
    assert "Or(EqualTo(category,x),EqualTo(event_name,n))" in filters and "raw_json" in columns
    filters, columns = pushed(found(stored, p.any_of(p.field_is("user_id", "ann"), p.field_matches("category", "^xy"))))
    assert "Or(EqualTo(user_id,ann),StringStartsWith(category,xy))" in filters and "raw_json" not in columns
    filters, columns = pushed(found(stored, p.any_of(p.field_is("user_id", "ann"), p.json_is("$.k", "1"))))
    assert "user_id,ann" not in filters and "raw_json" in columns
    filters, _ = pushed(found(stored, p.none_of(p.field_is("user_id", "ann", "bob"))))
    assert "Not(In(user_id, [ann,bob]))" in filters


def test_search_with_a_condition(stored):
    got = ids(found(stored, p.all_of(p.field_like("user_id", "an%"), p.json_number("$.k", ">", 5), p.field_missing("category"))))
    assert sorted(got) == ["an\\n-None-1", "ann-None-1", "anna-None-1"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: p.field_is("nope", "x"), lambda: p.field_is("user_id"), lambda: p.field_like("raw_json", "x"), lambda: p.field_like("user_id", "a\\b"),
        lambda: p.json_is("k", "1"), lambda: p.json_is("$", "1"), lambda: p.json_is("$..k", "1"), lambda: p.json_is("$.k"), lambda: p.json_number("$.k", "==", 1),
        lambda: p.all_of(), lambda: p.any_of(), lambda: p.none_of(),
    ],
)
def test_refused(spark, make):
    with pytest.raises(ValueError):
        make()


def test_bad_regex_is_refused_at_once(spark):
    with pytest.raises(re.error):
        p.field_matches("user_id", "(")
