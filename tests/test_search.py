from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hourvault.functions.hours import hour_bounds
from hourvault.operators import lookup
from hourvault.operators.search import MAX_LIMIT, check_limit, search, with_locator
from hourvault.plans import saved
from hourvault.plans.saved import run_saved_searches
from hourvault.schema import EVENT_TABLE_SCHEMA

UTC = timezone.utc
START = datetime(2026, 9, 9, 8, tzinfo=UTC)


def rows(spark, *events):
    """Event rows from partial dicts."""
    full = []
    for number, given in enumerate(events):
        at = given.get("timestamp", START)
        row = {
            "event_id": f"event-{number}", "application": "app", "user_id": "u", "organization_id": "o",
            "event_name": "n", "category": "c", "timestamp": at,
            "blob_partition": (at or START).strftime("%Y/%m/%d/%H"), "blob_name": "events.ndjson",
            "source_line": number + 1, "raw_json": f'{{"n":{number}}}', "blob_path": "p/events.ndjson",
            "bad_reason": None, "blob_hour": (at or START).strftime("%Y-%m-%d-%H"), "run_id": "r", "group_no": 0,
            **given,
        }
        full.append(tuple(row[n] for n in EVENT_TABLE_SCHEMA.names))
    return spark.createDataFrame(full, EVENT_TABLE_SCHEMA).drop("bad_reason")


def ids(frame):
    return [r.event_id for r in frame.collect()]


def test_half_open_interval(spark):
    events = rows(spark, *[{"timestamp": START + timedelta(minutes=m)} for m in (0, 30, 60)])
    assert ids(search(events, START, START + timedelta(hours=1))) == ["event-1", "event-0"]


@pytest.mark.parametrize("field", ["event_id", "application", "user_id", "organization_id", "event_name", "category"])
def test_each_filter_is_exact(spark, field):
    events = rows(spark, {"event_id": "a", field: "Wanted"}, {"event_id": "b", field: "wanted"}, {"event_id": "c", field: ""})
    found = search(events, START, START + timedelta(hours=1), {field: "Wanted"})
    assert found.count() == 1
    if field != "event_id":
        assert ids(search(events, START, START + timedelta(hours=1), {field: ""})) == ["c"]


def test_filters_combine_with_and(spark):
    events = rows(spark, {"user_id": "x", "category": "k"}, {"user_id": "x"}, {"category": "k"})
    found = search(events, START, START + timedelta(hours=1), {"user_id": "x", "category": "k", "event_name": None})
    assert ids(found) == ["event-0"]
    with pytest.raises(ValueError, match="Unknown"):
        search(events, START, START + timedelta(hours=1), {"nope": "x"})


def test_null_id_and_null_time_are_never_found(spark):
    events = rows(spark, {"event_id": None}, {"timestamp": None}, {})
    assert ids(search(events, START, START + timedelta(hours=1))) == ["event-2"]


def test_newest_first_with_ties_in_a_total_order(spark):
    events = rows(
        spark, {"event_id": "b"}, {"event_id": "a", "source_line": 9}, {"event_id": "a", "source_line": 2},
        {"event_id": "z", "timestamp": START + timedelta(minutes=5)},
    )
    found = search(events, START, START + timedelta(hours=1), limit=3)
    assert [(r.event_id, r.source_line) for r in found.collect()] == [("z", 4), ("a", 2), ("a", 9)]


def test_hour_of_the_file_prunes_before_event_time(spark):
    events = rows(spark, {"event_id": "late", "blob_hour": "2026-09-09-10"}, {"event_id": "on time"})
    end = START + timedelta(hours=1)
    assert ids(search(events, START, end)) == ["on time"]
    assert sorted(ids(search(events, START, end, lateness_hours=2))) == ["late", "on time"]


def test_empty_range(spark):
    assert ids(search(rows(spark, {}), START, START)) == []


def test_limit_policy(spark):
    for limit in (1, 100, MAX_LIMIT):
        assert check_limit(limit) == limit
    for limit in (0, -1, MAX_LIMIT + 1):
        with pytest.raises(ValueError):
            search(rows(spark, {}), START, START, limit=limit)


def test_locator(spark):
    row = with_locator(search(rows(spark, {"source_line": 42}), START, START + timedelta(hours=1))).head()
    assert row.locator.asDict() == {
        "source_line": 42, "blob_partition": "2026/09/09/08", "blob_name": "events.ndjson", "blob_path": "p/events.ndjson",
    }


def test_lookup_needs_path_line_and_id(spark):
    events = rows(spark, {"event_id": "a", "source_line": 42}, {"event_id": "a", "source_line": 42, "blob_path": "other"})
    found = lookup.lookup_event(events, "a", "p/events.ndjson", 42, "2026/09/09/08").collect()
    assert [tuple(r) for r in found] == [("a", "2026/09/09/08", "events.ndjson", 42, '{"n":0}')]
    for bad in (("b", "p/events.ndjson", 42), ("a", "p/events.ndjson", 41), ("a", "gone", 42)):
        assert lookup.lookup_event(events, *bad, "2026/09/09/08").count() == 0
    results = events.where("event_id = 'a'")
    assert sorted(r.raw_json for r in lookup.lookup_results(events, results.union(results)).collect()) == ['{"n":0}', '{"n":1}']


def test_unique_results_keep_the_newest(spark):
    events = rows(
        spark, {"event_id": "a"}, {"event_id": "a", "timestamp": START + timedelta(minutes=1)},
        {"event_id": "a", "timestamp": START + timedelta(minutes=1), "blob_name": "aaa"}, {"event_id": "b"},
    )
    kept = lookup.unique_results(events).orderBy("event_id").collect()
    assert [(r.event_id, r.source_line) for r in kept] == [("a", 3), ("b", 4)]


def test_prefix_search(spark):
    found = spark.createDataFrame([(x,) for x in ("login:c9", "login:a1", "login:b4", "logout:a1", "lo%gin")], "event_id string")
    assert ids(lookup.find_ids(found, "login:")) == ["login:a1", "login:b4", "login:c9"]
    assert ids(lookup.find_ids(found, "login:", 2)) == ["login:a1", "login:b4"]
    assert ids(lookup.find_ids(found, "lo%")) == ["lo%gin"]
    assert ids(lookup.find_ids(found, "LOGIN:")) == []
    assert len(ids(lookup.find_ids(found, "LOGIN:", case_insensitive=True))) == 3
    assert len(ids(lookup.find_ids(found, ""))) == 5
    with pytest.raises(ValueError):
        lookup.find_ids(found, "l", 0)


def brute_saved(events, searches, limit):
    result = []
    for s in searches:
        bounds = hour_bounds(s["from_utc"], s["to_utc"])
        hits = [
            e for e in events
            if e["timestamp"] is not None and s["from_utc"] <= e["timestamp"] < s["to_utc"]
            and bounds[0] <= e["blob_hour"] <= bounds[1]
            and all(s.get(f) is None or e[f] == s[f] for f in ("event_id", "user_id", "event_name"))
        ]
        hits.sort(key=lambda e: (-e["timestamp"].timestamp(), e["event_id"], e["source_line"]))
        result += [(s["search_id"], e["event_id"], rank) for rank, e in enumerate(hits[:limit], start=1)]
    return sorted(result)


@pytest.mark.parametrize("limit", [7, 50])
def test_saved_searches_match_brute_force(spark, limit):
    """A third of the events in one hour and one user."""
    rng = random.Random(2)
    events = []
    for number in range(600):
        hot = number % 3 == 0
        at = START + timedelta(seconds=rng.randint(0, 3599) if hot else rng.randint(0, 4 * 86400))
        events.append({
            "event_id": f"e{number}", "timestamp": at if number % 50 else None, "source_line": number,
            "user_id": "hot" if hot else f"u{rng.randint(0, 5)}", "event_name": f"n{rng.randint(0, 3)}",
            # Some files are hours away from their events' times.
            "blob_hour": (at + timedelta(hours=rng.choice([0, 0, 0, 1, 3, -2]))).strftime("%Y-%m-%d-%H"),
        })
    searches = []
    for number in range(60):
        begin = START + timedelta(minutes=rng.randint(-120, 2000))
        kind = number % 4
        searches.append({
            "search_id": number, "from_utc": begin, "to_utc": begin + timedelta(minutes=rng.choice([0, 30, 600, 5000])),
            "event_id": f"e{rng.randint(0, 599)}" if kind == 1 else None,
            "user_id": rng.choice(["hot", "u1"]) if kind in (2, 3) else None,
            "event_name": f"n{rng.randint(0, 3)}" if kind == 3 else None,
        })
    frame = spark.createDataFrame(
        [tuple(s.values()) for s in searches],
        "search_id int, from_utc timestamp, to_utc timestamp, event_id string, user_id string, event_name string",
    )
    found = run_saved_searches(rows(spark, *events), frame, limit=limit)
    got = sorted((r.search_id, r.event_id, r["rank"]) for r in found.collect())
    want = brute_saved(events, searches, limit)
    assert got == want and want


def test_a_crowded_instant_is_spread(spark):
    """Half of the events at one instant of one user: numbers are right, ranges are about equally long."""
    rng = random.Random(4)
    events = []
    for number in range(4000):
        at = START if number % 2 else START + timedelta(seconds=rng.randint(-3000, 3000))
        events.append((number, "hot" if number % 3 else "u", at))
    frame = spark.createDataFrame(events, "event_id int, user_id string, timestamp timestamp").select(
        "event_id", "timestamp", F.lit("h").alias("e_hour"), F.lit(2).alias("e_mask"), F.array("user_id").alias("e_values")
    )
    ends = frame.where("event_id in (1, 2)").select("e_hour", "e_mask", "e_values", "timestamp").distinct()
    order = [F.asc("event_id")]
    got = {(r.e_values[0], r.event_id): r._no for r in saved._numbered(frame, ends, order).where("not _is_end").collect()}
    want = {}
    for user in ("hot", "u"):
        own = sorted((e for e in events if e[1] == user), key=lambda e: (-e[2].timestamp(), e[0]))
        want |= {(user, e[0]): n for n, e in enumerate(own, start=1)}
    assert got == want
    # Adaptive execution would merge ranges as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in saved._in_ranges(frame, [F.desc("timestamp"), *order]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * len(events) / len(sizes)


def test_saved_searches_without_any_search(spark):
    frame = spark.createDataFrame([], "search_id int, from_utc timestamp, to_utc timestamp")
    assert run_saved_searches(rows(spark, {}), frame).count() == 0


def test_search_plan(spark, tmp_path, capsys):
    path = str(tmp_path / "events")
    rows(spark, *[{"timestamp": START + timedelta(hours=h)} for h in range(5)]).write.partitionBy("blob_hour").parquet(path)
    stored = spark.read.schema(EVENT_TABLE_SCHEMA).parquet(path)
    search(stored, START, START + timedelta(hours=2), {"user_id": "u"}).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "blob_hour" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "raw_json" not in scan and "application" not in scan
    assert "PushedFilters: [IsNotNull(" in scan


def test_saved_search_plan_limits_before_the_shuffle(spark, capsys):
    frame = spark.createDataFrame([(1, START, START + timedelta(hours=1))], "search_id int, from_utc timestamp, to_utc timestamp")
    run_saved_searches(rows(spark, {}), frame, limit=5).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan, plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
