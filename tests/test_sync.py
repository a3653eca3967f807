from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from conftest import line, put
from pyspark.sql import functions as F
from pyspark.sql import types as T

import catalog
from hourvault.functions.hours import hours_frame
from hourvault.operators import lookup
from hourvault.operators.cached import sync_totals
from hourvault.operators.ingest import MalformedLineError
from hourvault.plans import results
from hourvault.plans.maintenance import merge_runs
from hourvault.plans.status import cache_status
from hourvault.plans.sync import current_files, data_files, materialize, reset, sync, sync_listing
from hourvault.schema import EVENT_SCHEMA, EVENT_TABLE_SCHEMA, MANIFEST_SCHEMA
from hourvault.session import pin, scratch_path
from hourvault.sources import archive, cache
from hourvault.sources.cache import LostDataError
from hourvault.sources.storage import child_names, exists, join_path, remove
from hourvault.streaming.incremental import sync_stream

H8, H9 = "2026/09/10/08", "2026/09/10/09"
SPAN = (datetime(2026, 9, 10, 8), datetime(2026, 9, 10, 10))


def run(spark, container, root, span=SPAN, **options):
    return tuple(sync_totals(sync(spark, container, root, *span, folder="audit", **options)).head())


def stored(spark, root):
    found = cache.read_events(spark, root).select("blob_partition", "blob_name", "source_line", "event_id")
    return sorted(tuple(r) for r in found.collect())


def groups(spark, root):
    return sorted((r.blob_hour, r.group_no) for r in data_files(spark, root).collect())


def lose(spark, root, hour):
    for run_dir in child_names(spark, join_path(root, "events", "run_id=*")):
        remove(spark, join_path(root, "events", run_dir, f"blob_hour={hour}"))


def lines(*event_ids):
    return "\n".join(line(e) for e in event_ids) + "\n"


def test_sync_and_read_back(spark, container, root):
    put(container, H8, "a.ndjson", "\n" + lines("a1", "a2"))
    put(container, H8, "b.ndjson", lines("b1"))
    put(container, H9, "a.ndjson", lines("c1"))
    assert run(spark, container, root) == (3, 3, 0)
    assert stored(spark, root) == [
        (H8, "a.ndjson", 2, "a1"), (H8, "a.ndjson", 3, "a2"), (H8, "b.ndjson", 1, "b1"), (H9, "a.ndjson", 1, "c1"),
    ]
    assert groups(spark, root) == [("2026-09-10-08", 0), ("2026-09-10-09", 0)]
    events = cache.read_events(spark, root)
    assert [f.dataType for f in EVENT_SCHEMA] == [events.schema[f.name].dataType for f in EVENT_SCHEMA]
    assert events.where("event_id = 'c1'").head().raw_json == line("c1")


def test_counts_per_hour_and_resync(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    put(container, H9, "b.ndjson", lines("b"))
    run(spark, container, root, (SPAN[0], SPAN[0] + timedelta(hours=1)))
    put(container, H8, "late.ndjson", lines("late"))
    rows = sync(spark, container, root, *SPAN, folder="audit").orderBy("blob_partition").collect()
    assert [tuple(r) for r in rows] == [(H8, 2, 1, 1), (H9, 1, 1, 0)]
    assert run(spark, container, root) == (3, 0, 3)
    assert len(stored(spark, root)) == 3
    # The late file came as a new file beside the first one, which was not rewritten.
    assert groups(spark, root) == [("2026-09-10-08", 0), ("2026-09-10-08", 0), ("2026-09-10-09", 0)]


def test_nothing_to_sync(spark, container, root):
    assert run(spark, container, root) == (0, 0, 0)
    assert run(spark, container, root, (SPAN[0], SPAN[0])) == (0, 0, 0)
    assert not exists(spark, join_path(root, "events"))
    assert cache.read_events(spark, root).count() == 0
    assert tuple(cache_status(spark, root).head()) == (0, 0, 0, None)
    assert results.search_cache(spark, root, *SPAN).count() == 0


def test_empty_and_blank_files_count_as_cached(spark, container, root):
    put(container, H8, "empty.ndjson", "")
    assert run(spark, container, root) == (1, 1, 0)
    assert run(spark, container, root) == (1, 0, 1)
    put(container, H8, "blank.ndjson", "\n \n")
    put(container, H8, "a.ndjson", lines("a"))
    assert run(spark, container, root) == (3, 2, 1)
    assert run(spark, container, root) == (3, 0, 3)
    path = "audit/year=2026/month=09/day=10/hour=08/"
    assert cache.manifest_entry(spark, root, path + "empty.ndjson").head().events_count == 0
    assert cache.manifest_entry(spark, root, path + "unknown.ndjson").count() == 0
    counts = {r.file_name: r.events_count for r in cache.read_manifest(spark, root).collect()}
    assert counts == {"empty.ndjson": 0, "blank.ndjson": 0, "a.ndjson": 1}


def test_names_with_blanks_and_plus(spark, container, root):
    put(container, H8, "a b+c%20d.ndjson", lines("a"))
    put(container, H8, "sub/a.ndjson", lines("b"))
    put(container, H8, "a.ndjson", lines("c"))
    assert run(spark, container, root) == (3, 3, 0)
    assert [r[1:] for r in stored(spark, root)] == [("a b+c%20d.ndjson", 1, "a"), ("a.ndjson", 1, "b"), ("a.ndjson", 1, "c")]
    assert run(spark, container, root) == (3, 0, 3)


def test_groups_follow_the_target(spark, container, root):
    size = len(lines("x"))
    for name in "abcde":
        put(container, H8, f"{name}.ndjson", lines("x"))
    put(container, H8, "big.ndjson", lines("x") * 4)
    assert run(spark, container, root, target_bytes=2 * size) == (6, 6, 0)
    found = {r.file_name: r.group_no for r in cache.read_manifest(spark, root).collect()}
    assert found == {"a.ndjson": 0, "b.ndjson": 0, "big.ndjson": 1, "c.ndjson": 2, "d.ndjson": 2, "e.ndjson": 3}
    assert groups(spark, root) == [("2026-09-10-08", n) for n in range(4)]
    assert len(stored(spark, root)) == 9


@pytest.mark.parametrize("options", [{"target_bytes": 300}, {"target_bytes": 10**9}, {"split_bytes": 50}, {"split_bytes": 777}])
def test_sizes_do_not_change_rows(spark, container, root, options):
    for hour in (H8, H9):
        for number in range(6):
            put(container, hour, f"f{number}.ndjson", "\n\n" + lines(*[f"{number}-{i}" for i in range(number * 3)]))
    run(spark, container, root, **options)
    plain = scratch_path(spark, "plain")
    run(spark, container, plain)
    assert stored(spark, root) == stored(spark, plain)
    assert len(stored(spark, root)) == 2 * 45


def test_failfast_publishes_nothing(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    put(container, H8, "b.ndjson", lines("b") + "\n{invalid json}\n" + line("c", "no time") + "\n")
    with pytest.raises(MalformedLineError, match=r"hour=08/b.ndjson at line 3"):
        run(spark, container, root)
    assert stored(spark, root) == [] and groups(spark, root) == []
    put(container, H8, "b.ndjson", lines("b"))
    assert run(spark, container, root) == (2, 2, 0)
    assert len(stored(spark, root)) == 2


def test_quarantine_keeps_good_lines(spark, container, root):
    put(container, H8, "a.ndjson", lines("a") + "{x\n" + lines("b"))
    assert run(spark, container, root, mode="quarantine") == (1, 1, 0)
    assert [r[2:] for r in stored(spark, root)] == [(1, "a"), (3, "b")]
    bad = cache.read_quarantine(spark, root).head()
    assert (bad.source_line, bad.raw, bad.bad_reason) == (2, "{x", "not a JSON object")
    assert cache.read_manifest(spark, root).head().events_count == 2


def test_unfinished_run_is_invisible_and_repeated(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    run(spark, container, root)
    # A run that died before its commit row: data and manifest are there, the commit is not.
    leftover = (
        spark.read.schema(EVENT_TABLE_SCHEMA).option("basePath", join_path(root, "events")).parquet(join_path(root, "events"))
        .withColumn("run_id", F.lit("dead")).withColumn("event_id", F.lit("ghost"))
    )
    pin(leftover).write.mode("append").partitionBy("run_id", "blob_hour", "group_no").parquet(join_path(root, "events"))
    rows = pin(cache.read_manifest(spark, root).withColumn("run_id", F.lit("dead")).withColumn("blob_path", F.lit("audit/ghost")))
    rows.write.mode("append").partitionBy("blob_day", "run_id").parquet(join_path(root, "manifest"))
    assert [r[3] for r in stored(spark, root)] == ["a"]
    assert cache.read_manifest(spark, root).count() == 1
    assert cache_status(spark, root).head()[:2] == (1, 1)


def test_two_runs_of_one_file_show_once(spark, container, root):
    put(container, H8, "a.ndjson", lines("a", "b"))
    listing = pin(archive.list_archive(hours_frame(spark, *SPAN), container, "audit"))
    for _ in range(2):  # as two syncs at once would do
        materialize(spark, container, root, listing)
    assert len(groups(spark, root)) == 2
    assert [r[3] for r in stored(spark, root)] == ["a", "b"]
    status = cache_status(spark, root).head()
    assert status[:2] == (1, 2)
    assert run(spark, container, root) == (1, 0, 1)


def test_lost_data_is_materialized_again(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    put(container, H9, "b.ndjson", lines("b"))
    run(spark, container, root)
    lose(spark, root, "2026-09-10-08")
    assert cache_status(spark, root).head()[:2] == (1, 1)
    assert run(spark, container, root) == (2, 1, 1)
    assert [r[3] for r in stored(spark, root)] == ["a", "b"]


def test_status(spark, container, root):
    put(container, H8, "a.ndjson", lines("a", "b"))
    put(container, H8, "b.ndjson", lines("c"))
    put(container, H9, "empty.ndjson", "")
    before = datetime(2026, 9, 11, 5)
    run(spark, container, root, now=before)
    status = cache_status(spark, root).head()
    size = data_files(spark, root).agg(F.sum("size")).head()[0]
    assert tuple(status) == (3, 3, size, before) and size > 0


def test_reset(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    run(spark, container, root)
    reset(spark, root)
    reset(spark, root)
    assert stored(spark, root) == []
    assert run(spark, container, root) == (1, 1, 0)


def test_file_outside_the_layout_is_refused(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    listing = archive.list_archive(hours_frame(spark, *SPAN), container, "audit")
    with pytest.raises(ValueError, match="outside"):
        sync_listing(spark, container, root, listing.withColumn("blob_partition", F.lit("")), None)
    with pytest.raises(ValueError, match="outside"):
        sync_listing(spark, container, root, listing, ("2026-09-10-09", "2026-09-10-09"))
    assert stored(spark, root) == []


@pytest.mark.parametrize("options", [{"mode": "other"}, {"target_bytes": 0}, {"split_bytes": 0}, {"row_group_bytes": 0}])
def test_arguments(spark, container, root, options):
    put(container, H8, "a.ndjson", lines("a"))
    with pytest.raises(ValueError):
        run(spark, container, root, **options)


def test_one_file_per_group_and_zstd(spark, container, root):
    for number in range(30):
        put(container, H8, f"f{number:02d}.ndjson", lines(f"e{number}"))
    run(spark, container, root)
    files = data_files(spark, root).collect()
    assert len(files) == 1 and files[0].file_path.endswith(".zstd.parquet")


@pytest.mark.parametrize("hours", [3, 40])
def test_rows_are_not_sorted_before_the_write(spark, container, root, hours):
    """40 hours in a task are more than it keeps files open for."""
    for hour in range(hours):
        put(container, f"2026/09/{10 + hour // 24:02d}/{hour % 24:02d}", "a.ndjson", "\n".join(line(f"e{hour}-{n}") for n in range(3)))
    run(spark, container, root, (datetime(2026, 9, 10), datetime(2026, 9, 13)))
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    write = next(p for p in reversed(plans) if "WriteFiles" in p and "group_no" in p and "event_id" in p)
    before_parse = write.split("MapInArrow")[0]
    assert "WriteFiles" in before_parse and "Sort" not in before_parse, write
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    found = cache.read_events(spark, root).groupBy("blob_hour", "group_no").agg(F.count("*").alias("n"), F.count_distinct("parquet_path").alias("files"))
    assert sorted((r.n, r.files) for r in found.collect()) == [(3, 1)] * hours


def test_search_store_lookup(spark, container, root):
    put(container, H8, "a.ndjson", lines("event-1", "event-2"))
    put(container, H9, "b.ndjson", line("event-3", "2026-09-10T09:10:00+00:00") + "\n" + line("other", "2026-09-10T09:20:00Z"))
    found = results.search_archive(spark, container, root, *SPAN, folder="audit")
    assert [r.event_id for r in found.collect()] == ["other", "event-3", "event-1", "event-2"]
    assert found.head().parquet_path.endswith(".parquet")
    assert results.read_results(spark, root).count() == 4
    assert [r[0] for r in results.find_last_ids(spark, root, "event-").collect()] == ["event-1", "event-2", "event-3"]
    (detail,) = results.lookup_last(spark, root, ["event-2"]).collect()
    assert (detail.source_line, detail.raw_json) == (2, line("event-2"))
    assert results.lookup_last(spark, root).count() == 4
    assert results.lookup_last(spark, root, ["unknown"]).count() == 0
    # A new search replaces the set, also when it finds nothing.
    results.search_and_store(spark, root, *SPAN, {"event_id": "event-3"})
    assert [r.event_id for r in results.read_results(spark, root).collect()] == ["event-3"]
    assert results.lookup_last(spark, root, ["event-1"]).count() == 0
    results.search_and_store(spark, root, *SPAN, {"user_id": "nobody"})
    assert results.read_results(spark, root).count() == 0
    with pytest.raises(ValueError):
        results.search_archive(spark, container, root, *SPAN, limit=0, folder="audit")


def test_result_set_is_unique_and_clears(spark, container, root):
    put(container, H8, "a.ndjson", line("dup") + "\n" + line("dup", "2026-09-10T08:40:00Z"))
    assert results.search_archive(spark, container, root, *SPAN, folder="audit").count() == 2
    (row,) = results.read_results(spark, root).collect()
    assert row.timestamp == datetime(2026, 9, 10, 8, 40)
    results.clear_results(spark, root)
    results.clear_results(spark, root)
    assert results.read_results(spark, root).count() == 0
    assert results.lookup_last(spark, root).count() == 0


def test_late_events(spark, container, root):
    put(container, H9, "a.ndjson", lines("late"))  # an 08:30 event in the 09 file
    hour = (SPAN[0], SPAN[0] + timedelta(hours=1))
    assert results.search_archive(spark, container, root, *hour, folder="audit").count() == 0
    found = results.search_archive(spark, container, root, *hour, folder="audit", lateness_hours=1)
    assert [r.event_id for r in found.collect()] == ["late"]


def test_stream_equals_batch_and_is_idempotent(spark, container, root, tmp_path):
    put(container, H8, "a b.ndjson", lines("a"))
    put(container, H9, "b.ndjson", "\n" + lines("b", "c"))
    put(container, H9, "note.txt", "x")
    batch = scratch_path(spark, "batch")
    run(spark, container, batch)
    for _ in range(2):
        sync_stream(spark, container, root, str(tmp_path / "ck"), folder="audit").awaitTermination()
        assert stored(spark, root) == stored(spark, batch)
    put(container, H8, "new.ndjson", lines("d"))
    sync_stream(spark, container, root, str(tmp_path / "ck"), folder="audit").awaitTermination()
    assert [r[3] for r in stored(spark, root)] == ["a", "d", "b", "c"]
    # A lost checkpoint replays all files; the manifest drops them.
    sync_stream(spark, container, root, str(tmp_path / "ck2"), folder="audit").awaitTermination()
    assert len(stored(spark, root)) == 4
    assert run(spark, container, root) == (3, 0, 3)


def test_newest_search_uses_few_hours_and_stays_exact(spark, container, root, monkeypatch):
    """Random late, early, NULL-time events; with lost data the full search takes over."""
    rng = random.Random(4)
    events = []
    for hour in range(12):
        for name in "ab":
            content = []
            for number in range(rng.randint(0, 6)):
                at = SPAN[0] + timedelta(hours=hour, minutes=rng.choice([-90, -20, 5, 10, 30, 59, 130]), seconds=number)
                event_id = None if rng.random() < 0.2 else f"{hour:02d}{name}{number}"
                stamp = None if rng.random() < 0.1 else at.isoformat() + "Z"
                content.append(line(event_id, stamp))
                if event_id and stamp:
                    events.append((at, hour, event_id))
            put(container, (SPAN[0] + timedelta(hours=hour)).strftime("%Y/%m/%d/%H"), f"{name}.ndjson", "\n".join(content))
    whole = (SPAN[0], SPAN[0] + timedelta(hours=12))
    run(spark, container, root, whole)
    opened = []
    read = results.read_events
    monkeypatch.setattr(results, "read_events", lambda *a: opened.append(a[3] if len(a) > 3 else None) or read(*a))

    def expected(span, limit, gone=()):
        inside = [
            e for e in events
            if span[0] <= e[0] < span[1] and span[0] <= SPAN[0] + timedelta(hours=e[1] + 0.999) and SPAN[0] + timedelta(hours=e[1]) < span[1]
            and e[1] not in gone
        ]
        return [e[2] for e in sorted(inside, key=lambda e: (-e[0].timestamp(), e[2]))][:limit]

    for span, limit in [(whole, 5), (whole, 1), (whole, 500), ((SPAN[0] + timedelta(hours=3), SPAN[0] + timedelta(hours=8, minutes=15)), 6)]:
        opened.clear()
        found = results.search_and_store(spark, root, *span, limit=limit)
        assert [r.event_id for r in found.orderBy(F.desc("timestamp"), "event_id").collect()] == expected(span, limit)
        if limit <= 6:
            assert len(opened) == 1 and len(opened[0]) < 9
    # Lost data is an error, until a sync has read its hours again.
    lose(spark, root, "2026-09-10-19")
    with pytest.raises(LostDataError):
        results.search_and_store(spark, root, *whole, limit=5)
    run(spark, container, root, whole)
    found = results.search_and_store(spark, root, *whole, limit=5)
    assert [r.event_id for r in found.orderBy(F.desc("timestamp"), "event_id").collect()] == expected(whole, 5)


def test_commit_between_the_listings_is_not_half_seen(spark, container, root, monkeypatch):
    """A run that commits after commits were listed is not seen at all, whatever of its manifest is."""
    put(container, H8, "a.ndjson", lines("a"))
    run(spark, container, root)
    put(container, H8, "b.ndjson", lines("b"))
    put(container, "2026/09/11/08", "c.ndjson", line("c", "2026-09-11T08:30:00Z") + "\n")
    names = cache.child_names

    def late(*args):
        if "manifest" not in args[1]:
            return names(*args)
        monkeypatch.setattr(cache, "child_names", names)
        run(spark, container, root, (SPAN[0], SPAN[0] + timedelta(days=2)))
        return names(*args)

    monkeypatch.setattr(cache, "child_names", late)
    assert [r.blob_path.rpartition("/")[2] for r in cache.read_manifest(spark, root).collect()] == ["a.ndjson"]
    assert cache.read_manifest(spark, root).count() == 3


def test_two_searches_at_once_keep_each_others_results(spark, container, root, monkeypatch):
    put(container, H8, "a.ndjson", lines("a", "b"))
    run(spark, container, root)
    for _ in range(4):
        results.search_and_store(spark, root, *SPAN)
    unique = lookup.unique_results
    inner = []

    def other(found):
        # Another search begins and ends while this one writes.
        monkeypatch.setattr(lookup, "unique_results", unique)
        inner.append(results.search_and_store(spark, root, *SPAN, {"event_id": "a"}))
        return unique(found)

    monkeypatch.setattr(lookup, "unique_results", other)
    results.search_and_store(spark, root, *SPAN, {"event_id": "b"})
    assert [r.event_id for r in results.read_results(spark, root).collect()] == ["b"]
    kept = child_names(spark, f"{root}/results/data/version=*")
    assert len(kept) == 2 and len(child_names(spark, f"{root}/results/versions/*")) == 2


def test_lookup_opens_only_the_files_of_the_results(spark, container, root, capsys):
    for hour in (H8, H9):
        put(container, hour, "a.ndjson", "\n".join(line(f"{hour[-2:]}{i}", f"2026-09-10T{hour[-2:]}:30:0{i}Z") for i in range(5)))
    run(spark, container, root)
    results.search_and_store(spark, root, *SPAN, {"event_id": "083"})
    found = results.lookup_last(spark, root)
    assert [r.event_id for r in found.collect()] == ["083"]
    assert len(found.inputFiles()) <= 2 and all("blob_hour=2026-09-10-09" not in f for f in found.inputFiles())


def test_a_malformed_line_keeps_only_its_hour_out(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    put(container, H9, "b.ndjson", lines("b") + "{")
    with pytest.raises(MalformedLineError, match="b.ndjson at line 2"):
        run(spark, container, root)
    assert [r[3] for r in stored(spark, root)] == ["a"]
    put(container, H9, "b.ndjson", lines("b"))
    assert run(spark, container, root) == (2, 1, 1)


def test_long_ranges_are_synced_in_units(spark, container, root):
    for day in (10, 11, 12):
        put(container, f"2026/09/{day}/08", "a.ndjson", line(f"e{day}", f"2026-09-{day}T08:30:00Z") + "\n")
    run(spark, container, root, (SPAN[0], SPAN[0] + timedelta(days=3)), unit_bytes=1)
    assert cache.read_commits(spark, root).count() == 3 and len(stored(spark, root)) == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from hourvault.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_paths_are_qualified_by_the_driver(spark):
    from hourvault.sources.storage import qualified

    assert qualified(spark, "/some/where").startswith("file:") and qualified(spark, "file:/a") == "file:/a"


def test_overlapping_syncs_lose_nothing(spark, container, root):
    """Several syncs at once into one cache."""
    for number in range(12):
        put(container, H8 if number % 2 else H9, f"f{number:02d}.ndjson", lines(*[f"{number}-{i}" for i in range(20)]))
    spans = [SPAN, SPAN, (SPAN[0], SPAN[0] + timedelta(hours=1)), (SPAN[0] + timedelta(hours=1), SPAN[1])]
    with ThreadPoolExecutor(len(spans)) as pool:
        list(pool.map(lambda span: run(spark, container, root, span), spans))
    assert len(stored(spark, root)) == len({r[1:] for r in stored(spark, root)}) == 240
    assert run(spark, container, root) == (12, 0, 12)
    assert cache_status(spark, root).head()[:2] == (12, 240)


def test_merged_runs_are_read_as_before(spark, container, root):
    def add(number):
        put(container, H8 if number % 2 else H9, f"f{number}.ndjson", lines(f"e{number}"))
        run(spark, container, root)

    def view():
        rows = cache.read_manifest(spark, root).select("blob_path", "run_id", "events_count", "blob_hour")
        return sorted(map(tuple, rows.collect())), cache.read_commits(spark, root).count(), stored(spark, root)

    for number in range(3):
        add(number)
    lose(spark, root, "2026-09-10-08")
    run(spark, container, root)  # a second copy of one file
    before = view()
    merge_runs(spark, root)
    assert view() == before
    add(3)
    assert len(view()[0]) == len(before[0]) + 1 and run(spark, container, root) == (4, 0, 4)
    before = view()
    merge_runs(spark, root)
    # The first merge's runs are gone as single files, the later run is still there.
    assert view() == before and len(child_names(spark, f"{root}/commits/*")) == 1
    add(4)
    before = view()
    merge_runs(spark, root)
    assert view() == before and len(child_names(spark, f"{root}/merged/*")) == 2
    assert cache.read_manifest(spark, root, ("2026-09-10-09", "2026-09-10-09")).count() == 3
    reset(spark, root)
    assert view() == ([], 0, [])


def test_a_first_sync_passes_no_rows_through_python_but_those_of_files(spark, container, root, capsys):
    """A cache without a manifest is an empty frame of the same columns, made without Python workers."""
    manifest = cache.read_manifest(spark, root)
    assert manifest.schema == T.StructType([T.StructField(f.name, f.dataType) for f in MANIFEST_SCHEMA.fields])
    assert manifest.collect() == [] and cache.read_commits(spark, root).collect() == []
    capsys.readouterr()
    current_files(spark, root).explain()
    assert "ExistingRDD" not in capsys.readouterr().out


def test_files_added_to_an_archive_are_no_python_rows(spark, monkeypatch, capsys):
    """The few files beside those of the table reach the writing tasks without Python workers of another kind."""
    frames = []
    monkeypatch.setattr(catalog.w, "write_files", lambda files, container: frames.append(files))
    extra = [("a/é.ndjson", '{"event_id":"é"}\n'), ("a/empty.ndjson", "")]
    catalog._extended_archive(spark, "/root/testdata/sf0.001", extra)
    assert [tuple(r) for r in frames[1].select("blob_path", "content").collect()] == extra
    capsys.readouterr()
    frames[1].explain()
    assert "ExistingRDD" not in capsys.readouterr().out
