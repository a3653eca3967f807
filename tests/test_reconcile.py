from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from conftest import line, put
from pyspark.sql import functions as F
from test_sync import H8, H9, SPAN, lines, run, stored

from hourvault.plans import maintenance, results
from hourvault.plans.maintenance import compact_hours, left_over, merge_runs, reclaim
from hourvault.plans.status import cache_status
from hourvault.plans.sync import data_files, reconcile_deleted, sync, sync_listing
from hourvault.session import pin
from hourvault.sources import cache
from hourvault.sources.storage import child_names, exists, join_path, remove

PATH8 = "audit/year=2026/month=09/day=10/hour=08"
LATER = timedelta(days=3)


def directories(spark, root):
    return sorted((r["run_id"], r["blob_hour"]) for r in cache.Snapshot(spark, root).hours if r["stored"])


def whole(spark, root):
    """All that a reader can see of the events."""
    columns = ("event_id", "timestamp", "blob_path", "blob_partition", "blob_name", "source_line", "raw_json")
    return sorted((tuple(r) for r in cache.read_events(spark, root).select(*columns).collect()), key=repr)


def manifest(spark, root):
    rows = cache.manifest_current(cache.read_manifest(spark, root)).drop("run_id", "group_no", "group_files", "group_bytes")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def after(delta=LATER):
    return datetime.now(timezone.utc) + delta


# ------------------------------------------------------------- re-compaction


def test_small_syncs_end_in_one_directory_an_hour(spark, container, root):
    for n in range(5):
        put(container, H8, f"f{n:02d}.ndjson", lines(f"a{n}", f"b{n}"))
        run(spark, container, root)
    put(container, H9, "only.ndjson", lines("c"))
    put(container, H8, "empty.ndjson", "")
    run(spark, container, root)
    events, rows = whole(spark, root), manifest(spark, root)
    assert len(directories(spark, root)) == 6 and len(events) == 11
    began = cache.read_events(spark, root).select("event_id")
    name = compact_hours(spark, root)
    hours = directories(spark, root)
    assert sorted(h for _, h in hours) == ["2026-09-10-08", "2026-09-10-09"] and (name, "2026-09-10-08") in hours
    assert whole(spark, root) == events and manifest(spark, root) == rows
    assert data_files(spark, root).where(F.col("run_id") == name).count() == 1
    # A reader that began before still ends; the status and the next sync see the same files.
    assert began.count() == 11
    assert cache_status(spark, root).head()["events_count"] == 11
    assert run(spark, container, root) == (7, 0, 7)
    assert compact_hours(spark, root) is None
    # Once it is old enough, what was replaced goes, and nothing else does.
    assert left_over(spark, root).count() == 0
    assert reclaim(spark, root, now=after()).count() == 5
    assert whole(spark, root) == events and run(spark, container, root) == (7, 0, 7)
    merge_runs(spark, root)
    merge_runs(spark, root)
    assert whole(spark, root) == events and left_over(spark, root, now=after()).count() == 0
    assert results.search_cache(spark, root, *SPAN, {"event_id": "a3"}).count() == 1


def test_groups_follow_the_target_and_refused_lines_move(spark, container, root):
    for n, text in enumerate([lines("a"), "not json\n" + lines("b"), lines("c"), lines("d")]):
        put(container, H8, f"f{n}.ndjson", text)
        run(spark, container, root, mode="quarantine")
    refused = [tuple(r)[1:] for r in cache.read_quarantine(spark, root).collect()]
    sizes = [r["size"] for r in data_files(spark, root).collect()]
    compact_hours(spark, root, target_bytes=2 * max(sizes))
    assert len(data_files(spark, root).where(F.col("run_id").startswith("z")).collect()) == 2
    assert [tuple(r)[1:] for r in cache.read_quarantine(spark, root).collect()] == refused and len(refused) == 1
    assert [e[0] for e in whole(spark, root)] == ["a", "b", "c", "d"]


def test_newer_copies_stay_newer_than_a_compaction(spark, container, root, monkeypatch):
    """While an hour is compacted, one of its files is read again and another is recorded as gone."""
    from hourvault.plans import maintenance

    for n in range(3):
        put(container, H8, f"f{n}.ndjson", lines(f"old{n}"))
        run(spark, container, root)
    publish = maintenance.publish

    def meanwhile(*args):
        put(container, H8, "f0.ndjson", lines("new0"))
        listing = spark.createDataFrame([(f"{PATH8}/f0.ndjson", H8, "f0.ndjson", len(lines("new0")))], "blob_path string, blob_partition string, file_name string, size bigint")
        from hourvault.plans.sync import materialize

        materialize(spark, container, root, pin(listing))
        (Path(container) / PATH8 / "f1.ndjson").unlink()
        reconcile_deleted(spark, container, root, *SPAN, folder="audit")
        publish(*args)

    monkeypatch.setattr(maintenance, "publish", meanwhile)
    compact_hours(spark, root)
    assert [e[0] for e in whole(spark, root)] == ["new0", "old2"]


def test_lost_groups_are_left_to_the_next_sync(spark, container, root):
    for n in range(3):
        put(container, H8, f"f{n}.ndjson", lines(f"e{n}"))
        run(spark, container, root)
    lost = data_files(spark, root).orderBy("run_id").head()
    remove(spark, join_path(root, "events", lost["file_path"]))
    compact_hours(spark, root)
    assert run(spark, container, root) == (3, 1, 2)
    assert [e[0] for e in whole(spark, root)] == ["e0", "e1", "e2"]


# ------------------------------------------------------------ reconciliation


def test_a_run_that_never_committed_goes_when_it_is_old(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    run(spark, container, root)
    dead = uuid.uuid4().hex
    files = Path(root.removeprefix("file:"))
    rows = pin(cache.read_manifest(spark, root).withColumn("run_id", F.lit(dead)))
    rows.write.mode("append").partitionBy("blob_day", "run_id").parquet(join_path(root, "manifest"))
    base = files / "events" / f"run_id={dead}"
    for part in ("blob_hour=2026-09-10-08/group_no=0/part-0.parquet", "_temporary/0/x/blob_hour=2026-09-10-08/part-1.parquet"):
        (base / part).parent.mkdir(parents=True)
        (base / part).write_bytes(b"half")
    assert left_over(spark, root).count() == 0  # it may still run
    before = whole(spark, root)
    found = reclaim(spark, root, now=after())
    assert {(r["run_id"], r["reason"]) for r in found.collect()} == {(dead, "uncommitted")} and found.agg(F.sum("files")).head()[0] == 2
    assert not base.exists() and whole(spark, root) == before
    assert not any(dead in n for day in child_names(spark, join_path(root, "manifest", "*")) for n in child_names(spark, join_path(root, "manifest", day, "*")))
    assert reclaim(spark, root, now=after()).count() == 0


def test_no_task_lists_a_whole_run(spark, root, tmp_path, monkeypatch):
    """What is left over is listed an hour of a run at a time, with the files and bytes of that hour."""
    seen, real = str(tmp_path / "listed"), maintenance.open_storage
    events = Path(root.removeprefix("file:")) / "events"
    wanted = {}
    for run_id in ("r1", "r2"):
        for hour in range(8):
            base = events / f"run_id={run_id}" / f"blob_hour=2026-09-10-{hour:02d}" / "group_no=0"
            base.mkdir(parents=True)
            for number in range(20 + hour):
                (base / f"part-{number}.parquet").write_bytes(b"x" * number)
            wanted[(run_id, f"2026-09-10-{hour:02d}")] = (20 + hour, sum(range(20 + hour)))
        (events / f"run_id={run_id}" / "_SUCCESS").write_bytes(b"")
        (events / f"run_id={run_id}" / "blob_hour=2026-09-10-23").mkdir()

    def noting(uri):
        filesystem, path = real(uri)

        class Noting:
            def get_file_info(self, selector):
                found = filesystem.get_file_info(selector)
                with open(seen, "a") as out:
                    out.write(f"{len(found)}\n")
                return found

        return Noting(), path

    monkeypatch.setattr(maintenance, "open_storage", noting)
    found = left_over(spark, root, now=after()).collect()
    assert {(r["run_id"], r["blob_hour"]): (r["files"], r["bytes"]) for r in found} == wanted
    assert len(found) == len(wanted) and {r["reason"] for r in found} == {"uncommitted"}
    assert max(int(n) for n in open(seen)) <= 28  # the longest hour: its group and 27 files


def test_replaced_copies_go_but_directories_with_current_ones_stay(spark, container, root):
    put(container, H8, "a.ndjson", lines("a"))
    put(container, H8, "b.ndjson", lines("b"))
    put(container, H9, "c.ndjson", lines("c"))
    run(spark, container, root, target_bytes=1)
    listing = [(f"{PATH8}/a.ndjson", H8, "a.ndjson", 1), (f"{PATH8.replace('08', '09')}/c.ndjson", H9, "c.ndjson", 1)]
    from hourvault.plans.sync import materialize

    sizes = [(p, h, n, (Path(container) / p).stat().st_size) for p, h, n, _ in [(PATH8 + "/a.ndjson", *listing[0][1:]), ("audit/year=2026/month=09/day=10/hour=09/c.ndjson", *listing[1][1:])]]
    materialize(spark, container, root, pin(spark.createDataFrame(sizes, "blob_path string, blob_partition string, file_name string, size bigint")))
    events = whole(spark, root)
    found = reclaim(spark, root, now=after()).collect()
    # Hour 8 of the first run still holds b; its hour 9 is replaced.
    assert [(r["blob_hour"], r["reason"]) for r in found] == [("2026-09-10-09", "replaced")]
    assert whole(spark, root) == events and [e[0] for e in events] == ["a", "b", "c"]


def test_deleted_files_vanish_and_come_back(spark, container, root):
    put(container, H8, "a.ndjson", lines("a1", "a2"))
    put(container, H8, "b.ndjson", lines("b"))
    put(container, H9, "c.ndjson", lines("c"))
    run(spark, container, root)
    results.search_and_store(spark, root, *SPAN)
    (Path(container) / PATH8 / "a.ndjson").unlink()
    gone = reconcile_deleted(spark, container, root, *SPAN, folder="audit")
    assert [tuple(r) for r in gone.collect()] == [(H8, 1)]
    assert [e[3] for e in stored(spark, root)] == ["b", "c"]
    assert tuple(cache_status(spark, root).head())[:2] == (2, 2)
    assert sorted(r["event_id"] for r in results.search_cache(spark, root, *SPAN).collect()) == ["b", "c"]
    assert reconcile_deleted(spark, container, root, *SPAN, folder="audit").count() == 0
    assert run(spark, container, root) == (2, 0, 2)
    # Compaction takes the rest along; merges keep the record.
    compact_hours(spark, root, most_directories=0)
    merge_runs(spark, root)
    assert [e[3] for e in stored(spark, root)] == ["b", "c"]
    reclaim(spark, root, now=after())
    assert [e[3] for e in stored(spark, root)] == ["b", "c"]
    put(container, H8, "a.ndjson", lines("a1", "a3"))
    assert run(spark, container, root) == (3, 1, 2)
    assert [e[3] for e in stored(spark, root)] == ["a1", "a3", "b", "c"]


def test_an_archive_out_of_reach_removes_nothing(spark, container, root):
    for n in range(4):
        put(container, H8, f"f{n}.ndjson", lines(f"e{n}"))
    run(spark, container, root)
    with pytest.raises(ValueError, match="most_share"):
        reconcile_deleted(spark, container + "-elsewhere", root, *SPAN, folder="audit")
    # Other folders' files are none of its business.
    assert reconcile_deleted(spark, container, root, *SPAN, folder="other").count() == 0
    assert reconcile_deleted(spark, container, root, SPAN[0], SPAN[0], folder="audit").count() == 0
    assert len(stored(spark, root)) == 4


# -------------------------------------------------------------- IDs and jobs


def scanned(frame):
    """Rows that the scans of a collected frame have read."""
    total = 0

    def walk(plan):
        nonlocal total
        name = plan.nodeName()
        if name.startswith("Scan parquet"):
            total += plan.metrics().apply("numOutputRows").value()
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return total


def test_bloom_filters_rule_out_row_groups_of_other_ids(spark, container, root):
    """IDs in no order: no range of IDs helps, the filters of the row groups do."""
    names = [uuid.UUID(int=(n * 0x9E3779B97F4A7C15F39CC0605CEDC834) % 2**128).hex for n in range(6000)]
    for n in range(20):
        put(container, H8, f"f{n:02d}.ndjson", "".join(line(e) + "\n" for e in names[n::20]))
    run(spark, container, root, target_bytes=1)
    assert data_files(spark, root).count() == 20
    found = results.search_cache(spark, root, *SPAN, {"event_id": names[77]})
    assert [r["event_id"] for r in found.collect()] == [names[77]]
    # Its own row group, and one in a hundred of the others by chance: 300 rows each.
    assert 0 < scanned(found) <= 900
    absent = results.search_cache(spark, root, *SPAN, {"event_id": "f" * 32})
    assert absent.count() == 0


def test_ranges_of_ids_rule_out_directories(spark, container, root):
    for n, hour in enumerate((H8, H9)):
        put(container, hour, "a.ndjson", lines(*[f"e{n}{k}" for k in range(10)]))
    run(spark, container, root)
    seen = cache.Snapshot(spark, root)
    assert sorted((r["first_id"], r["last_id"], r["ids_known"]) for r in seen.hours) == [("e00", "e09", True), ("e10", "e19", True)]
    assert seen.read(event_id="e05").select("parquet_path").distinct().count() == 1
    assert results.search_cache(spark, root, *SPAN, {"event_id": "e15"}).count() == 1
    assert results.search_cache(spark, root, *SPAN, {"event_id": "e99"}).count() == 0
    # Rows of an older cache have no range: their directories are opened.
    for r in seen.hours:
        assert r["searchable"] == 10
    old = seen.entries.withColumns({"first_id": F.lit(None).cast("string"), "last_id": F.lit(None).cast("string")})
    assert not any(r["ids_known"] for r in cache.stored_hours(old).collect())


def test_few_jobs_a_search(spark, container, root):
    for n in range(24):
        put(container, f"2026/09/10/{n:02d}", "a.ndjson", lines(*[f"e{n}-{k}" for k in range(6)]).replace("T08:", f"T{n:02d}:"))
    day = (datetime(2026, 9, 10), datetime(2026, 9, 11))
    run(spark, container, root, day)
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, *args, **options):
        spark.sparkContext.setJobGroup(name, name)
        n = len(results.search_cache(spark, root, *args, **options).collect())
        spark.sparkContext.setJobGroup("other", "other")
        return n, len(tracker.getJobIdsForGroup(name))

    n, hour = jobs("hour", day[0], day[0] + timedelta(hours=1), limit=100)
    assert n == 6 and hour <= 4
    n, newest = jobs("newest", *day, limit=20)
    assert n == 20 and newest <= 6
    n, one = jobs("filtered", *day, {"event_id": "e5-1"})
    assert n == 1 and one <= 4
