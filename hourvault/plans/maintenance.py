"""Keep the cache small: manifests of many runs in one place, an hour's events in one directory, nothing left over."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourvault.lean import lean
from hourvault.operators import cached
from hourvault.operators.grouping import assign_groups
from hourvault.plans.sync import ROW_GROUP_BYTES, TARGET_BYTES, data_files, files_read, publish, run_dir, stored_groups, write_events
from hourvault.session import broadcast_if_small, pin
from hourvault.sources.cache import (
    HourBounds,
    LostDataError,
    hour_dirs,
    manifest_current,
    merge_names,
    merged_commits,
    read_commits,
    read_manifest,
    read_stored,
)
from hourvault.sources.storage import child_names, join_path, open_storage, qualified, remove, touch

#: Age at which what nobody refers to is taken for left over: longer than any sync or reader runs.
OLD = timedelta(days=2)


def merge_runs(spark: SparkSession, root: str) -> str:
    """Gather manifest and commits of all finished runs; the merge's name.

    Readers then list one file a day and the runs since the merge, however many
    runs there were. Rows are those of before; events stay where they are. Runs
    may go on meanwhile. What the merge before this one covers is removed, and
    all merges but these two: a reader that began before a merge still finds its
    files until the next one. One merge at a time.
    """
    before = merge_names(spark, root)
    name = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex}"
    base = join_path(root, "merged", name)
    # Both from one look at the cache: a run that commits meanwhile is in neither.
    commits = pin(read_commits(spark, root))
    rows = read_manifest(spark, root).join(commits.select("run_id"), "run_id", "left_semi")
    rows.repartition("blob_day").write.option("compression", "zstd").partitionBy("blob_day").parquet(join_path(base, "rows"))
    commits.coalesce(1).write.parquet(join_path(base, "commits"))
    touch(spark, join_path(root, "merges", name))
    if before:
        _remove_covered(spark, root, before[-1])
    for old in before[:-1]:
        remove(spark, join_path(root, "merges", old))
        remove(spark, join_path(root, "merged", old))
    return name


def _remove_covered(spark: SparkSession, root: str, merge: str) -> None:
    """Remove the single manifests and commits of the runs a merge covers; counted in runs and days."""
    there = set(child_names(spark, join_path(root, "commits", "*")))
    covered = {r["run_id"] for r in merged_commits(spark, root, merge).select("run_id").collect()} & there
    for day in child_names(spark, join_path(root, "manifest", "blob_day=*")):
        for run in child_names(spark, join_path(root, "manifest", day, "run_id=*")):
            if run.partition("=")[2] in covered:
                remove(spark, join_path(root, "manifest", day, run))
    for run in covered:
        remove(spark, join_path(root, "commits", run))


# ------------------------------------------------------------- re-compaction


def compact_hours(
    spark: SparkSession,
    root: str,
    bounds: HourBounds | None = None,
    *,
    most_directories: int = 1,
    target_bytes: int = TARGET_BYTES,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> str | None:
    """Rewrite the hours whose events lie in more than `most_directories` directories; the run's id, or None.

    The stored groups of an hour are put together by the greedy rule, by size, and
    written again as groups of one new run, all in one directory an hour. Its
    manifest rows are those of before, with the new place. They are published by a
    commit like any sync: until then readers see the old directories, afterwards
    the new one, and never both. A reader that began before goes on with the old
    files, which stay until `reclaim`. A file that a sync reads again meanwhile, or
    that is recorded as removed, stays newer than its compacted copy.

    Rows move once, to the task of their new group. Before the commit, the counts
    of every file are compared with its manifest row.
    """
    current = cached.live(manifest_current(read_manifest(spark, root, bounds)))
    current = current.where(F.col("events_count") + F.col("refused_count") > 0)
    # Whole groups only: a group that lost a file is for the next sync.
    whole = cached.present_files(current, data_files(spark, root, bounds))
    hours = whole.groupBy("blob_hour").agg(F.count_distinct("run_id").alias("directories"))
    # Counted in hours.
    chosen = sorted(r["blob_hour"] for r in hours.where(F.col("directories") > most_directories).select("blob_hour").collect())
    if not chosen:
        return None
    files = pin(whole.where(F.col("blob_hour").isin(chosen)))
    keys = ["blob_hour", "run_id", "group_no"]
    groups = files.groupBy(*keys).agg(F.max("group_bytes").alias("size")).withColumn("name", F.concat_ws("/", "run_id", F.lpad("group_no", 19, "0")))
    assigned = pin(
        assign_groups(groups.withColumnRenamed("group_no", "old_group"), target_bytes, "blob_hour", "name")
        .select("blob_hour", "run_id", F.col("old_group"), F.col("group_no").alias("new_group"))
    )
    targets, _ = broadcast_if_small(assigned.withColumnRenamed("old_group", "group_no"))
    # Greater than the id of any sync run: of two copies of one time, the compacted one counts.
    run_id = f"z{time.time_ns() // 1000:020d}-{uuid.uuid4().hex}"
    rows = read_stored(spark, root, (chosen[0], chosen[-1]), chosen).drop("parquet_path")
    moved = rows.join(targets, keys).drop("group_no", "run_id").withColumnRenamed("new_group", "group_no")
    tasks = int(max(1, assigned.select("blob_hour", "new_group").distinct().count()))
    write_events(
        moved.repartition(tasks, "blob_hour", "group_no").sortWithinPartitions("blob_hour", "group_no", "blob_path", "source_line"),
        root, run_id, row_group_bytes,
    )
    counted = files_read(spark, root, run_id).select(
        "blob_path", F.col("events_count").alias("_events"), F.col("refused_count").alias("_refused")
    )
    same = (F.col("events_count") == F.col("_events")) & (F.col("refused_count") == F.col("_refused"))
    lost = files.join(counted, "blob_path", "left").where(~F.coalesce(same, F.lit(False))).count()
    if lost:
        remove(spark, run_dir(root, run_id))
        raise LostDataError(f"{lost} files were not copied whole; sync their hours again")
    stored = stored_groups(spark, root, run_id, files.select("blob_hour").distinct()).withColumnRenamed("group_no", "new_group")
    manifest = (
        files.drop("group_files", "group_bytes")
        .withColumnRenamed("group_no", "old_group")
        .join(assigned, ["blob_hour", "run_id", "old_group"])
        .join(stored, ["blob_hour", "new_group"])
        .drop("old_group", "run_id")
        .withColumnRenamed("new_group", "group_no")
        .withColumn("run_id", F.lit(run_id))
    )
    days = len({hour[:10] for hour in chosen})
    publish(spark, root, run_id, manifest, days, files.count())
    return run_id


# ------------------------------------------------------------ reconciliation


_LISTED = "run_id string, blob_hour string, directory string, files bigint, bytes bigint, newest timestamp"


def _hours_of_runs(events_root: str):
    """The directories right below those of runs: hours, and what a writer that has not ended leaves beside them."""
    schema = pa.schema([("run_id", pa.string()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(events_root)
        for batch in batches:
            for run_id in batch.column("run_id").to_pylist():
                infos = filesystem.get_file_info(pafs.FileSelector(join_path(root, f"run_id={run_id}"), allow_not_found=True))
                parts = [info.base_name for info in infos if info.type == pafs.FileType.Directory]
                yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(parts), pa.string()), pa.array(parts, pa.string())], schema=schema)

    return run


def _list_directories(events_root: str):
    """Directories (`run_id`, `part`) that hold files, with their files, bytes and the time of their newest file."""
    schema = pa.schema(
        [
            ("run_id", pa.string()), ("blob_hour", pa.string()), ("directory", pa.string()), ("files", pa.int64()),
            ("bytes", pa.int64()), ("newest", pa.timestamp("us", "UTC")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(events_root)
        for batch in batches:
            rows = []
            for run_id, part in zip(batch.column("run_id").to_pylist(), batch.column("part").to_pylist(), strict=True):
                directory = f"run_id={run_id}/{part}"
                infos = filesystem.get_file_info(pafs.FileSelector(join_path(root, directory), recursive=True, allow_not_found=True))
                held = [info for info in infos if info.type == pafs.FileType.File]
                if held:
                    totals = len(held), sum(info.size for info in held), max(info.mtime for info in held)
                    rows.append((run_id, part.removeprefix("blob_hour="), directory, *totals))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return run


def left_over(spark: SparkSession, root: str, older: timedelta = OLD, now: datetime | None = None) -> DataFrame:
    """Directories of events that no reader needs: run_id, blob_hour, directory, reason, files, bytes.

    `uncommitted`: of a run that never committed and has written nothing for
    `older` (a running sync still writes). `replaced`: of a finished run, but no
    current manifest row points there any more, and nothing has changed in the
    hour for `older`, so that readers that began before have ended. Directories
    are listed in tasks, an hour of a run at a time, and meet the manifest in anti-joins.
    """
    before = F.lit((now or datetime.now(timezone.utc)) - older)
    # Listed before the commits: a run that commits in between counts as finished.
    runs = [name.partition("=")[2] for name in child_names(spark, join_path(root, "events", "run_id=*"))]
    events_root, tasks = qualified(spark, join_path(root, "events")), 4 * spark.sparkContext.defaultParallelism
    names = spark.createDataFrame(pa.table({"run_id": pa.array(runs, pa.string())})).repartition(max(1, min(len(runs), tasks)), "run_id")
    parts = names.mapInArrow(lean(_hours_of_runs(events_root)), "run_id string, part string").repartition(tasks, "run_id", "part")
    listed = pin(parts.mapInArrow(lean(_list_directories(events_root)), _LISTED))
    finished = read_commits(spark, root).select("run_id")
    entries = read_manifest(spark, root)
    needed = hour_dirs(manifest_current(entries))
    idle = listed.groupBy("run_id").agg(F.max("newest").alias("last")).where(F.col("last") < before)
    changes = listed.select("blob_hour", "newest").unionByName(entries.select("blob_hour", F.col("materialized_at").alias("newest")))
    quiet = changes.groupBy("blob_hour").agg(F.max("newest").alias("last")).where(F.col("last") < before)
    uncommitted = listed.join(finished, "run_id", "left_anti").join(idle, "run_id", "left_semi")
    replaced = (
        listed.join(finished, "run_id", "left_semi")
        .join(needed, ["run_id", "blob_hour"], "left_anti")
        .join(quiet, "blob_hour", "left_semi")
    )
    reasons = uncommitted.withColumn("reason", F.lit("uncommitted")).unionByName(replaced.withColumn("reason", F.lit("replaced")))
    return reasons.select("run_id", "blob_hour", "directory", "reason", "files", "bytes")


def reclaim(spark: SparkSession, root: str, older: timedelta = OLD, now: datetime | None = None) -> DataFrame:
    """Remove what `left_over` finds, and the manifest rows of runs that never committed; what was removed.

    Directories are removed in tasks. Stopped half-way, it is simply run again.
    """
    found = pin(left_over(spark, root, older, now))
    events_root = qualified(spark, join_path(root, "events"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_storage(events_root)
        for batch in batches:
            for directory in batch.column("directory").to_pylist():
                path = join_path(base, directory)
                if filesystem.get_file_info(path).type == pafs.FileType.Directory:
                    filesystem.delete_dir(path)
            yield batch.select(["directory"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    found.select("directory").repartition(tasks, "directory").mapInArrow(lean(delete), "directory string").count()
    # The rest is counted in runs: their folders, once empty, and manifests that were never seen.
    for row in found.select("run_id", "reason").distinct().collect():
        if not child_names(spark, join_path(run_dir(root, row["run_id"]), "*=*")):
            remove(spark, run_dir(root, row["run_id"]))
        if row["reason"] == "uncommitted":
            for day in child_names(spark, join_path(root, "manifest", "blob_day=*")):
                remove(spark, join_path(root, "manifest", day, f"run_id={row['run_id']}"))
    return found
