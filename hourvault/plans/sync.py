"""Bring missing archive files into the event cache.

One run: list -> drop files already cached -> group -> read, parse and write ->
manifest -> commit. Only file names are shuffled; the text of a file is read,
parsed and written in the same task. Nothing of a run is visible before its
commit row, and a re-run picks up whatever is missing.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.functions.hours import hour_bounds, hours_frame
from hourvault.operators import cached
from hourvault.operators.grouping import assign_groups
from hourvault.operators.ingest import MalformedLineError, to_events
from hourvault.operators.search import instant_literal
from hourvault.schema import COMMIT_SCHEMA, EVENT_TABLE_SCHEMA, LISTING_SCHEMA, MANIFEST_SCHEMA
from hourvault.session import open_writers, pin
from hourvault.sources import archive
from hourvault.sources.cache import HourBounds, empty_frame, hour_dirs, manifest_current, read_manifest
from hourvault.sources.storage import join_path, remove

TARGET_BYTES = 128 * 1024 * 1024
ROW_GROUP_BYTES = 128 * 1024 * 1024
# Work of one read-parse-write task.
TASK_BYTES = 64 * 1024 * 1024
TASK_FILES = 2_000
# Output files a writing task keeps open. Each takes up to 8 MB for buffers and Bloom filters from the
# first row on (16 of them in each of 8 tasks end a heap of 1 GB). Groups of TARGET_BYTES are one or
# two a task; a task with many small groups sorts what is left after its first ones.
OPEN_FILES = 4
# Source bytes one run takes on before the next one begins.
UNIT_BYTES = 1 << 40
# Tasks move their files into place themselves instead of leaving all renames to
# the driver. The files become visible only through the commit row anyway.
_PARALLEL_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
# A Bloom filter of the event IDs of each row group, as large as its IDs need: the writer
# fills candidates from 512 bytes to 2 MB, each half the next, and drops those that get too full.
_ID_FILTERS = {
    "parquet.bloom.filter.enabled#event_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.candidates.number#event_id": "13",
    "parquet.bloom.filter.max.bytes": str(2 * 1024 * 1024),
}


def data_files(spark: SparkSession, root: str, bounds: HourBounds | None = None) -> DataFrame:
    """Stored event files of committed runs with hour, run, group and size, listed by tasks."""
    return archive.list_stored(join_path(root, "events"), hour_dirs(read_manifest(spark, root, bounds)))


def current_files(spark: SparkSession, root: str, bounds: HourBounds | None = None) -> DataFrame:
    """Current manifest rows whose data exists."""
    current = manifest_current(read_manifest(spark, root, bounds))
    return cached.present_files(current, data_files(spark, root, bounds))


def _write_events(
    files: DataFrame,
    container: str,
    root: str,
    run_id: str,
    tasks: int,
    split_bytes: int,
    row_group_bytes: int,
    empty_as_missing: bool,
) -> None:
    """Parse and write, one task per group.

    A file above `split_bytes` is read by several tasks, so it ends up as
    several Parquet files in its group's directory.
    """
    ranges = archive.byte_ranges(files, container, split_bytes)
    # The explicit count keeps AQE from merging these tiny rows into one task.
    placed = ranges.repartition(tasks, "blob_hour", "group_no", "start").sortWithinPartitions(
        "blob_hour", "group_no", "blob_path", "start"
    )
    keep = ["blob_path", "blob_partition", "file_name", "blob_hour", "group_no"]
    events = to_events(archive.read_ranges(placed, container, keep), empty_as_missing)
    write_events(events, root, run_id, row_group_bytes)


def write_events(events: DataFrame, root: str, run_id: str, row_group_bytes: int) -> None:
    """Write rows of the event table, refused lines included, below the directory of a run."""
    rows = events.select(*[name for name in EVENT_TABLE_SCHEMA.names if name != "run_id"])
    options = {"parquet.block.size": str(row_group_bytes), **_PARALLEL_COMMIT, **_ID_FILTERS}
    # The rows of a group come together as they are read: no sort of whole rows, raw text included.
    with open_writers(events.sparkSession, OPEN_FILES):
        rows.write.mode("append").options(compression="zstd", **options).partitionBy("blob_hour", "group_no").parquet(run_dir(root, run_id))


def run_dir(root: str, run_id: str) -> str:
    return join_path(root, "events", f"run_id={run_id}")


def files_read(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Per file of a run that has lines: what its manifest row says, and its first refused line."""
    rows = spark.read.schema(EVENT_TABLE_SCHEMA).parquet(run_dir(root, run_id))
    refused = F.col("bad_reason").isNotNull()
    # Refused lines have neither ID nor time.
    time = F.when(F.col("event_id").isNotNull(), F.col("timestamp"))
    return rows.groupBy("blob_path").agg(
        F.first("blob_hour").alias("blob_hour"),
        F.count_if(~refused).alias("events_count"),
        F.count_if(refused).alias("refused_count"),
        F.count(time).alias("searchable_count"),
        F.min(time).alias("first_event"),
        F.max(time).alias("last_event"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
        F.min(F.when(refused, F.col("source_line"))).alias("first_bad"),
    )


def materialize(
    spark: SparkSession,
    container: str,
    root: str,
    missing: DataFrame,
    *,
    mode: str = "failfast",
    target_bytes: int = TARGET_BYTES,
    split_bytes: int = archive.SPLIT_BYTES,
    row_group_bytes: int = ROW_GROUP_BYTES,
    empty_as_missing: bool = False,
    bounds: HourBounds | None = None,
    now: datetime | None = None,
) -> str | None:
    """Ingest the given files as one run; its id, or None if there are none.

    `missing` must be stable (pinned): it is read more than once. All of it must
    lie in the hours of `bounds`, if given.
    `mode="failfast"` publishes the hours without a malformed line, then fails
    on the first such line; `mode="quarantine"` publishes all good lines and
    keeps the others aside.
    """
    if mode not in ("failfast", "quarantine"):
        raise ValueError(f"Unknown mode: {mode!r}")
    for name, value in (
        ("target_bytes", target_bytes),
        ("split_bytes", split_bytes),
        ("row_group_bytes", row_group_bytes),
    ):
        if value < 1:
            raise ValueError(f"{name} must be at least 1")
    missing = archive.with_hour(missing)
    totals = missing.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.countDistinct(F.substring("blob_hour", 1, 10)).alias("days"),
        F.count_if(~F.col("blob_hour").between(*(bounds or ("0", "9999")))).alias("outside"),
    ).head()
    if totals["files"] == 0:
        return None
    if totals["outside"]:
        raise ValueError(f"{totals['outside']} files lie outside the requested hours")

    run_id = uuid.uuid4().hex
    assigned = pin(assign_groups(missing, target_bytes, count=totals["files"]))
    # Enough tasks for the bytes and, as small files cost latency, for the files.
    work = totals["bytes"] // TASK_BYTES + totals["files"] // TASK_FILES
    tasks = int(max(3 * spark.sparkContext.defaultParallelism, work))
    _write_events(
        assigned.where(F.col("size") > 0),
        container,
        root,
        run_id,
        tasks,
        split_bytes,
        row_group_bytes,
        empty_as_missing,
    )

    read = pin(files_read(spark, root, run_id))
    first, bad_hours = None, []
    if mode == "failfast":
        bad = read.where(F.col("first_bad").isNotNull())
        first = bad.orderBy("blob_path").select("blob_path", "first_bad").head()
    if first is not None:
        # The hours with a malformed line are not published; the others are.
        bad_hours = [r["blob_hour"] for r in bad.select("blob_hour").distinct().collect()]
        for hour in bad_hours:
            remove(spark, join_path(run_dir(root, run_id), f"blob_hour={hour}"))
        assigned = assigned.where(~F.col("blob_hour").isin(bad_hours))
        if assigned.isEmpty():
            remove(spark, run_dir(root, run_id))
            raise _malformed(first)
    stamp = instant_literal(now or datetime.now(timezone.utc), T.TimestampType())
    hours = read.select("blob_hour").distinct()
    rows = assigned.join(read.drop("blob_hour"), "blob_path", "left").join(
        stored_groups(spark, root, run_id, hours), ["blob_hour", "group_no"], "left"
    )
    counts = ("events_count", "searchable_count", "refused_count", "group_files", "group_bytes")
    manifest = rows.withColumns(
        {
            **{name: F.coalesce(name, F.lit(0).cast("bigint")) for name in counts},
            "run_id": F.lit(run_id),
            "materialized_at": stamp,
            "removed": F.lit(False),
        }
    )
    publish(spark, root, run_id, manifest, totals["days"], totals["files"])
    if first is not None:
        raise _malformed(first)
    return run_id


def stored_groups(spark: SparkSession, root: str, run_id: str, hours: DataFrame) -> DataFrame:
    """Files and bytes of each group that a run has written for some hours."""
    found = archive.list_stored(join_path(root, "events"), hours.select(F.lit(run_id).alias("run_id"), "blob_hour"))
    return found.groupBy("blob_hour", "group_no").agg(F.count("*").alias("group_files"), F.sum("size").alias("group_bytes"))


def publish(spark: SparkSession, root: str, run_id: str, manifest: DataFrame, days: int, files: int) -> None:
    """Write the manifest rows of a run, then its commit: from then on readers see it."""
    manifest = manifest.withColumn("blob_day", F.substring("blob_hour", 1, 10))
    # One file per day, more for a day with very many files.
    parts = 1 + files // 1_000_000
    (
        manifest.select(*MANIFEST_SCHEMA.names)
        .repartition(int(max(1, days * parts)), "blob_day", F.pmod(F.xxhash64("blob_path"), F.lit(parts)))
        .write.mode("overwrite")
        # Only this run's own partitions, through a staging folder of its own.
        .options(compression="zstd", partitionOverwriteMode="dynamic")
        .partitionBy("blob_day", "run_id")
        .parquet(join_path(root, "manifest"))
    )
    # The commit point: one row, one small file.
    commit = manifest.agg(
        F.lit(run_id).alias("run_id"),
        F.count("*").alias("files_count"),
        F.sum("events_count").alias("events_count"),
        F.max("materialized_at").alias("materialized_at"),
    ).select(*COMMIT_SCHEMA.names)
    commit.coalesce(1).write.parquet(join_path(root, "commits", run_id))


def _malformed(first) -> MalformedLineError:
    return MalformedLineError(f"Failed to parse {first['blob_path']} at line {first['first_bad']}")


def sync_listing(
    spark: SparkSession,
    container: str,
    root: str,
    listing: DataFrame,
    bounds: HourBounds | None,
    *,
    unit_bytes: int = UNIT_BYTES,
    **options,
) -> DataFrame:
    """Sync a known listing; counts per hour.

    A long range is synced in units of whole days, each a run of its own, so
    that it goes on where it stopped. A malformed line keeps only its hour from
    being stored: the units go on, and the first such line is raised at the end.
    """
    present = current_files(spark, root, bounds)
    marked = pin(cached.mark_missing(listing.select(*LISTING_SCHEMA.names), present))
    missing = marked.where(F.col("is_missing")).drop("is_missing")
    failed = None
    for first, last in _units(missing, unit_bytes):
        days = F.substring("blob_partition", 1, 10).between(first, last)
        try:
            materialize(spark, container, root, missing.where(days), bounds=bounds, **options)
        except MalformedLineError as error:
            failed = failed or error
    if failed is not None:
        raise failed
    return cached.sync_counts(marked)


def _units(missing: DataFrame, unit_bytes: int) -> list[tuple[str, str]]:
    """First and last day of each run; days are added while they fit. One row a day reaches the driver."""
    day = F.substring("blob_partition", 1, 10).alias("day")
    units: list[tuple[str, str]] = []
    held = 0
    for row in missing.groupBy(day).agg(F.sum("size").alias("bytes")).orderBy("day").collect():
        if units and held + row["bytes"] <= unit_bytes:
            units[-1] = (units[-1][0], row["day"])
            held += row["bytes"]
        else:
            units.append((row["day"], row["day"]))
            held = row["bytes"]
    return units


def sync(
    spark: SparkSession,
    container: str,
    root: str,
    from_utc: datetime,
    to_utc: datetime,
    *,
    folder: str = "",
    lateness_hours: int = 0,
    **options,
) -> DataFrame:
    """Sync all hours that `[from_utc, to_utc)` touches; counts per hour.

    The counters count files. Options are those of `materialize`.
    """
    bounds = hour_bounds(from_utc, to_utc, lateness_hours)
    if bounds is None:
        return cached.sync_counts(empty_frame(spark, LISTING_SCHEMA).withColumn("is_missing", F.lit(True)))
    hours = hours_frame(spark, from_utc, to_utc + timedelta(hours=lateness_hours))
    listing = archive.list_archive(hours, container, folder)
    return sync_listing(spark, container, root, listing, bounds, **options)


def reconcile_deleted(
    spark: SparkSession,
    container: str,
    root: str,
    from_utc: datetime,
    to_utc: datetime,
    *,
    folder: str = "",
    lateness_hours: int = 0,
    most_share: float = 0.5,
    now: datetime | None = None,
) -> DataFrame:
    """Take files that are gone from the archive out of the cache; their number per hour.

    One run whose manifest rows say that a file is removed: readers no longer show
    its events, and the hour's other files stay as they are. A file that comes
    back is missing like any other, and the next sync reads it again. Data is
    removed by `maintenance.reclaim`. An archive that cannot be reached looks like
    an empty one, so more than `most_share` of the cached files are not taken out
    at once: that raises ValueError.
    """
    bounds = hour_bounds(from_utc, to_utc, lateness_hours)
    columns = ["blob_path", "file_name", "blob_partition", "blob_hour"]
    if bounds is None:
        known = read_manifest(spark, root).limit(0).select(*columns)
        gone = known
    else:
        hours = hours_frame(spark, from_utc, to_utc + timedelta(hours=lateness_hours))
        prefix = folder.strip("/") + "/" if folder.strip("/") else ""
        known = cached.live(manifest_current(read_manifest(spark, root, bounds))).select(*columns)
        known = pin(known.where(F.col("blob_path").startswith(prefix)) if prefix else known)
        gone = pin(known.join(archive.list_archive(hours, container, folder).select("blob_path"), "blob_path", "left_anti"))
    files = gone.count()
    if files and files > most_share * known.count():
        raise ValueError(f"{files} of {known.count()} cached files are not in the archive; see most_share")
    if files:
        run_id = uuid.uuid4().hex
        zero, none = F.lit(0).cast("bigint"), F.lit(None)
        stamp = instant_literal(now or datetime.now(timezone.utc), T.TimestampType())
        counts = ("group_no", "size", "events_count", "searchable_count", "refused_count", "group_files", "group_bytes")
        manifest = gone.withColumns(
            {
                **{name: zero for name in counts},
                **{name: none.cast("timestamp") for name in ("first_event", "last_event")},
                **{name: none.cast("string") for name in ("first_id", "last_id")},
                "run_id": F.lit(run_id),
                "materialized_at": stamp,
                "removed": F.lit(True),
            }
        )
        days = gone.select(F.substring("blob_hour", 1, 10)).distinct().count()
        publish(spark, root, run_id, manifest, days, files)
    return gone.groupBy("blob_partition").agg(F.count("*").alias("removed"))


def reset(spark: SparkSession, root: str) -> None:
    """Drop the cache and all its metadata; the archive is not touched."""
    # Commits first: without them no reader sees a half-removed table.
    for table in ("merges", "commits", "merged", "manifest", "events", "results"):
        remove(spark, join_path(root, table))
