"""The event cache on disk: events, manifest and commits.

    <root>/events/run_id=<run>/blob_hour=<hour>/group_no=<n>/part-*.parquet
    <root>/manifest/blob_day=<day>/run_id=<run>/part-*.parquet   one row per source file
    <root>/commits/<run>/part-*.parquet                          one row per finished run
    <root>/merged/<merge>/{rows,commits}/...                     manifest and commits of many runs
    <root>/merges/<merge>                                        empty file: that merge is complete

A run exists for readers once its commit row does; that row is one small file,
written last. Runs never write into each other's directories, temporary ones
included, so syncs may overlap. Readers take from the manifest which runs hold
the hours they want and open just those directories.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.schema import COMMIT_SCHEMA, EVENT_TABLE_SCHEMA, MANIFEST_SCHEMA
from hourvault.session import broadcast_if_small, pin
from hourvault.sources.storage import child_names, exists, join_path, parent_names

HourBounds = tuple[str, str]


class LostDataError(RuntimeError):
    """The manifest names stored events that are no longer there."""


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, without the Python workers (one a core, besides those of other tasks) that local rows pass through."""
    return spark.range(0).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields])


def merge_names(spark: SparkSession, root: str) -> list[str]:
    """Complete merges, the newest last; names begin with their time."""
    return child_names(spark, join_path(root, "merges", "*"))


def merged_commits(spark: SparkSession, root: str, merge: str | None) -> DataFrame:
    """Commit rows of the runs that a merge covers."""
    if merge is None:
        return empty_frame(spark, COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(join_path(root, "merged", merge, "commits"))


def later_runs(spark: SparkSession, root: str, merge: str | None) -> list[str]:
    """Finished runs that the merge does not cover: those with a commit file. No job without a merge."""
    runs = parent_names(spark, join_path(root, "commits", "*", "part-*"))
    if merge is None or not runs:
        return runs
    covered = merged_commits(spark, root, merge).where(F.col("run_id").isin(runs)).select("run_id").collect()
    return sorted(set(runs) - {r["run_id"] for r in covered})


def _later_commits(spark: SparkSession, root: str, merge: str | None) -> DataFrame:
    """Commit rows of the runs that the merge does not cover."""
    path = join_path(root, "commits")
    if not exists(spark, path):
        return empty_frame(spark, COMMIT_SCHEMA)
    commits = spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    if merge is None:
        return commits
    return commits.join(merged_commits(spark, root, merge).select("run_id"), "run_id", "left_anti").select(*COMMIT_SCHEMA.names)


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished run."""
    merge = next(iter(merge_names(spark, root)[-1:]), None)
    return merged_commits(spark, root, merge).unionByName(_later_commits(spark, root, merge))


def read_manifest(spark: SparkSession, root: str, bounds: HourBounds | None = None) -> DataFrame:
    """Manifest rows of finished runs.

    Merges are listed before commits, and commits before the manifest. A run
    writes its manifest before its commit, so a run that is seen as finished is
    seen whole; one that commits between the listings is not seen at all.
    """
    merge = next(iter(merge_names(spark, root)[-1:]), None)
    later = _later_manifest(spark, root, later_runs(spark, root, merge), bounds)
    if merge is None:
        return later
    merged = spark.read.schema(MANIFEST_SCHEMA).parquet(join_path(root, "merged", merge, "rows"))
    if bounds is not None:
        days = F.col("blob_day").between(bounds[0][:10], bounds[1][:10])
        merged = merged.where(days & F.col("blob_hour").between(*bounds))
    return merged.select(*MANIFEST_SCHEMA.names).unionByName(later)


def _later_manifest(spark: SparkSession, root: str, finished: list[str], bounds: HourBounds | None) -> DataFrame:
    """Manifest rows of single runs; merges keep these few."""
    base = join_path(root, "manifest")
    days = child_names(spark, join_path(base, "blob_day=*"))
    if bounds is not None:
        days = [d for d in days if bounds[0][:10] <= d.partition("=")[2] <= bounds[1][:10]]
    if not days or not finished:
        return empty_frame(spark, MANIFEST_SCHEMA)
    paths = [join_path(base, day) for day in days]
    rows = spark.read.schema(MANIFEST_SCHEMA).option("basePath", base).parquet(*paths)
    if bounds is not None:
        rows = rows.where(F.col("blob_hour").between(*bounds))
    return rows.where(F.col("run_id").isin(finished)).select(*MANIFEST_SCHEMA.names)


def manifest_current(manifest: DataFrame) -> DataFrame:
    """Newest row per source file: one aggregate, so one shuffle of the rows."""
    others = [c for c in manifest.columns if c not in ("blob_path", "materialized_at", "run_id")]
    newest = F.max(F.struct("materialized_at", "run_id", *others)).alias("newest")
    return manifest.groupBy("blob_path").agg(newest).select("blob_path", "newest.*").select(*manifest.columns)


def _repeated(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("blob_path").agg(F.count("*").alias("copies")).where(F.col("copies") > 1).select("blob_path")


def manifest_entry(spark: SparkSession, root: str, blob_path: str, bounds: HourBounds | None = None) -> DataFrame:
    """The current row of one source file, or none."""
    return manifest_current(read_manifest(spark, root, bounds).where(F.col("blob_path") == blob_path))


def superseded(manifest: DataFrame) -> DataFrame:
    """(run_id, blob_path) pairs replaced by a newer run of the same file.

    Files read once, nearly all of them, are ruled out by a plain count.
    """
    copies = manifest.select("blob_path", "run_id", "materialized_at").join(_repeated(manifest), "blob_path", "left_semi")
    newest = copies.groupBy("blob_path").agg(
        F.max(F.struct("materialized_at", "run_id"))["run_id"].alias("_newest")
    )
    return (
        copies.join(newest, "blob_path")
        .where(F.col("run_id") != F.col("_newest"))
        .select("run_id", "blob_path")
    )


def hour_dirs(manifest: DataFrame) -> DataFrame:
    """Directories (`run_id`, `blob_hour`) that hold lines of manifest rows."""
    stored = F.col("events_count") + F.col("refused_count") > 0
    return manifest.where(stored).select("run_id", "blob_hour").distinct()


class Snapshot:
    """What the manifest says about some hours at one moment: read once, for all steps of a search.

    The driver holds one row per hour and run, like the directory listing Spark
    itself does. Only the newest copy of each file counts, and only directories
    that such copies need: those of older copies may be gone.
    """

    def __init__(self, spark: SparkSession, root: str, bounds: HourBounds | None = None):
        self.spark, self.root = spark, root
        self.entries = read_manifest(spark, root, bounds)
        self.hours = stored_hours(self.entries).collect()

    def read(self, only: Collection[str] | None = None, event_id: str | None = None) -> DataFrame:
        """Visible rows of the event table, refused lines included.

        `only` limits to a set of hours; `event_id` leaves out directories whose
        range of IDs does not reach it. Visible: the run is committed and the file
        was not read again by a newer run. Events are only joined when a directory
        holds older copies too; otherwise nothing is shuffled. Raises LostDataError
        if a directory is gone that current manifest rows need; a sync of its
        hours reads them again.
        """
        base = join_path(self.root, "events")
        wanted = [h for h in self.hours if h["stored"] and (only is None or h["blob_hour"] in only)]
        if event_id is not None:
            wanted = [h for h in wanted if not h["ids_known"] or (h["first_id"] or "") <= event_id <= (h["last_id"] or "")]
        paths = [join_path(base, f"run_id={h['run_id']}", f"blob_hour={h['blob_hour']}") for h in wanted]
        if not paths:
            return empty_frame(self.spark, EVENT_TABLE_SCHEMA).withColumn("parquet_path", F.lit(None).cast("string"))
        try:
            rows = self.spark.read.schema(EVENT_TABLE_SCHEMA).option("basePath", base).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise LostDataError(f"Stored events are gone; sync their hours again: {error}") from error
        rows = rows.withColumn("parquet_path", F.col("_metadata.file_path"))
        if not any(h["older_copies"] for h in self.hours):
            return rows
        runs = sorted({h["run_id"] for h in wanted})
        replaced = pin(superseded(self.entries).where(F.col("run_id").isin(runs)))
        if replaced.isEmpty():
            return rows
        replaced, _ = broadcast_if_small(replaced)
        return rows.join(replaced, ["run_id", "blob_path"], "left_anti")


def stored_hours(manifest: DataFrame) -> DataFrame:
    """What the newest copies of files come to, by run and hour.

    `stored` where there is data, `older_copies` of its files, `searchable` events
    with `first` and `last` time in microseconds, and the range of their IDs, which
    `ids_known` says to be complete. One aggregate by file, one over its result.
    """
    stored = F.col("events_count") + F.col("refused_count") > 0
    known = stored & (F.col("first_id").isNotNull() | (F.col("searchable_count") == 0)) | ~stored
    searchable = F.col("searchable_count") > 0
    copy = F.struct(
        "materialized_at", "run_id", "blob_hour", stored.alias("stored"), known.alias("known"), "searchable_count",
        F.when(searchable, F.unix_micros("first_event")).alias("first"), F.when(searchable, F.unix_micros("last_event")).alias("last"),
        "first_id", "last_id",
    )
    newest = manifest.groupBy("blob_path").agg(F.max(copy).alias("now"), F.count("*").alias("copies"))
    return newest.groupBy("now.run_id", "now.blob_hour").agg(
        F.bool_or("now.stored").alias("stored"),
        F.sum(F.col("copies") - 1).alias("older_copies"),
        F.sum("now.searchable_count").alias("searchable"),
        F.min("now.first").alias("first"),
        F.max("now.last").alias("last"),
        F.bool_and("now.known").alias("ids_known"),
        F.min("now.first_id").alias("first_id"),
        F.max("now.last_id").alias("last_id"),
    )


def read_stored(
    spark: SparkSession, root: str, bounds: HourBounds | None = None, only: Collection[str] | None = None
) -> DataFrame:
    """Visible rows of the event table in the hours of `bounds` (a first and last hour) and `only`, refused lines included."""
    return Snapshot(spark, root, bounds).read(only)


def read_events(
    spark: SparkSession, root: str, bounds: HourBounds | None = None, only: Collection[str] | None = None, seen: Snapshot | None = None
) -> DataFrame:
    """Visible events of the hours in `bounds` and `only` (all hours when None); of `seen`, if given, whose manifest is read already."""
    return good_rows((seen or Snapshot(spark, root, bounds)).read(only))


def good_rows(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("bad_reason").isNull()).drop("bad_reason")


def read_quarantine(spark: SparkSession, root: str, bounds: HourBounds | None = None) -> DataFrame:
    """Refused lines of committed runs."""
    return (
        read_stored(spark, root, bounds)
        .where(F.col("bad_reason").isNotNull())
        .select(
            "run_id", "blob_path", "blob_partition", "source_line",
            F.col("raw_json").alias("raw"), "bad_reason",
        )
    )
