"""The driver's tables as event data, and event archives made from them.

Shared by the registered queries, the benchmark and the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.functions.hours import hour_of, partition_of
from hourvault.lean import lean
from hourvault.session import scratch_path, small_batches
from hourvault.sources.archive import hour_prefix
from hourvault.sources.storage import join_path, open_storage

FOLDER = "audit"
# Lines of one file come from a fixed-width block of IDs, so no file grows with
# the number of events in its hour.
FILE_BLOCK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_ntz(df: DataFrame) -> DataFrame:
    """UTC instants as plain timestamps, the form the comparison expects."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _file_name() -> Column:
    event_id = F.col("event_id")
    return _text("events-", F.floor(event_id / FILE_BLOCK), "-", F.floor(event_id / 4) % 2, ".ndjson")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with the indexed fields, hour and file; IDs still numeric."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        _text("app-", F.col("event_id") % 3).alias("application"),
        _text("user-", F.col("user_id")).alias("user_id"),
        _text("org-", F.col("user_id") % 10).alias("organization_id"),
        F.upper("event_type").alias("event_name"),
        F.when(F.col("event_type").isin("purchase", "signup"), "account").otherwise("activity").alias("category"),
        F.col("ts").alias("timestamp"),
        partition_of(F.col("ts")).alias("blob_partition"),
        hour_of(F.col("ts")).alias("blob_hour"),
        _file_name().alias("blob_name"),
        "props",
    )


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the shape of the event table, by direct projection.

    `source_line` is the event ID here; the ingest queries check real lines.
    """
    rows = indexed(spark, sf_dir)
    return rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        "application",
        "user_id",
        "organization_id",
        "event_name",
        "category",
        "timestamp",
        "blob_partition",
        "blob_name",
        F.col("event_id").alias("source_line"),
        F.col("props").alias("raw_json"),
        _text(F.col("blob_partition"), "/", F.col("blob_name")).alias("blob_path"),
        "blob_hour",
    )


def _stamp() -> Column:
    """The same instant written four ways."""
    def text(value: Column) -> Column:
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    way = F.floor(F.col("event_id") / 4) % 4
    later = F.col("timestamp") + F.expr("INTERVAL 3 HOURS")
    return (
        F.when(way == 0, _text(text(F.col("timestamp")), "Z"))
        .when(way == 1, _text(text(later), "+03:00"))
        .when(way == 2, _text(text(later), "+0300"))
        .otherwise(text(F.col("timestamp")))
    )


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`indexed` plus `line`: each event as JSON text in one of four layouts."""
    rows = indexed(spark, sf_dir).withColumn("stamp", _stamp())
    event_id, stamp, props = F.col("event_id"), F.col("stamp"), F.col("props")
    app, user, org = F.col("application"), F.col("user_id"), F.col("organization_id")
    name, category = F.col("event_name"), F.col("category")
    head = ('{"event_id":"', event_id, '","application":"', app, '","timestamp":"', stamp, '"')
    people = ('{"user_id":"', user, '","organization_id":"', org, '"}')
    layout = event_id % 4
    nested = _text(*head, ',"event":{"name":"', name, '","category":"', category, '"},"actor":', *people, ',"payload":', props, "}")
    plain = _text(
        '{"event_id":', event_id, ',"application":"', app, '","timestamp":"', stamp,
        '","event_name":"', name, '","category":"', category, '","attributes":', *people, ',"payload":', props, "}",
    )
    both = _text(
        *head, ',"event":{"name":"', name, '","category":"', category, '"},"event_name":"other","category":"other","actor":',
        *people, ',"attributes":{"user_id":"other","organization_id":"other"},"payload":', props, "}",
    )
    fallback = _text(
        *head, ',"event":{"name":null,"category":null},"event_name":"', name, '","category":"', category,
        '","actor":null,"attributes":', *people, ',"payload":', props, "}",
    )
    line = F.when(layout == 0, nested).when(layout == 1, plain).when(layout == 2, both).otherwise(fallback)
    return rows.withColumn("line", line)


def files_of(lines: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Lines (`event_id`, `line`, hour and file) to whole files, in ID order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    return (
        lines.groupBy("blob_partition", F.col("blob_name").alias("file_name"))
        .agg(_text(F.array_join(ordered, "\n"), "\n").alias("content"))
        .select(
            F.concat_ws("/", hour_prefix(F.col("blob_partition"), folder), "file_name").alias("blob_path"),
            "blob_partition",
            "file_name",
            F.lit(1).cast("bigint").alias("first_line"),
            "content",
        )
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(encoded(spark, sf_dir))


# Files and their bytes that travel to a writing Python worker at once.
BATCH_FILES, BATCH_BYTES = 500, "4m"


def write_files(files: DataFrame, container: str) -> int:
    """Write `content` to `blob_path` under the container; number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(container)
        for batch in batches:
            for name, content in zip(batch.column("blob_path").to_pylist(), batch.column("content"), strict=True):
                path = join_path(root, name)
                filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(path) as sink:
                    sink.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = files.select("blob_path", "content").mapInArrow(lean(write), "n bigint")
    with small_batches(files.sparkSession, BATCH_FILES, BATCH_BYTES):
        return written.agg(F.sum("n")).head()[0] or 0


def remove_files(files: DataFrame, container: str) -> int:
    """Remove the files at `blob_path` from the container; number of files."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(container)
        for batch in batches:
            for path in batch.column("blob_path").to_pylist():
                filesystem.delete_file(join_path(root, path))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    removed = files.select("blob_path").mapInArrow(delete, "n bigint")
    return removed.agg(F.sum("n")).head()[0] or 0


_ARCHIVES: dict[tuple[str, str], str] = {}


def archive(spark: SparkSession, sf_dir: str) -> str:
    """Container with the archive of the whole `events` table; made once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ARCHIVES:
        container = scratch_path(spark, "archive")
        write_files(chunks(spark, sf_dir), container)
        _ARCHIVES[key] = container
    return _ARCHIVES[key]


def time_span(spark: SparkSession, sf_dir: str):
    """First and just-past-last event time of the whole table."""
    span = table(spark, sf_dir, "events").agg(
        F.min("ts").alias("first"), (F.max("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("end")
    ).head()
    return span["first"], span["end"]


_CACHES: dict[tuple[str, str], str] = {}


def cache(spark: SparkSession, sf_dir: str) -> str:
    """Event cache synced from the whole archive; made once per session."""
    from hourvault.plans.sync import sync

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHES:
        root = scratch_path(spark, "cache")
        sync(spark, archive(spark, sf_dir), root, *time_span(spark, sf_dir), folder=FOLDER)
        _CACHES[key] = root
    return _CACHES[key]
