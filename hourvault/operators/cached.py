"""Which source files are already in the cache, and what the cache holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GROUP = ["blob_hour", "run_id", "group_no"]


def _stored_groups(data_files: DataFrame) -> DataFrame:
    """Files and bytes of each group that are still there."""
    return data_files.groupBy(*_GROUP).agg(F.count("*").alias("_files"), F.sum("size").alias("_bytes"))


def _empty() -> Column:
    """Files of which nothing is stored: no events and no refused lines."""
    return (F.col("events_count") == 0) & (F.col("refused_count") == 0)


def _whole() -> Column:
    """All stored files of the row's group are still there, with all their bytes."""
    return F.coalesce((F.col("_files") == F.col("group_files")) & (F.col("_bytes") == F.col("group_bytes")), F.lit(False))


def live(current: DataFrame) -> DataFrame:
    """Current rows of files that are not recorded as gone from the archive."""
    if "removed" not in current.columns:
        return current
    return current.where(~F.coalesce("removed", F.lit(False)))


def present_files(current: DataFrame, data_files: DataFrame) -> DataFrame:
    """Current manifest rows whose stored data is complete.

    Files without lines need no data. `data_files` has one row per stored file
    with its `blob_hour`, `run_id`, `group_no` and `size`; a group of which one
    file is gone or cut off is missing as a whole.
    """
    marked = live(current).join(_stored_groups(data_files), _GROUP, "left")
    return marked.where(_empty() | _whole()).select(*current.columns)


def missing_files(listing: DataFrame, present: DataFrame) -> DataFrame:
    """Listed files that are not in the cache."""
    return listing.join(present.select("blob_path"), "blob_path", "left_anti")


def mark_missing(listing: DataFrame, present: DataFrame) -> DataFrame:
    """The whole listing with `is_missing`."""
    known = present.select("blob_path", F.lit(False).alias("is_missing"))
    return listing.join(known, "blob_path", "left").withColumn(
        "is_missing", F.coalesce("is_missing", F.lit(True))
    )


def sync_counts(marked: DataFrame) -> DataFrame:
    """Files discovered, materialized and skipped per hour."""
    return marked.groupBy("blob_partition").agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("is_missing")).alias("materialized"),
        F.count_if(~F.col("is_missing")).alias("skipped"),
    )


def sync_totals(counts: DataFrame) -> DataFrame:
    """The three counters over all hours; zeros when there are none."""
    return counts.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("discovered", "materialized", "skipped")
        ]
    )


def status_row(current: DataFrame, data_files: DataFrame) -> DataFrame:
    """Cached files, events, bytes and the last run, in one row.

    Manifest rows whose data is not complete do not count. Stored files count
    once, however many source files share them, and only if a current row uses
    them. Both sides are reduced to one row per group before they meet.
    """
    empty = _empty()
    wanted = live(current).groupBy(*_GROUP, "group_files", "group_bytes").agg(
        F.count("*").alias("files"),
        F.count_if(empty).alias("empty_files"),
        F.sum("events_count").alias("events"),
        F.max("materialized_at").alias("newest"),
        F.max(F.when(empty, F.col("materialized_at"))).alias("newest_empty"),
    )
    found = _whole()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return wanted.join(_stored_groups(data_files), _GROUP, "left").agg(
        total(F.when(found, F.col("files")).otherwise(F.col("empty_files"))).alias("blobs_count"),
        total(F.when(found, F.col("events"))).alias("events_count"),
        total(F.when(found, F.col("_bytes"))).alias("parquet_size_bytes"),
        F.max(F.when(found, F.col("newest")).otherwise(F.col("newest_empty"))).alias("last_materialized_at"),
    )
