"""Fixed schemas. Nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Public event columns, in stored order.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("application", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("blob_partition", T.StringType()),
        T.StructField("blob_name", T.StringType()),
        T.StructField("source_line", T.LongType()),
        T.StructField("raw_json", T.StringType()),
    ]
)

# The optional equality filters of a search.
FILTER_FIELDS = (
    "event_id",
    "application",
    "user_id",
    "organization_id",
    "event_name",
    "category",
)

# Stored event table: public columns, the full source path, the reason a line
# was refused (NULL for good events), then the partition columns.
EVENT_TABLE_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields
    + [
        T.StructField("blob_path", T.StringType()),
        T.StructField("bad_reason", T.StringType()),
        T.StructField("blob_hour", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("group_no", T.LongType()),
    ]
)

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("blob_path", T.StringType()),
        T.StructField("blob_partition", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("blob_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("blob_partition", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("group_no", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("events_count", T.LongType()),
        # Events a search can return (with ID and time), and the span of their times.
        T.StructField("searchable_count", T.LongType()),
        T.StructField("first_event", T.TimestampType()),
        T.StructField("last_event", T.TimestampType()),
        # The least and the greatest event ID; NULL in rows written before they were kept.
        T.StructField("first_id", T.StringType()),
        T.StructField("last_id", T.StringType()),
        T.StructField("refused_count", T.LongType()),
        # Stored files and bytes of the whole group: a group that lost some is missing.
        T.StructField("group_files", T.LongType()),
        T.StructField("group_bytes", T.LongType()),
        T.StructField("materialized_at", T.TimestampType()),
        # True where the file is gone from the archive and its events are no longer shown.
        T.StructField("removed", T.BooleanType()),
        T.StructField("blob_hour", T.StringType()),
        T.StructField("blob_day", T.StringType()),
    ]
)

COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("files_count", T.LongType()),
        T.StructField("events_count", T.LongType()),
        T.StructField("materialized_at", T.TimestampType()),
    ]
)

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("parquet_path", T.StringType()),
        T.StructField("source_line", T.LongType()),
        T.StructField("blob_partition", T.StringType()),
        T.StructField("blob_name", T.StringType()),
        T.StructField("blob_path", T.StringType()),
        T.StructField("blob_hour", T.StringType()),
    ]
)
