"""From a result back to its stored event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.functions.hours import partition_to_hour
from hourvault.operators.search import check_limit
from hourvault.session import broadcast_if_small, pin

DETAIL_COLUMNS = ("event_id", "blob_partition", "blob_name", "source_line", "raw_json")
_KEY = ["blob_path", "source_line", "event_id"]


def lookup_event(events: DataFrame, event_id: str, blob_path: str, source_line: int, blob_partition: str) -> DataFrame:
    """The one event at a location, or no row."""
    hour = blob_partition.replace("/", "-")
    at = (
        (F.col("blob_path") == blob_path)
        & (F.col("source_line") == source_line)
        & (F.col("event_id") == event_id)
    )
    if "blob_hour" in events.columns:
        at = (F.col("blob_hour") == hour) & at
    return events.where(at).select(*DETAIL_COLUMNS).limit(1)


def lookup_results(events: DataFrame, results: DataFrame) -> DataFrame:
    """Stored events behind any number of results, in one join.

    The result side is broadcast once its rows and bytes are known to be small.
    """
    keys = pin(results.select(*_KEY, partition_to_hour(F.col("blob_partition")).alias("blob_hour")).distinct())
    keys, _ = broadcast_if_small(keys)
    on = [*_KEY, "blob_hour"] if "blob_hour" in events.columns else _KEY
    if on == _KEY:
        keys = keys.drop("blob_hour")
    return events.join(keys, on).select(*DETAIL_COLUMNS)


def unique_results(results: DataFrame) -> DataFrame:
    """One row per event ID: the newest, then the first in the search's tie order.

    An aggregate, so copies of one ID are reduced before the shuffle.
    """
    order = F.struct(
        (-F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("age"),
        "blob_partition",
        "blob_name",
        "source_line",
        *[c for c in ("blob_path",) if c in results.columns],
    )
    others = [c for c in results.columns if c != "event_id"]
    return (
        results.groupBy("event_id")
        .agg(F.min_by(F.struct(*others), order).alias("_first"))
        .select("event_id", "_first.*")
        .select(*results.columns)
    )


def find_ids(results: DataFrame, prefix: str, limit: int = 20, case_insensitive: bool = False) -> DataFrame:
    """Event IDs that start with a literal prefix, in order."""
    check_limit(limit)
    value, start = F.col("event_id"), F.lit(prefix)
    if case_insensitive:
        value, start = F.lower(value), F.lower(start)
    return results.where(value.startswith(start)).select("event_id").orderBy("event_id").limit(limit)
