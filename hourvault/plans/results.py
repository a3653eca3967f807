"""The stored result set of the last search, and searches that use it."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.functions.hours import hour_bounds
from hourvault.operators import lookup
from hourvault.operators.search import (
    DEFAULT_LIMIT,
    MAX_LIMIT,
    check_limit,
    instant_literal,
    hours_reaching,
    search,
)
from hourvault.operators.predicates import Predicate
from hourvault.operators.timerange import resolve_range
from hourvault.plans.sync import sync
from hourvault.schema import EVENT_TABLE_SCHEMA, RESULT_SCHEMA
from hourvault.session import pin
from hourvault.sources.cache import Snapshot, empty_frame, good_rows, read_events
from hourvault.sources.storage import exists, join_path, qualified, remove

_VERSION_SCHEMA = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("stored_at", T.TimestampType())]
)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Complete result sets, the newest first; cleaning keeps them few."""
    path = join_path(root, "results", "versions")
    if not exists(spark, path):
        return []
    markers = spark.read.schema(_VERSION_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    return [r["version"] for r in markers.orderBy(F.desc("stored_at"), F.desc("version")).collect()]


def _current_version(spark: SparkSession, root: str) -> str | None:
    return next(iter(_versions(spark, root)), None)


def _remove_old_results(spark: SparkSession, root: str) -> None:
    """Remove the sets replaced by a set that was itself replaced, then their markers.

    The last but one is kept for readers that opened it. A set without a marker
    belongs to a search that is not finished, and is left alone.
    """
    for version in _versions(spark, root)[2:]:
        remove(spark, join_path(root, "results", "data", f"version={version}"))
        remove(spark, join_path(root, "results", "versions", version))


def replace_results(spark: SparkSession, root: str, results: DataFrame) -> None:
    """Store a result set in place of the last one; one row per event ID.

    The old set stays readable until the new one is complete. Of searches that
    end at once, the one that is complete last counts.
    """
    version = uuid.uuid4().hex
    data = join_path(root, "results", "data")
    lookup.unique_results(results).select(*RESULT_SCHEMA.names).write.option("compression", "zstd").parquet(
        join_path(data, f"version={version}")
    )
    stamp = instant_literal(datetime.now(timezone.utc), T.TimestampType())
    marker = spark.range(1).select(F.lit(version).alias("version"), stamp.alias("stored_at")).coalesce(1)
    marker.write.parquet(join_path(root, "results", "versions", version))
    _remove_old_results(spark, root)


def clear_results(spark: SparkSession, root: str) -> None:
    replace_results(spark, root, empty_frame(spark, RESULT_SCHEMA))


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """The last stored result set; empty before the first search."""
    version = _current_version(spark, root)
    if version is None:
        return empty_frame(spark, RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).parquet(join_path(root, "results", "data", f"version={version}"))


def search_cache(
    spark: SparkSession,
    root: str,
    from_utc: datetime,
    to_utc: datetime,
    filters: Mapping[str, str | None] | None = None,
    limit: int = DEFAULT_LIMIT,
    *,
    where: Predicate | None = None,
    lateness_hours: int = 0,
    max_limit: int = MAX_LIMIT,
) -> DataFrame:
    """Search the cached hours of a range.

    The manifest is read once. Without filters, it names the few hours that can
    hold the newest events, and only those are read; with an event ID, it rules
    out directories by their range of IDs, and the Bloom filters of the stored
    files then rule out row groups.
    """
    check_limit(limit, max_limit)
    bounds = hour_bounds(from_utc, to_utc, lateness_hours)
    if bounds is None:
        return empty_frame(spark, RESULT_SCHEMA)
    filters = {name: value for name, value in (filters or {}).items() if value is not None}
    seen = Snapshot(spark, root, bounds)
    options = {"lateness_hours": lateness_hours, "max_limit": max_limit}
    if not filters and where is None:
        found = _newest(seen, from_utc, to_utc, limit, options)
        if found is not None:
            return found
    events = good_rows(seen.read(event_id=filters.get("event_id")))
    return search(events, from_utc, to_utc, filters, limit, where=where, **options)


def _newest(seen: Snapshot, from_utc: datetime, to_utc: datetime, limit: int, options: dict) -> DataFrame | None:
    """An unfiltered search over only the hours that can matter; None if that is not certain.

    The manifest names a time floor and the hours that reach it. Events outside
    those hours are older than the floor, so `limit` results from the floor on
    are the newest ones whatever else the range holds.
    """
    reach = hours_reaching([h for h in seen.hours if h["searchable"]], from_utc, to_utc, limit)
    if reach is None:
        return None
    floor, hours = reach
    found = pin(search(read_events(seen.spark, seen.root, None, hours, seen), from_utc, to_utc, limit=limit, **options))
    certain = found.where(F.col("timestamp") >= instant_literal(floor, T.TimestampType())).count() == limit
    return found if certain else None


def search_and_store(
    spark: SparkSession,
    root: str,
    from_utc: datetime,
    to_utc: datetime,
    filters: Mapping[str, str | None] | None = None,
    limit: int = DEFAULT_LIMIT,
    *,
    where: Predicate | None = None,
    lateness_hours: int = 0,
    max_limit: int = MAX_LIMIT,
) -> DataFrame:
    """Search, replace the stored result set (also by an empty one), return the results."""
    check_limit(limit, max_limit)
    found = pin(
        search_cache(
            spark, root, from_utc, to_utc, filters, limit,
            where=where, lateness_hours=lateness_hours, max_limit=max_limit,
        )
    )
    replace_results(spark, root, found)
    return found


def search_archive(
    spark: SparkSession,
    container: str,
    root: str,
    from_utc: datetime,
    to_utc: datetime,
    filters: Mapping[str, str | None] | None = None,
    limit: int = DEFAULT_LIMIT,
    *,
    folder: str = "",
    where: Predicate | None = None,
    max_limit: int = MAX_LIMIT,
    lateness_hours: int = 0,
    **sync_options,
) -> DataFrame:
    """Bring the hours of the range into the cache, then search and store."""
    check_limit(limit, max_limit)
    sync(
        spark, container, root, from_utc, to_utc, folder=folder, lateness_hours=lateness_hours, **sync_options
    )
    return search_and_store(
        spark, root, from_utc, to_utc, filters, limit,
        where=where, lateness_hours=lateness_hours, max_limit=max_limit,
    )


def lookup_last(spark: SparkSession, root: str, event_ids: list[str] | None = None) -> DataFrame:
    """Stored events behind the last results (all, or the given IDs).

    IDs that are not in the result set cost no scan. Each result names the file
    that holds its event, and only these files (no more than results) are
    opened; if one of them is gone, the hours of the results are read instead.
    """
    wanted = read_results(spark, root)
    if event_ids is not None:
        wanted = wanted.where(F.col("event_id").isin(event_ids))
    paths = [r["parquet_path"] for r in wanted.select("parquet_path").distinct().collect()]
    if paths and None not in paths:
        events = _stored_files(spark, root, paths)
        if events is not None:
            return lookup.lookup_results(events, wanted)
    hours = sorted(r["blob_hour"] for r in wanted.select("blob_hour").distinct().collect())
    if not hours:
        return lookup.lookup_results(empty_events(spark), wanted)
    return lookup.lookup_results(read_events(spark, root, (hours[0], hours[-1]), hours), wanted)


def _stored_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame | None:
    """Events of some stored files; None if one is no longer there."""
    reader = spark.read.schema(EVENT_TABLE_SCHEMA).option("basePath", qualified(spark, join_path(root, "events")))
    try:
        # The paths are as Spark reports them, with escapes.
        rows = reader.parquet(*[unquote(path) for path in paths])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("bad_reason").isNull()).drop("bad_reason")


def search_expression(
    spark: SparkSession,
    container: str | None,
    root: str,
    *,
    expr: str | None = None,
    from_text: str | None = None,
    to_text: str | None = None,
    tz: str = "UTC",
    now: datetime | None = None,
    filters: Mapping[str, str | None] | None = None,
    limit: int = DEFAULT_LIMIT,
    **options,
) -> DataFrame:
    """A search by a time expression (`last 2 hours`, `yesterday`, ISO texts) in any zone, in one call.

    With a container, missing hours are synced first; without one, the cache is
    searched as it is. The results are stored either way. Options are those of
    `search_archive` or `search_and_store`.
    """
    span = resolve_range(
        spark, now or datetime.now(timezone.utc), expr=expr, from_text=from_text, to_text=to_text, tz=tz
    )
    if container is None:
        return search_and_store(spark, root, *span, filters, limit, **options)
    return search_archive(spark, container, root, *span, filters, limit, **options)


def empty_events(spark: SparkSession) -> DataFrame:
    return empty_frame(spark, EVENT_TABLE_SCHEMA).drop("bad_reason")


def find_last_ids(spark: SparkSession, root: str, prefix: str, limit: int = 20, **options) -> DataFrame:
    return lookup.find_ids(read_results(spark, root), prefix, limit, **options)
