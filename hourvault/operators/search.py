"""Search over the event table: hours, time range, equality filters, newest first."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.functions.hours import as_utc, hour_bounds
from hourvault.operators.predicates import Predicate
from hourvault.schema import FILTER_FIELDS

# Limit policy.
DEFAULT_LIMIT = 100
MAX_LIMIT = 10_000

SUMMARY_COLUMNS = (
    "event_id",
    "user_id",
    "organization_id",
    "event_name",
    "category",
    "timestamp",
    "blob_partition",
    "blob_name",
    "source_line",
)
_LOCATOR = ("parquet_path", "source_line", "blob_partition", "blob_name", "blob_path")


def check_limit(limit: int, maximum: int = MAX_LIMIT) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if limit > maximum:
        raise ValueError(f"limit must not exceed {maximum}")
    return limit


def instant_literal(value: datetime, dtype: T.DataType) -> Column:
    """A UTC instant in the column's own type, so the filter reaches the scan."""
    utc = as_utc(value)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(utc.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(utc.astimezone(timezone.utc).isoformat(sep=" ")).cast("timestamp")


def in_range(events: DataFrame, from_utc: datetime, to_utc: datetime, column: str = "timestamp") -> Column:
    dtype = events.schema[column].dataType
    value = F.col(column)
    return (value >= instant_literal(from_utc, dtype)) & (value < instant_literal(to_utc, dtype))


def in_hours(bounds: tuple[str, str]) -> Column:
    """Hours of a range are contiguous, so pruning is one comparison pair."""
    return F.col("blob_hour").between(*bounds)


def equals(filters: Mapping[str, str | None]) -> list[Column]:
    """One equality per filter that is set; the empty string is a value."""
    unknown = set(filters) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"Unknown filters: {sorted(unknown)}")
    return [F.col(name) == filters[name] for name in FILTER_FIELDS if filters.get(name) is not None]


def newest_first(columns: list[str]) -> list[Column]:
    """Newest first, with a total order behind it."""
    ties = ["event_id", "blob_partition", "blob_name", "source_line", "blob_path"]
    return [F.desc("timestamp"), *[F.asc(c) for c in ties if c in columns]]


def search(
    events: DataFrame,
    from_utc: datetime,
    to_utc: datetime,
    filters: Mapping[str, str | None] | None = None,
    limit: int = DEFAULT_LIMIT,
    *,
    where: Predicate | None = None,
    lateness_hours: int = 0,
    max_limit: int = MAX_LIMIT,
) -> DataFrame:
    """Newest events in `[from_utc, to_utc)` matching all filters and `where`, a condition of any kind.

    Prunes by the hour of the source file, then filters on event time: an event
    outside its file's hour is found only if that hour is in range too.
    `lateness_hours` looks that much further.
    """
    check_limit(limit, max_limit)
    conditions = [F.col("event_id").isNotNull(), in_range(events, from_utc, to_utc), *equals(filters or {})]
    if "blob_hour" in events.columns:
        bounds = hour_bounds(from_utc, to_utc, lateness_hours)
        conditions.append(in_hours(bounds) if bounds else F.lit(False))
    if where is not None:
        conditions += where.conditions()
    extra = [c for c in ("parquet_path", "blob_path", "blob_hour") if c in events.columns]
    return (
        events.where(reduce(Column.__and__, conditions))
        .select(*SUMMARY_COLUMNS, *extra)
        .orderBy(*newest_first(events.columns))
        .limit(limit)
    )


def with_locator(results: DataFrame) -> DataFrame:
    """Where each event is stored, as one struct column."""
    kept = [c for c in results.columns if c not in _LOCATOR]
    return results.select(*kept, F.struct(*[c for c in _LOCATOR if c in results.columns]).alias("locator"))


def newest_hours(
    manifest: DataFrame, from_utc: datetime, to_utc: datetime, limit: int
) -> tuple[datetime, list[str]] | None:
    """A time floor for a search without filters, and the hours that reach it.

    From the manifest alone: hours whose searchable events all lie in the range
    are added up from the newest on; once they hold `limit` events, nothing
    older than their earliest event can be among the newest `limit`. None when
    the range holds too few. One row per hour reaches the driver.
    """
    hours = (
        manifest.where(F.col("searchable_count") > 0)
        .groupBy("blob_hour")
        .agg(
            F.sum("searchable_count").alias("searchable"),
            F.min(F.unix_micros("first_event")).alias("first"),
            F.max(F.unix_micros("last_event")).alias("last"),
        )
        .collect()
    )
    return hours_reaching(hours, from_utc, to_utc, limit)


def hours_reaching(
    hours: list, from_utc: datetime, to_utc: datetime, limit: int
) -> tuple[datetime, list[str]] | None:
    """The same from rows with `blob_hour`, `searchable` (their number), `first` and `last` (microseconds)."""
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    tick = timedelta(microseconds=1)
    start, end = (as_utc(from_utc) - epoch) // tick, (as_utc(to_utc) - epoch) // tick
    found, floor = 0, None
    for hour in sorted(hours, key=lambda h: h["first"], reverse=True):
        if hour["first"] >= start and hour["last"] < end:
            found += hour["searchable"]
        if found >= limit:
            floor = hour["first"]
            break
    if floor is None:
        return None
    return epoch + floor * tick, sorted({h["blob_hour"] for h in hours if h["last"] >= floor})
