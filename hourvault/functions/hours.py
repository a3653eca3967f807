"""The two spellings of a UTC hour and the expansion of ranges into hours."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Logical key of an hour, and its form safe in directory names.
PARTITION_FORMAT = "yyyy/MM/dd/HH"
HOUR_FORMAT = "yyyy-MM-dd-HH"


def partition_of(instant: Column) -> Column:
    return F.date_format(instant, PARTITION_FORMAT)


def hour_of(instant: Column) -> Column:
    return F.date_format(instant, HOUR_FORMAT)


def partition_to_hour(partition: Column) -> Column:
    return F.translate(partition, "/", "-")


def as_utc(value: datetime) -> datetime:
    """UTC, timezone-aware; naive input is UTC."""
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def hour_bounds(from_utc: datetime, to_utc: datetime, lateness_hours: int = 0) -> tuple[str, str] | None:
    """First and last `blob_hour` of a half-open range; None when it is empty.

    `lateness_hours` widens the end, for events that arrive in later files.
    """
    start = as_utc(from_utc).replace(minute=0, second=0, microsecond=0)
    last = as_utc(to_utc) - timedelta(microseconds=1)
    if last < start:
        return None
    last = last.replace(minute=0, second=0, microsecond=0) + timedelta(hours=lateness_hours)
    return start.strftime("%Y-%m-%d-%H"), last.strftime("%Y-%m-%d-%H")


def hours_of_ranges(ranges: DataFrame, from_col: str = "from_utc", to_col: str = "to_utc") -> DataFrame:
    """One row per range and hour it touches, with `blob_partition`, `blob_hour`."""
    last = F.col(to_col) - F.expr("INTERVAL 1 MICROSECOND")
    hour = F.explode(
        F.sequence(F.date_trunc("hour", F.col(from_col)), last, F.expr("INTERVAL 1 HOUR"))
    ).alias("_hour")
    return (
        ranges.where(F.col(from_col) < F.col(to_col))
        .select("*", hour)
        .withColumn("blob_partition", partition_of(F.col("_hour")))
        .withColumn("blob_hour", hour_of(F.col("_hour")))
        .drop("_hour")
    )


def hours_frame(spark: SparkSession, from_utc: datetime, to_utc: datetime) -> DataFrame:
    """The hours of one range, spread over the cluster's cores for listing."""
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    hour = timedelta(hours=1)
    first = (as_utc(from_utc) - epoch) // hour
    end = -((epoch - as_utc(to_utc)) // hour)
    count = max(end - first, 0)
    instant = F.timestamp_seconds(F.col("id") * 3600)
    tasks = max(1, min(count, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(first, first + count, 1, tasks).select(
        partition_of(instant).alias("blob_partition")
    )
