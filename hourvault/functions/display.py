"""Projections for showing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size units, 1024 apart.
_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def shorten(value: Column, length: int = 20) -> Column:
    return (
        F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit("-"))
        .when(F.length(value) <= length, value)
        .otherwise(F.concat(F.substring(value, 1, length - 1), F.lit("…")))
    )


def format_size(size: Column) -> Column:
    value = size.cast("double")

    def text(power: int) -> Column:
        # Ties go to the even digit; the formatter alone would round them up.
        scaled = F.bround(value / F.lit(float(1024**power)), 1)
        return F.concat(F.format_string("%.1f", scaled), F.lit(" " + _UNITS[power]))

    chain = F.when(size.isNull(), F.lit(None).cast("string"))
    for power in range(len(_UNITS) - 1):
        chain = chain.when(value < float(1024 ** (power + 1)), text(power))
    return chain.otherwise(text(len(_UNITS) - 1))


def format_utc(instant: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss`; the session runs in UTC, see `session.configure`."""
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")


def source_label(partition: Column, name: Column) -> Column:
    return F.concat_ws("/", partition, name)


def result_table(results: DataFrame) -> DataFrame:
    """Result columns as shown to a user; where an event lies is not shown."""
    return results.select(
        "event_id",
        shorten_empty(F.col("user_id")).alias("user_id"),
        shorten(F.col("organization_id"), 20).alias("organization_id"),
        shorten(F.col("event_name"), 20).alias("event_name"),
        shorten(F.col("category"), 10).alias("category"),
        format_utc(F.col("timestamp")).alias("timestamp_utc"),
    )


def shorten_empty(value: Column) -> Column:
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit("-")).otherwise(value)
