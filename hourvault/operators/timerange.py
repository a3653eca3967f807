"""Time expressions as columns: many searches resolve in one job.

Input columns: `expr` (shortcut), `from_text`, `to_text`, `tz`, `now`; any may
be NULL except the last two. Arithmetic is on the local wall clock, as a user
reads it; the ends are compared as instants.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.functions.isotime import local_iso_to_instant, strip
from hourvault.functions.once import with_columns_once

# Shortcut grammar, aliases and the names of the refusals.
_LAST = r"^last\s+(\d+)\s+(minutes?|hours?|days?)$"
_ALIASES = {
    "last hour": "last 1 hour",
    "last day": "last 1 day",
    "current date": "today",
}
_YEAR_ONE = 62_135_596_800  # seconds from year 1 to 1970
CONFLICT = "a shortcut cannot be combined with from or to"
TO_WITHOUT_FROM = "to requires from"
UNSUPPORTED = "unknown time shortcut"
ZERO_AMOUNT = "the amount must be at least 1"
BAD_DATETIME = "not an ISO date or time"
NOT_BEFORE = "the range is empty or runs backwards"

SEARCH_SCHEMA = T.StructType(
    [
        T.StructField("expr", T.StringType()),
        T.StructField("from_text", T.StringType()),
        T.StructField("to_text", T.StringType()),
        T.StructField("tz", T.StringType()),
        T.StructField("now", T.TimestampType()),
    ]
)


class InvalidTimeRangeError(ValueError):
    """The time arguments do not describe a range."""


def _set(value: Column) -> Column:
    """Given at all; an empty text counts as not given in the conflict check."""
    return F.coalesce(value, F.lit("")) != ""


def resolve_ranges(searches: DataFrame) -> DataFrame:
    """Add `from_utc`, `to_utc` and `error` (NULL when the range is valid)."""
    expr, tz = F.col("expr"), F.col("tz")
    now = F.col("now").cast("timestamp")
    text = F.lower(strip(expr))
    canonical = F.create_map(*[F.lit(t) for pair in _ALIASES.items() for t in pair])
    staged = with_columns_once(
        searches, {"_expr": F.coalesce(canonical[text], text), "_wall": F.from_utc_timestamp(now, tz)}
    )

    shortcut, wall = F.col("_expr"), F.col("_wall")
    is_last = shortcut.rlike(_LAST)
    digits = F.regexp_extract(shortcut, _LAST, 1)
    amount = digits.try_cast("bigint")
    unit = F.regexp_extract(shortcut, _LAST, 2)

    def back(name: str, seconds: int, **interval: Column) -> Column:
        # Nothing before year 1 is reachable; without this the subtraction overflows.
        reach = (F.unix_seconds(wall) + _YEAR_ONE) / seconds
        return F.when(unit.startswith(name) & (amount <= reach), wall - F.make_interval(**interval))

    small = amount.try_cast("int")
    shifted = F.coalesce(
        back("minute", 60, mins=small), back("hour", 3600, hours=small), back("day", 86400, days=small)
    )
    midnight = F.date_trunc("DAY", wall)
    # The part of the hour gone by is taken from the instant itself, so a
    # repeated local hour keeps its own start.
    into_hour = F.unix_micros(wall) - F.unix_micros(F.date_trunc("HOUR", wall))
    shortcut_from = (
        F.when(shortcut == "today", F.to_utc_timestamp(midnight, tz))
        .when(shortcut == "yesterday", F.to_utc_timestamp(midnight - F.expr("INTERVAL 1 DAY"), tz))
        .when(shortcut == "current hour", F.timestamp_micros(F.unix_micros(now) - into_hour))
        .when(is_last, F.to_utc_timestamp(shifted, tz))
    )
    shortcut_to = F.when(shortcut == "yesterday", F.to_utc_timestamp(midnight, tz)).otherwise(now)

    given_from, given_to = F.col("from_text"), F.col("to_text")
    hour_ago = F.to_utc_timestamp(wall - F.expr("INTERVAL 1 HOUR"), tz)
    neither = given_from.isNull() & given_to.isNull()
    explicit_from = F.when(neither, hour_ago).otherwise(local_iso_to_instant(given_from, tz))
    explicit_to = F.when(given_to.isNull(), now).otherwise(local_iso_to_instant(given_to, tz))

    by_shortcut = _set(expr)
    ranged = with_columns_once(
        staged,
        {
            "from_utc": F.when(by_shortcut, shortcut_from).otherwise(explicit_from),
            "to_utc": F.when(by_shortcut, shortcut_to).otherwise(explicit_to),
        },
    )
    known = shortcut.isin("today", "yesterday", "current hour") | is_last
    zero = is_last & digits.rlike("^0+$")
    # An amount outside the supported years has no start time.
    out_of_reach = is_last & ~zero & F.col("from_utc").isNull()
    error = (
        F.when(by_shortcut & (_set(given_from) | _set(given_to)), CONFLICT)
        .when(by_shortcut & ~known, UNSUPPORTED)
        .when(by_shortcut & zero, ZERO_AMOUNT)
        .when(by_shortcut & out_of_reach, UNSUPPORTED)
        .when(~by_shortcut & given_from.isNull() & given_to.isNotNull(), TO_WITHOUT_FROM)
        .when(~by_shortcut & (F.col("from_utc").isNull() | F.col("to_utc").isNull()), BAD_DATETIME)
        .when(F.col("from_utc") >= F.col("to_utc"), NOT_BEFORE)
    )
    return (
        ranged.withColumn("error", error)
        .withColumn("from_utc", F.when(F.col("error").isNull(), F.col("from_utc")))
        .withColumn("to_utc", F.when(F.col("error").isNull(), F.col("to_utc")))
        .drop("_expr", "_wall")
    )


def resolve_range(
    spark: SparkSession,
    now: datetime,
    *,
    expr: str | None = None,
    from_text: str | None = None,
    to_text: str | None = None,
    tz: str = "UTC",
) -> tuple[datetime, datetime]:
    """One search's range as UTC datetimes; raises what makes it invalid."""
    row = (
        resolve_ranges(spark.createDataFrame([(expr, from_text, to_text, tz, now)], SEARCH_SCHEMA))
        .select(
            F.unix_micros("from_utc").alias("from_us"), F.unix_micros("to_utc").alias("to_us"), "error"
        )
        .head()
    )
    if row["error"] is not None:
        raise InvalidTimeRangeError(row["error"])
    return from_micros(row["from_us"]), from_micros(row["to_us"])


def from_micros(value: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=value)
