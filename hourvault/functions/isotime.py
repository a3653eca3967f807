"""ISO-8601 text to instants, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes, extended or basic. A date of eight digits alone is
# also how a JSON number reads: who parses JSON must look at its type first.
_ISO = (
    r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?"
    r"|\d{8}([T ]\d{2}(\d{2}(\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?)$"
)
BARE_DATE = r"^\d{8}$"
# A date by ISO week, its day (Monday if absent), and what follows.
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?([T ].*)?$"
# The shape almost every producer writes; taken as is.
_COMMON = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
# Rewrites that bring any accepted shape to the common one, in this order.
_REWRITES = (
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"^(.{10})$", "$1T00:00:00"),
    (r"^(.{10}[T ]\d{2})(\d{2})", "$1:$2"),
    (r"^(.{10}[T ]\d{2}:\d{2})(\d{2})", "$1:$2"),
    (r"^(.{10}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2"),
    (r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2"),
    (r"^(.{19})[.,](\d{1,6})\d*", "$1.$2"),
    (r"^(.{19}[.\d]*[+-]\d{2})$", "$1:00"),
    (r"^(.{19}[.\d]*[+-]\d{2})(\d{2})$", "$1:$2"),
    (r"^(.{19}(\.\d+)?)$", "$1Z"),
)
_HAS_OFFSET = r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$"
_BLANKS = " \t\r\n\x0b\x0c"


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(_BLANKS))


def has_offset(value: Column) -> Column:
    return strip(value).rlike(_HAS_OFFSET)


def _week_date(text: Column) -> Column:
    """A week date as a calendar date with the same rest; NULL for a week its year lacks."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _WEEK, i)

    # January 4 is always in the first week.
    first = F.to_date(F.date_trunc("WEEK", F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(4))))
    week = part(2).try_cast("int")
    day = F.date_add(F.date_add(first, (week - 1) * 7), F.coalesce(part(3).try_cast("int"), F.lit(1)) - 1)
    extended = F.substring(text, 5, 1) == "-"
    date = F.when(extended, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyyMMdd"))
    return F.when(F.weekofyear(day) == week, F.concat(date, part(4)))


def iso_to_instant(value: Column) -> Column:
    """Instant of an ISO text; no offset means UTC; NULL when it is not ISO.

    Does not depend on the session time zone: an offset is always present when
    Spark's own parser sees the text.
    """
    text = strip(value)
    text = F.when(text.rlike(_WEEK), _week_date(text)).otherwise(text)
    rewritten = text
    for pattern, replacement in _REWRITES:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    canonical = F.when(text.rlike(_COMMON), text).when(text.rlike(_ISO), rewritten)
    return F.try_to_timestamp(canonical).cast("timestamp")


def local_iso_to_instant(value: Column, zone: Column) -> Column:
    """As above, but a text without offset is wall-clock time in `zone`."""
    return F.to_utc_timestamp(iso_to_instant(value), F.when(has_offset(value), "UTC").otherwise(zone))
