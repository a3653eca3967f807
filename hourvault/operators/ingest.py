"""Text to typed events: line split, strict JSON, time normalisation.

All native expressions: each line is judged and projected on its own, so a bad
line never changes how its neighbours are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourvault.functions.isotime import BARE_DATE, iso_to_instant, strip
from hourvault.functions.once import with_columns_once

# A line is parsed as the first element of a two-element array whose second
# element carries this mark. Only a line that is exactly one JSON value leaves
# the mark in second place, so trailing content is refused in a single parse.
_MARK = "\u241ehourvault-end-of-line\u241e"
_TAIL = ',{"\u241eend":"' + _MARK + '"}]'

_PERSON = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("organization_id", T.StringType())])
_LINE_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("event_id", T.StringType()),
            T.StructField("application", T.StringType()),
            T.StructField("timestamp", T.StringType()),
            T.StructField(
                "event",
                T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType())]),
            ),
            T.StructField("event_name", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("actor", _PERSON),
            T.StructField("attributes", _PERSON),
            T.StructField("\u241eend", T.StringType()),
        ]
    )
)
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Reasons a line is refused.
BAD_JSON = "not a JSON object"
BAD_TIME = "invalid timestamp"


def split_lines(chunks: DataFrame) -> DataFrame:
    """Chunks (`first_line`, `content`) to lines (`source_line`, `raw_json`).

    Split on line feeds only; blank lines are counted and dropped; carriage
    returns at the end are trimmed.
    """
    kept = [c for c in chunks.columns if c not in ("first_line", "content")]
    text = F.col("content").cast("string")
    # Splitting decodes the text and would repair invalid UTF-8 unseen. Such a
    # chunk is split byte by byte instead, so only its broken lines are refused.
    as_bytes = F.split(F.decode(F.col("content").cast("binary"), "ISO-8859-1"), "\n")
    exact = F.transform(as_bytes, lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    pieces = chunks.select(
        *kept,
        "first_line",
        F.posexplode(F.when(F.is_valid_utf8(text), F.split(text, "\n")).otherwise(exact)).alias("_pos", "_line"),
    )
    return pieces.where(strip(F.col("_line")) != "").select(
        *kept,
        (F.col("first_line") + F.col("_pos")).alias("source_line"),
        F.rtrim(F.col("_line"), F.lit("\r")).alias("raw_json"),
    )


def _first(nested: Column, plain: Column, empty_as_missing: bool) -> Column:
    if empty_as_missing:
        nested, plain = F.nullif(nested, F.lit("")), F.nullif(plain, F.lit(""))
    return F.coalesce(nested, plain)


def parse_lines(lines: DataFrame, empty_as_missing: bool = False) -> DataFrame:
    """Add the indexed fields and `bad_reason` to lines with `raw_json`.

    `bad_reason` is NULL for events; refused lines keep only their provenance.
    """
    raw = F.col("raw_json")
    parsed = lines.withColumn(
        "_parsed",
        F.when(
            F.is_valid_utf8(raw) & ~raw.contains(_MARK),
            F.from_json(F.concat(F.lit("["), raw, F.lit(_TAIL)), _LINE_SCHEMA, _STRICT),
        ),
    )
    doc = F.col("_parsed")[0]
    is_object = (
        (F.size("_parsed") == 2) & doc.isNotNull() & (F.col("_parsed")[1]["\u241eend"] == _MARK)
    )
    read = parsed.select(*lines.columns, F.when(F.coalesce(is_object, F.lit(False)), doc).alias("_read"))
    # Eight digits may be a date in quotes or a number; only these few lines are looked at again.
    time = F.col("_read.timestamp")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col("raw_json")), "$.timestamp", "variant"))
    is_text = F.when(strip(time).rlike(BARE_DATE), F.coalesce(kind == "STRING", F.lit(False))).otherwise(True)
    timed = with_columns_once(
        read, {"_doc": F.col("_read"), "_instant": F.when(is_text, iso_to_instant(time))}
    ).withColumn(
        "bad_reason",
        F.when(F.col("_doc").isNull(), BAD_JSON).when(
            F.col("_doc.timestamp").isNotNull() & F.col("_instant").isNull(), BAD_TIME
        ),
    )

    def field(value: Column) -> Column:
        return F.when(F.col("bad_reason").isNull(), value)

    def either(nested: str, plain: str) -> Column:
        return field(_first(F.col(f"_doc.{nested}"), F.col(f"_doc.{plain}"), empty_as_missing))

    return timed.select(
        *lines.columns,
        field(F.col("_doc.event_id")).alias("event_id"),
        field(F.col("_doc.application")).alias("application"),
        either("actor.user_id", "attributes.user_id").alias("user_id"),
        either("actor.organization_id", "attributes.organization_id").alias("organization_id"),
        either("event.name", "event_name").alias("event_name"),
        either("event.category", "category").alias("category"),
        F.col("_instant").alias("timestamp"),
        "bad_reason",
    )


def to_events(chunks: DataFrame, empty_as_missing: bool = False) -> DataFrame:
    """Chunks of source text to the stored event columns.

    Expects `blob_path`, `blob_partition`, `file_name` beside the text; other
    columns (run, group, hour) pass through at the end.
    """
    events = parse_lines(split_lines(chunks), empty_as_missing)
    extra = [
        c
        for c in chunks.columns
        if c not in ("blob_path", "blob_partition", "file_name", "first_line", "content")
    ]
    return events.select(
        "event_id",
        "application",
        "user_id",
        "organization_id",
        "event_name",
        "category",
        "timestamp",
        "blob_partition",
        F.col("file_name").alias("blob_name"),
        "source_line",
        F.when(F.col("bad_reason").isNull(), F.col("raw_json"))
        .otherwise(F.make_valid_utf8("raw_json"))
        .alias("raw_json"),
        "blob_path",
        "bad_reason",
        *extra,
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("bad_reason").isNull()).drop("bad_reason")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Refused lines with where they came from and why."""
    return parsed.where(F.col("bad_reason").isNotNull()).select(
        "blob_path", "blob_partition", "source_line", F.col("raw_json").alias("raw"), "bad_reason"
    )


class MalformedLineError(ValueError):
    """A source line is not a valid event."""


def raise_on_malformed(parsed: DataFrame) -> None:
    """Fail naming the first refused line by path and line number."""
    first = (
        parsed.where(F.col("bad_reason").isNotNull())
        .agg(F.min(F.struct("blob_path", "source_line", "bad_reason")).alias("first"))
        .head()["first"]
    )
    if first is not None:
        raise MalformedLineError(
            f"Failed to parse {first['blob_path']} at line {first['source_line']}: {first['bad_reason']}"
        )
