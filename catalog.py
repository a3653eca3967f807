"""Registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import workload as w
from hourvault.functions import display
from hourvault.functions.hours import hours_frame, hours_of_ranges
from hourvault.operators import cached, ingest, lookup
from hourvault.operators.grouping import assign_groups, group_totals
from hourvault.operators.predicates import (
    all_of, any_of, field_is, field_like, field_matches, field_missing, json_is, json_like, json_number, json_present, none_of,
)
from hourvault.operators.search import search, with_locator
from hourvault.operators.timerange import resolve_ranges
from hourvault.plans import results, status, sync
from hourvault.plans.maintenance import compact_hours, merge_runs, reclaim
from hourvault.plans.saved import run_saved_on_cache
from hourvault.session import configure, pin, scratch_path
from hourvault.sources import archive, cache
from hourvault.sources.storage import child_names, join_path, remove
from hourvault.streaming.incremental import sync_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return w.as_ntz(function(configure(spark), sf_dir))

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- shared SQL

# `events` as the event table; `file_line` numbers the events of each file.
EV = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS id,
    'app-' || (event_id % 3) AS application,
    'user-' || user_id AS user_id,
    'org-' || (user_id % 10) AS organization_id,
    upper(event_type) AS event_name,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'account' ELSE 'activity' END AS category,
    ts AS "timestamp",
    strftime(ts, '%Y/%m/%d/%H') AS blob_partition,
    strftime(ts, '%Y-%m-%d-%H') AS blob_hour,
    'events-' || (event_id // 50000) || '-' || ((event_id // 4) % 2) || '.ndjson' AS blob_name,
    props
  FROM events)
"""
FILED = (
    EV
    + """,
stamped AS (
  SELECT *,
    row_number() OVER (PARTITION BY blob_partition, blob_name ORDER BY id) AS file_line,
    'audit/year=' || strftime("timestamp", '%Y') || '/month=' || strftime("timestamp", '%m')
      || '/day=' || strftime("timestamp", '%d') || '/hour=' || strftime("timestamp", '%H')
      || '/' || blob_name AS blob_path,
    CASE (id // 4) % 4
      WHEN 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
      WHEN 1 THEN strftime("timestamp" + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+03:00'
      WHEN 2 THEN strftime("timestamp" + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+0300'
      ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') END AS stamp
  FROM ev),
pieces AS (
  SELECT *,
    '{"event_id":"' || event_id || '","application":"' || application || '","timestamp":"' || stamp || '"' AS head,
    '{"user_id":"' || user_id || '","organization_id":"' || organization_id || '"}' AS people,
    '"name":"' || event_name || '","category":"' || category || '"' AS named,
    '"event_name":"' || event_name || '","category":"' || category || '"' AS plain
  FROM stamped),
filed AS (
  SELECT *,
    CASE id % 4
      WHEN 0 THEN head || ',"event":{' || named || '},"actor":' || people || ',"payload":' || props || '}'
      WHEN 1 THEN '{"event_id":' || event_id || ',"application":"' || application || '","timestamp":"' || stamp
        || '",' || plain || ',"attributes":' || people || ',"payload":' || props || '}'
      WHEN 2 THEN head || ',"event":{' || named || '},"event_name":"other","category":"other","actor":' || people
        || ',"attributes":{"user_id":"other","organization_id":"other"},"payload":' || props || '}'
      ELSE head || ',"event":{"name":null,"category":null},' || plain || ',"actor":null,"attributes":' || people
        || ',"payload":' || props || '}' END AS raw_json
  FROM pieces)
"""
)
SUMMARY = """event_id, user_id, organization_id, event_name, category, "timestamp",
  blob_partition, blob_name, source_line, blob_path, blob_hour"""
# The event table by direct projection, where `source_line` is the event ID.
TABLE = (
    EV
    + """,
et AS (SELECT *, id AS source_line, blob_partition || '/' || blob_name AS blob_path FROM ev)
"""
)
NEWEST = 'ORDER BY "timestamp" DESC, event_id, blob_partition, blob_name, source_line, blob_path'


# The event table as it is synced from the archive.
CACHED = FILED + ", et AS (SELECT *, file_line AS source_line FROM filed)"


def _search_sql(where: str, limit: int = 100) -> str:
    return f"WITH {CACHED} SELECT {SUMMARY} FROM et WHERE {where} {NEWEST} LIMIT {limit}"


def _search(spark: SparkSession, sf_dir: str, *args, **options) -> DataFrame:
    """A search over the synced cache, with the columns of SUMMARY."""
    found = results.search_cache(spark, w.cache(spark, sf_dir), *args, **options)
    return found.drop("parquet_path")


def _range_sql(start: str, end: str) -> str:
    return f"\"timestamp\" >= TIMESTAMP '{start}' AND \"timestamp\" < TIMESTAMP '{end}'"


MONTH = (datetime(2024, 1, 1), datetime(2024, 2, 1))
MONTH_SQL = _range_sql("2024-01-01", "2024-02-01")


def _filtered(name: str, value: str, limit: int = 100) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _search(spark, sf_dir, *MONTH, {name: value}, limit)

    run.__name__ = f"search_{name}"
    query(_search_sql(f"{MONTH_SQL} AND {name} = '{value}'", limit))(run)


# -------------------------------------------------------------------- search


@query(_search_sql(_range_sql("2024-01-10 06:00:00", "2024-01-20 18:30:00")))
def search_time_range(spark, sf_dir):
    return _search(spark, sf_dir, datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18, 30))


_filtered("event_id", "7")
_filtered("application", "app-1")
_filtered("user_id", "user-8", 10_000)
_filtered("organization_id", "org-3", 10_000)
_filtered("event_name", "PURCHASE", 10_000)
_filtered("category", "account", 1_000)


@query(
    _search_sql(
        f"{MONTH_SQL} AND application = 'app-2' AND organization_id = 'org-6' AND category = 'activity'", 10_000
    )
)
def search_combined_and(spark, sf_dir):
    filters = {"application": "app-2", "organization_id": "org-6", "category": "activity", "user_id": None}
    return _search(spark, sf_dir, *MONTH, filters, 10_000)


@query(
    f"""WITH {CACHED}, span AS (SELECT min("timestamp") AS lo, max("timestamp") AS last FROM et),
cut AS (SELECT lo, (SELECT max("timestamp") FROM et WHERE "timestamp" <= lo + (last - lo) / 20) AS hi FROM span)
SELECT {SUMMARY} FROM et, cut WHERE "timestamp" >= lo AND "timestamp" < hi {NEWEST} LIMIT 10000"""
)
def search_boundary_half_open(spark, sf_dir):
    """Both ends are times of events, and all of the range is within the limit: the first is in, the last is not."""
    events = w.table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("last")).head()
    hi = events.where(F.col("ts") <= F.lit(span["lo"] + (span["last"] - span["lo"]) / 20)).agg(F.max("ts")).head()[0]
    return _search(spark, sf_dir, span["lo"], hi, limit=10_000)


_MATCHED = "SELECT '{0}' AS kind, event_id, \"timestamp\" FROM (SELECT * FROM et WHERE {1} " + NEWEST + " LIMIT 100)"


@query(
    f"WITH {CACHED} {_MATCHED.format('empty', MONTH_SQL + chr(32) + 'AND application = ' + repr(''))} UNION ALL "
    + _MATCHED.format("set", MONTH_SQL + " AND application = 'app-1'")
)
def search_empty_string_filter(spark, sf_dir):
    """The empty text is a value that no event has; beside it, the same search with a value that some have."""
    kinds = [
        _search(spark, sf_dir, *MONTH, {"application": value}).select(F.lit(kind).alias("kind"), "event_id", "timestamp")
        for kind, value in (("empty", ""), ("set", "app-1"))
    ]
    return kinds[0].unionByName(kinds[1])


@query(
    f"WITH {CACHED} {_MATCHED.format('later', _range_sql('2031-05-01', '2031-05-02'))} UNION ALL "
    + _MATCHED.format("within", _range_sql("2024-01-05", "2024-01-06"))
)
def search_empty_range(spark, sf_dir):
    """A day after all events, and one with events."""
    days = (("later", datetime(2031, 5, 1), datetime(2031, 5, 2)), ("within", datetime(2024, 1, 5), datetime(2024, 1, 6)))
    found = [_search(spark, sf_dir, a, b).select(F.lit(kind).alias("kind"), "event_id", "timestamp") for kind, a, b in days]
    return found[0].unionByName(found[1])


@query(
    f"""WITH {CACHED}, found AS (SELECT * FROM et WHERE {MONTH_SQL} {NEWEST} LIMIT 500)
SELECT event_id, "timestamp", source_line AS at_line, blob_partition AS at_partition,
  blob_name AS at_name, blob_path AS at_path FROM found"""
)
def search_with_locator(spark, sf_dir):
    found = with_locator(_search(spark, sf_dir, *MONTH, limit=500))
    return found.select(
        "event_id",
        "timestamp",
        F.col("locator.source_line").alias("at_line"),
        F.col("locator.blob_partition").alias("at_partition"),
        F.col("locator.blob_name").alias("at_name"),
        F.col("locator.blob_path").alias("at_path"),
    )


@query(
    f"""WITH {TABLE}, late AS (SELECT *, strftime("timestamp" + INTERVAL 90 MINUTE, '%Y-%m-%d-%H') AS file_hour FROM et)
SELECT event_id, "timestamp", file_hour FROM late
WHERE {_range_sql("2024-01-10", "2024-01-12")} AND file_hour BETWEEN '2024-01-10-00' AND '2024-01-12-01'
ORDER BY "timestamp" DESC, event_id LIMIT 10000"""
)
def search_late_files(spark, sf_dir):
    """Events filed 90 minutes late, found by looking two hours further."""
    late = w.event_table(spark, sf_dir).withColumn(
        "blob_hour", F.date_format(F.col("timestamp") + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd-HH")
    )
    found = search(late, datetime(2024, 1, 10), datetime(2024, 1, 12), limit=10_000, lateness_hours=2)
    return found.select("event_id", "timestamp", F.col("blob_hour").alias("file_hour"))


def _where(name: str, condition: str, predicate, limit: int = 10_000) -> None:
    """A search of the whole month for a condition beyond equality; `predicate` makes it when the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _search(spark, sf_dir, *MONTH, limit=limit, where=predicate())

    run.__name__ = name
    query(_search_sql(f"{MONTH_SQL} AND ({condition})", limit))(run)


_K = "CAST(json_extract_string(raw_json, '$.payload.k') AS DOUBLE)"
_where(
    "search_like",
    "user_id LIKE 'user-1_' OR (event_name LIKE '%CH%SE' AND user_id LIKE 'user-2%') OR organization_id ILIKE 'ORG-_' AND user_id LIKE '%77'",
    lambda: any_of(
        field_like("user_id", "user-1_"),
        all_of(field_like("event_name", "%CH%SE"), field_like("user_id", "user-2%")),
        all_of(field_like("organization_id", "ORG-_", ignore_case=True), field_like("user_id", "%77")),
    ),
)
_where(
    "search_regex",
    "regexp_matches(user_id, '^user-[13]\\d?$') AND regexp_matches(event_name, '(?i)^(pur|sign)')",
    lambda: all_of(field_matches("user_id", r"^user-[13]\d?$"), field_matches("event_name", "(?i)^(pur|sign)")),
)
_where(
    "search_any_of",
    "user_id IN ('user-3', 'user-5', 'user-9') OR (category = 'account' AND application = 'app-2') OR event_id = '7'",
    lambda: any_of(
        field_is("user_id", "user-3", "user-5", "user-9"),
        all_of(field_is("category", "account"), field_is("application", "app-2")),
        field_is("event_id", "7"),
    ),
)
_where(
    "search_none_of",
    "NOT (category = 'activity' OR application IN ('app-0', 'app-1') OR user_id IS NULL)",
    lambda: none_of(field_is("category", "activity"), field_is("application", "app-0", "app-1"), field_missing("user_id")),
)
_where(
    "search_json_path",
    f"{_K} > 40 AND {_K} <= 60 AND json_extract_string(raw_json, '$.actor.user_id') LIKE 'user-%'",
    lambda: all_of(
        json_number("$.payload.k", ">", 40), json_number("$.payload.k", "<=", 60), json_like("$.actor.user_id", "user-%")
    ),
)
_where(
    "search_mixed",
    f"""user_id LIKE 'user-1%' AND (category = 'account' OR {_K} < 10) AND NOT (event_name = 'SIGNUP')
  AND (json_extract_string(raw_json, '$.application') IN ('app-1', 'app-2') OR json_extract_string(raw_json, '$.attributes.user_id') IS NOT NULL)""",
    lambda: all_of(
        field_like("user_id", "user-1%"),
        any_of(field_is("category", "account"), json_number("$.payload.k", "<", 10)),
        none_of(field_is("event_name", "SIGNUP")),
        any_of(json_is("$.application", "app-1", "app-2"), json_present("$.attributes.user_id")),
    ),
)


@query(
    f"""WITH {CACHED}, sought AS (SELECT CAST(id AS VARCHAR) AS wanted FROM ev, (SELECT max(id) AS last FROM ev)
  WHERE id IN (last, last // 2, last // 3)) SELECT {SUMMARY} FROM et WHERE event_id IN (SELECT wanted FROM sought)"""
)
def search_id_all_hours(spark, sf_dir):
    """Three single events, each sought by its ID in all hours of the cache."""
    last = w.table(spark, sf_dir, "events").agg(F.max("event_id")).head()[0]
    found = [_search(spark, sf_dir, *MONTH, {"event_id": str(i)}) for i in (last, last // 2, last // 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


# -------------------------------------------------------------------- ingest

_INDEXED = """event_id, application, user_id, organization_id, event_name, category,
  "timestamp", blob_partition, blob_name, file_line AS source_line"""


@query(f"WITH {FILED} SELECT {_INDEXED}, blob_path FROM filed")
def ingest_indexed_fields(spark, sf_dir):
    return ingest.good_events(ingest.to_events(w.chunks(spark, sf_dir))).drop("raw_json")


@query(f"WITH {FILED} SELECT event_id, user_id, organization_id, event_name, category FROM filed")
def ingest_field_fallback(spark, sf_dir):
    """Top-level fields and attributes are emptied, not absent, where nested ones exist."""
    blanked = w.encoded(spark, sf_dir).withColumn("line", F.replace("line", F.lit('"other"'), F.lit('""')))
    events = ingest.to_events(w.files_of(blanked), empty_as_missing=True)
    return events.select("event_id", "user_id", "organization_id", "event_name", "category")


@query(f"WITH {FILED} SELECT event_id, stamp, \"timestamp\" FROM filed")
def ingest_timestamp_variants(spark, sf_dir):
    events = ingest.to_events(w.chunks(spark, sf_dir))
    return events.select(
        "event_id", F.get_json_object("raw_json", "$.timestamp").alias("stamp"), "timestamp"
    )


@query(
    f"""WITH {FILED}
SELECT event_id, CAST(file_line + sum(CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END) OVER (
    PARTITION BY blob_partition, blob_name ORDER BY id) AS BIGINT) AS source_line, raw_json FROM filed"""
)
def ingest_blank_lines(spark, sf_dir):
    """Two blank lines before every fifth event, carriage returns after every third."""
    lines = w.encoded(spark, sf_dir)
    spaced = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n \t\n"), "line")).otherwise(F.col("line"))
    ended = F.when(F.col("event_id") % 3 == 0, F.concat(spaced, F.lit("\r"))).otherwise(spaced)
    events = ingest.to_events(w.files_of(lines.withColumn("line", ended)))
    return events.select("event_id", "source_line", "raw_json")


_BROKEN = """CASE id % 10 WHEN 0 THEN 'not a JSON object' WHEN 3 THEN 'invalid timestamp'
  WHEN 6 THEN 'not a JSON object' END"""


@query(
    f"""WITH {FILED}
SELECT blob_path, blob_partition, file_line AS source_line, {_BROKEN} AS bad_reason FROM filed
WHERE {_BROKEN} IS NOT NULL"""
)
def ingest_quarantine(spark, sf_dir):
    return ingest.quarantine(ingest.to_events(w.files_of(_with_broken_lines(spark, sf_dir)))).drop("raw")


@query(
    f"""WITH {FILED}
SELECT {_INDEXED} FROM filed WHERE {_BROKEN} IS NULL"""
)
def ingest_beside_malformed(spark, sf_dir):
    """Good lines read the same next to malformed ones."""
    parsed = ingest.to_events(w.files_of(_with_broken_lines(spark, sf_dir)))
    return ingest.good_events(parsed).drop("raw_json", "blob_path")


def _with_broken_lines(spark, sf_dir):
    kind = F.col("event_id") % 10
    broken = (
        F.when(kind == 0, F.concat("line", "line"))
        .when(kind == 3, F.regexp_replace("line", '"timestamp":"[^"]*"', '"timestamp":"invalid"'))
        .when(kind == 6, F.concat(F.lit("["), "line", F.lit("]")))
        .otherwise(F.col("line"))
    )
    return w.encoded(spark, sf_dir).withColumn("line", broken)


@query(f"WITH {FILED} SELECT event_id, blob_partition, blob_name, raw_json FROM filed")
def raw_json_roundtrip(spark, sf_dir):
    return ingest.to_events(w.chunks(spark, sf_dir)).select("event_id", "blob_partition", "blob_name", "raw_json")


@query(
    """SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS event_id, CAST(conv_id AS VARCHAR) AS user_id,
  role AS event_name, text AS category, TIMESTAMP '2024-01-01' + to_seconds(60 * conv_id + turn) AS "timestamp"
FROM conversations"""
)
def ingest_conversations(spark, sf_dir):
    """Free text with quotes, accents and line breaks through JSON and back."""
    turns = w.table(spark, sf_dir, "conversations")
    stamp = F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("conv_id") + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    doc = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        stamp.alias("timestamp"),
        F.struct(F.col("role").alias("name")).alias("event"),
        F.col("text").alias("category"),
        F.struct("conv_id").withField("user_id", F.col("conv_id")).alias("attributes"),
    )
    lines = turns.select(F.to_json(doc).alias("raw_json"))
    return ingest.parse_lines(lines).select("event_id", "user_id", "event_name", "category", "timestamp")


# ------------------------------------------------------------------ time ranges


def _clock(spark, sf_dir):
    """One search per order, its clock somewhere on the order's day."""
    return w.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("search_id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") * 7919 % 86400)).alias("now"),
    )


_CLOCK = """clock AS (SELECT o_orderkey AS search_id,
  o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS now FROM orders)"""
_SHORTCUTS = (
    "last 15 minutes", "last 1 minute", "Last Hour", " last 6 hours ", "last day", "last 45 days",
    "today", "current date", "yesterday", "current hour", "last 0 hours", "last minute", "last fortnight",
)
# Zones without clock changes in the years of the test data, where SQL engines agree.
_ZONES = ("UTC", "Asia/Kolkata", "Asia/Kathmandu", "Africa/Lagos")


def _pick(values: tuple[str, ...], index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query(
    f"""WITH {_CLOCK},
s AS (SELECT *, ({_sql_list(_SHORTCUTS)})[search_id % {len(_SHORTCUTS)} + 1] AS expr,
  ({_sql_list(_ZONES)})[(search_id // 16) % {len(_ZONES)} + 1] AS tz FROM clock),
l AS (SELECT *, timezone(tz, timezone('UTC', now)) AS wall, lower(trim(expr)) AS e FROM s),
r AS (SELECT *,
  CASE e WHEN 'last 15 minutes' THEN now - INTERVAL 15 MINUTE WHEN 'last 1 minute' THEN now - INTERVAL 1 MINUTE
    WHEN 'last hour' THEN now - INTERVAL 1 HOUR WHEN 'last 6 hours' THEN now - INTERVAL 6 HOUR
    WHEN 'last day' THEN now - INTERVAL 1 DAY WHEN 'last 45 days' THEN now - INTERVAL 45 DAY
    WHEN 'today' THEN now - (wall - date_trunc('day', wall))
    WHEN 'current date' THEN now - (wall - date_trunc('day', wall))
    WHEN 'yesterday' THEN now - (wall - date_trunc('day', wall)) - INTERVAL 1 DAY
    WHEN 'current hour' THEN now - (wall - date_trunc('hour', wall)) END AS a,
  CASE e WHEN 'yesterday' THEN now - (wall - date_trunc('day', wall)) ELSE now END AS b,
  CASE WHEN e IN ('last minute', 'last fortnight') THEN 'unknown time shortcut'
    WHEN e = 'last 0 hours' THEN 'the amount must be at least 1' END AS refused FROM l),
c AS (SELECT *, CASE WHEN refused IS NULL AND a >= b THEN 'the range is empty or runs backwards' ELSE refused END AS error FROM r)
SELECT search_id, CASE WHEN error IS NULL THEN a END AS from_utc, CASE WHEN error IS NULL THEN b END AS to_utc, error FROM c"""
)
def resolve_shortcuts(spark, sf_dir):
    searches = _clock(spark, sf_dir).select(
        "search_id",
        "now",
        _pick(_SHORTCUTS, F.col("search_id")).alias("expr"),
        F.lit(None).cast("string").alias("from_text"),
        F.lit(None).cast("string").alias("to_text"),
        _pick(_ZONES, F.floor(F.col("search_id") / 16)).alias("tz"),
    )
    return resolve_ranges(searches).select("search_id", "from_utc", "to_utc", "error")


@query(
    f"""WITH {_CLOCK},
s AS (SELECT *, now - INTERVAL 5 DAY AS f, now - to_hours(CAST(search_id % 7 AS BIGINT)) AS t, search_id % 9 AS k,
  ({_sql_list(_ZONES)})[(search_id // 9) % {len(_ZONES)} + 1] AS tz FROM clock),
r AS (SELECT *,
  CASE WHEN k = 0 THEN timezone('UTC', timezone(tz, f)) WHEN k = 1 THEN f WHEN k = 2 THEN f
    WHEN k = 3 THEN timezone('UTC', timezone(tz, date_trunc('day', f)))
    WHEN k = 4 THEN timezone('UTC', timezone(tz, f)) WHEN k = 5 THEN now - INTERVAL 1 HOUR
    WHEN k = 7 THEN timezone('UTC', timezone(tz, now)) + INTERVAL 3 DAY END AS a,
  CASE WHEN k = 0 THEN timezone('UTC', timezone(tz, t)) WHEN k = 1 THEN t WHEN k = 2 THEN t
    WHEN k = 3 THEN t WHEN k IN (4, 5) THEN now WHEN k = 7 THEN now END AS b,
  CASE k WHEN 6 THEN 'to requires from' WHEN 7 THEN 'the range is empty or runs backwards'
    WHEN 8 THEN 'not an ISO date or time' END AS error FROM s)
SELECT search_id, CASE WHEN error IS NULL THEN a END AS from_utc, CASE WHEN error IS NULL THEN b END AS to_utc, error FROM r"""
)
def resolve_explicit(spark, sf_dir):
    key = F.col("search_id")
    searches = _clock(spark, sf_dir).select(
        "search_id", "now", _pick(_ZONES, F.floor(key / 9)).alias("tz"), (key % 9).alias("k"),
        (F.col("now") - F.expr("INTERVAL 5 DAYS")).alias("f"),
        (F.col("now") - F.make_dt_interval(hours=(key % 7).cast("int"))).alias("t"),
    )

    def text(value, suffix=""):
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(suffix))

    kind, three = F.col("k"), F.expr("INTERVAL 3 HOURS")
    from_text = (
        F.when(kind == 0, text("f")).when(kind == 1, text("f", "Z")).when(kind == 2, text(F.col("f") + three, "+03:00"))
        .when(kind == 3, F.date_format("f", "yyyy-MM-dd")).when(kind == 4, F.concat(F.lit(" "), text("f")))
        .when(kind == 7, text(F.col("now") + F.expr("INTERVAL 3 DAYS"))).when(kind == 8, "not-a-datetime")
    )
    to_text = (
        F.when(kind == 0, text("t")).when(kind == 1, text("t", "Z")).when(kind == 2, text(F.col("t") + three, "+0300"))
        .when(kind == 3, text("t", "Z")).when(kind == 6, text("t")).when(kind == 7, text("now", "Z"))
    )
    asked = searches.select(
        "search_id", "now", "tz", F.lit(None).cast("string").alias("expr"),
        from_text.alias("from_text"), to_text.alias("to_text"),
    )
    return resolve_ranges(asked).select("search_id", "from_utc", "to_utc", "error")


_DST_ZONES = ("Europe/Athens", "America/New_York")


@query(
    f"""WITH
-- Offsets of two zones in 2024, written by hand: zone, from, to (UTC), hours.
off(zone, a, b, h) AS (VALUES
  ('Europe/Athens', TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-31 01:00:00', 2),
  ('Europe/Athens', TIMESTAMP '2024-03-31 01:00:00', TIMESTAMP '2024-10-27 01:00:00', 3),
  ('Europe/Athens', TIMESTAMP '2024-10-27 01:00:00', TIMESTAMP '2025-02-01', 2),
  ('America/New_York', TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-10 07:00:00', -5),
  ('America/New_York', TIMESTAMP '2024-03-10 07:00:00', TIMESTAMP '2024-11-03 06:00:00', -4),
  ('America/New_York', TIMESTAMP '2024-11-03 06:00:00', TIMESTAMP '2025-02-01', -5)),
s AS (SELECT event_id AS search_id, ts + to_days(CAST(event_id % 330 AS INTEGER)) AS now,
  ({_sql_list(_DST_ZONES)})[event_id % 2 + 1] AS zone, event_id // 2 % 2 = 0 AS yesterday FROM events),
l AS (SELECT s.*, date_trunc('day', now + to_hours(h)) AS midnight FROM s JOIN off ON off.zone = s.zone AND now >= a AND now < b),
w AS (SELECT *, CASE WHEN yesterday THEN midnight - INTERVAL 1 DAY ELSE midnight END AS start FROM l)
SELECT search_id, start - to_hours(f.h) AS from_utc, CASE WHEN yesterday THEN midnight - to_hours(t.h) ELSE now END AS to_utc
FROM w JOIN off f ON f.zone = w.zone AND start - to_hours(f.h) >= f.a AND start - to_hours(f.h) < f.b
JOIN off t ON t.zone = w.zone AND midnight - to_hours(t.h) >= t.a AND midnight - to_hours(t.h) < t.b"""
)
def resolve_dst(spark, sf_dir):
    """`today` and `yesterday` over a year, in zones that change their clocks."""
    key = F.col("event_id")
    searches = w.table(spark, sf_dir, "events").select(
        key.alias("search_id"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(days=(key % 330).cast("int"))).alias("now"),
        F.when(F.floor(key / 2) % 2 == 0, "yesterday").otherwise("today").alias("expr"),
        F.lit(None).cast("string").alias("from_text"),
        F.lit(None).cast("string").alias("to_text"),
        _pick(_DST_ZONES, key).alias("tz"),
    )
    return resolve_ranges(searches).select("search_id", "from_utc", "to_utc")


@query(
    f"""WITH {_CLOCK},
r AS (SELECT search_id, now - to_minutes(CAST(search_id % 3000 AS BIGINT)) AS a, now AS b FROM clock),
h AS (SELECT search_id, unnest(generate_series(date_trunc('hour', a), b - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS h
  FROM r WHERE a < b)
SELECT search_id, strftime(h, '%Y/%m/%d/%H') AS blob_partition, strftime(h, '%Y-%m-%d-%H') AS blob_hour FROM h"""
)
def hours_of_searches(spark, sf_dir):
    ranges = _clock(spark, sf_dir).select(
        "search_id",
        (F.col("now") - F.make_dt_interval(mins=(F.col("search_id") % 3000).cast("int"))).alias("from_utc"),
        F.col("now").alias("to_utc"),
    )
    return hours_of_ranges(ranges).select("search_id", "blob_partition", "blob_hour")


def _customer_clock() -> Column:
    key = F.col("c_custkey")
    return F.lit("2024-01-02 12:34:56").cast("timestamp") + F.make_dt_interval(
        days=(key % 28).cast("int"), hours=(key % 24).cast("int")
    )


_SAVED = ("last 6 hours", "last 90 minutes", "yesterday", "today", "last 2 days", "current hour")


@query(
    f"""WITH {CACHED},
q AS (SELECT c_custkey AS search_id, ({_sql_list(_SAVED)})[c_custkey % 6 + 1] AS e,
  TIMESTAMP '2024-01-02 12:34:56' + to_days(CAST(c_custkey % 28 AS INTEGER)) + to_hours(CAST(c_custkey % 24 AS BIGINT)) AS now,
  CASE WHEN c_custkey % 3 = 0 THEN 'user-' || (c_nationkey * 6 + c_custkey % 6) END AS q_user,
  CASE WHEN c_custkey % 3 = 1 THEN upper(({_sql_list(("click", "view", "purchase", "signup", "error"))})[c_nationkey % 5 + 1]) END AS q_name
  FROM customer),
r AS (SELECT *, CASE e WHEN 'last 6 hours' THEN now - INTERVAL 6 HOUR WHEN 'last 90 minutes' THEN now - INTERVAL 90 MINUTE
    WHEN 'yesterday' THEN date_trunc('day', now) - INTERVAL 1 DAY WHEN 'today' THEN date_trunc('day', now)
    WHEN 'last 2 days' THEN now - INTERVAL 2 DAY ELSE date_trunc('hour', now) END AS a,
  CASE e WHEN 'yesterday' THEN date_trunc('day', now) ELSE now END AS b FROM q),
m AS (SELECT search_id, event_id, "timestamp", row_number() OVER (PARTITION BY search_id
    ORDER BY "timestamp" DESC, event_id, blob_partition, blob_name, source_line, blob_path) AS rank
  FROM r JOIN et ON "timestamp" >= a AND "timestamp" < b AND (q_user IS NULL OR user_id = q_user)
    AND (q_name IS NULL OR event_name = q_name))
SELECT search_id, event_id, "timestamp", rank FROM m WHERE rank <= 5"""
)
def saved_searches(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    searches = w.table(spark, sf_dir, "customer").select(
        key.alias("search_id"),
        _pick(_SAVED, key).alias("expr"),
        F.lit(None).cast("string").alias("from_text"),
        F.lit(None).cast("string").alias("to_text"),
        F.lit("UTC").alias("tz"),
        _customer_clock().alias("now"),
        F.when(key % 3 == 0, F.concat(F.lit("user-"), (nation * 6 + key % 6).cast("string"))).alias("user_id"),
        F.when(key % 3 == 1, F.upper(_pick(("click", "view", "purchase", "signup", "error"), nation))).alias("event_name"),
    )
    return _saved(spark, sf_dir, searches)


def _saved(spark, sf_dir, searches):
    found = run_saved_on_cache(spark, w.cache(spark, sf_dir), resolve_ranges(searches), limit=5)
    return found.select("search_id", "event_id", "timestamp", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {CACHED},
q AS (SELECT c_custkey AS search_id,
  TIMESTAMP '2024-01-02 12:34:56' + to_days(CAST(c_custkey % 28 AS INTEGER)) + to_hours(CAST(c_custkey % 24 AS BIGINT)) AS now
  FROM customer),
r AS (SELECT search_id, now - to_minutes(CAST(search_id % 500 + 1 AS BIGINT)) AS a, now AS b FROM q),
m AS (SELECT search_id, event_id, "timestamp", row_number() OVER (PARTITION BY search_id
    ORDER BY "timestamp" DESC, event_id, blob_partition, blob_name, source_line, blob_path) AS rank
  FROM r JOIN et ON "timestamp" >= a AND "timestamp" < b)
SELECT search_id, event_id, "timestamp", rank FROM m WHERE rank <= 5"""
)
def saved_unfiltered(spark, sf_dir):
    """Searches without any filter: all ask for all events of their hours."""
    key = F.col("c_custkey")
    searches = w.table(spark, sf_dir, "customer").select(
        key.alias("search_id"),
        F.concat(F.lit("last "), (key % 500 + 1).cast("string"), F.lit(" minutes")).alias("expr"),
        F.lit(None).cast("string").alias("from_text"),
        F.lit(None).cast("string").alias("to_text"),
        F.lit("UTC").alias("tz"),
        _customer_clock().alias("now"),
    )
    return _saved(spark, sf_dir, searches)


# -------------------------------------------------------- grouping and manifest

_GREEDY = """
WITH RECURSIVE f AS (SELECT source, doc_id, n_chars,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
g(source, doc_id, n, n_chars, used, group_no) AS (
  SELECT source, doc_id, n, n_chars, n_chars, CAST(0 AS BIGINT) FROM f WHERE n = 1
  UNION ALL
  SELECT f.source, f.doc_id, f.n, f.n_chars,
    CASE WHEN g.used + f.n_chars > 20000 THEN f.n_chars ELSE g.used + f.n_chars END,
    CASE WHEN g.used + f.n_chars > 20000 THEN g.group_no + 1 ELSE g.group_no END
  FROM g JOIN f ON f.source = g.source AND f.n = g.n + 1)
"""


def _grouped(spark, sf_dir):
    files = w.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    # Blocks far shorter than a source, so that groups cross them.
    return assign_groups(files, 20_000, key="source", order="doc_id", size="n_chars", block_rows=7)


@query(_GREEDY + "SELECT source, doc_id, n_chars, group_no FROM g")
def compaction_groups(spark, sf_dir):
    return _grouped(spark, sf_dir)


@query(
    _GREEDY
    + """SELECT source, group_no, count(*) AS files_count, CAST(sum(n_chars) AS BIGINT) AS input_bytes
FROM g GROUP BY source, group_no"""
)
def compaction_group_totals(spark, sf_dir):
    return group_totals(_grouped(spark, sf_dir), key="source", size="n_chars")


# `lineitem` as a manifest log: many runs wrote the file of each order.
_LOG = """log AS (SELECT 'file-' || l_orderkey AS blob_path, 'file-' || l_orderkey || '.ndjson' AS file_name,
  strftime(o_orderdate, '%Y/%m/%d/%H') AS blob_partition,
  'run-' || l_suppkey || '-' || l_linenumber AS run_id, CAST(l_partkey % 50 AS BIGINT) AS group_no,
  CAST(l_extendedprice AS BIGINT) AS size, CAST(l_quantity AS BIGINT) AS events_count,
  CAST(l_quantity AS BIGINT) - 1 AS searchable_count, l_shipdate AS first_event, l_shipdate AS last_event,
  CAST(0 AS BIGINT) AS refused_count, CAST(1 + (l_partkey % 50) % 7 // 6 AS BIGINT) AS group_files,
  CAST((l_partkey % 50) * 1000 + 1 AS BIGINT) AS group_bytes, l_shipdate AS materialized_at, strftime(o_orderdate, '%Y-%m-%d-%H') AS blob_hour,
  strftime(o_orderdate, '%Y-%m-%d') AS blob_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_path ORDER BY materialized_at DESC, run_id DESC,
  file_name DESC, blob_partition DESC, group_no DESC, size DESC, events_count DESC, blob_hour DESC) AS n FROM log) WHERE n = 1),
-- A group without its data is missing, and so is one that has lost one of two files.
data AS (SELECT DISTINCT blob_hour, run_id, group_no FROM log WHERE group_no % 5 <> 0 AND group_files = 1),
have AS (SELECT cur.* FROM cur WHERE EXISTS (SELECT 1 FROM data WHERE data.blob_hour = cur.blob_hour
  AND data.run_id = cur.run_id AND data.group_no = cur.group_no) OR events_count = 0),
listing AS (SELECT 'file-' || o_orderkey AS blob_path, strftime(o_orderdate, '%Y/%m/%d/%H') AS blob_partition FROM orders),
gone AS (SELECT * FROM listing WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.blob_path = listing.blob_path))"""


def _log(spark, sf_dir):
    lines, orders = w.table(spark, sf_dir, "lineitem"), w.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("file-"), F.col("l_orderkey").cast("string"))
    day = F.col("o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        path.alias("blob_path"),
        F.concat(path, F.lit(".ndjson")).alias("file_name"),
        F.date_format(day, "yyyy/MM/dd/HH").alias("blob_partition"),
        F.concat_ws("-", F.lit("run"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"),
        (F.col("l_partkey") % 50).alias("group_no"),
        F.rint("l_extendedprice").cast("bigint").alias("size"),
        F.rint("l_quantity").cast("bigint").alias("events_count"),
        (F.rint("l_quantity").cast("bigint") - 1).alias("searchable_count"),
        F.col("l_shipdate").cast("timestamp").alias("first_event"),
        F.col("l_shipdate").cast("timestamp").alias("last_event"),
        F.lit(0).cast("bigint").alias("refused_count"),
        F.expr("1 + (l_partkey % 50) % 7 div 6").cast("bigint").alias("group_files"),
        (F.col("l_partkey") % 50 * 1000 + 1).alias("group_bytes"),
        F.col("l_shipdate").cast("timestamp").alias("materialized_at"),
        F.date_format(day, "yyyy-MM-dd-HH").alias("blob_hour"),
        F.date_format(day, "yyyy-MM-dd").alias("blob_day"),
    )


def _stored(log: DataFrame) -> DataFrame:
    """One stored file of each group whose data survives, with its size."""
    return (
        log.where(F.col("group_no") % 5 != 0)
        .select("blob_hour", "run_id", "group_no", (F.col("group_no") * 1000 + 1).alias("size"))
        .distinct()
    )


def _listing(spark, sf_dir):
    return w.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("file-"), F.col("o_orderkey").cast("string")).alias("blob_path"),
        F.date_format("o_orderdate", "yyyy/MM/dd/HH").alias("blob_partition"),
    )


def _present(spark, sf_dir):
    log = _log(spark, sf_dir)
    return cached.present_files(cache.manifest_current(log), _stored(log))


def _counts(spark, sf_dir):
    return cached.sync_counts(cached.mark_missing(_listing(spark, sf_dir), _present(spark, sf_dir)))


@query(
    f"""WITH {_LOG} SELECT blob_path, file_name, blob_partition, run_id, group_no, size, events_count,
  searchable_count, first_event, last_event, refused_count, group_files, group_bytes, materialized_at, blob_hour, blob_day FROM cur"""
)
def manifest_current(spark, sf_dir):
    return cache.manifest_current(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT run_id, log.blob_path FROM log JOIN cur USING (blob_path) WHERE log.run_id <> cur.run_id".replace("SELECT run_id", "SELECT log.run_id"))
def superseded_copies(spark, sf_dir):
    return cache.superseded(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT blob_path, blob_partition FROM gone")
def missing_files(spark, sf_dir):
    return cached.missing_files(_listing(spark, sf_dir), _present(spark, sf_dir))


_COUNTS = """counts AS (SELECT blob_partition, count(*) AS discovered,
  count(*) FILTER (blob_path IN (SELECT blob_path FROM gone)) AS materialized,
  count(*) FILTER (blob_path NOT IN (SELECT blob_path FROM gone)) AS skipped
  FROM listing GROUP BY blob_partition)"""


@query(f"WITH {_LOG}, {_COUNTS} SELECT * FROM counts")
def sync_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(
    f"""WITH {_LOG}, {_COUNTS} SELECT CAST(sum(discovered) AS BIGINT) AS discovered,
  CAST(sum(materialized) AS BIGINT) AS materialized, CAST(sum(skipped) AS BIGINT) AS skipped FROM counts"""
)
def sync_totals(spark, sf_dir):
    return cached.sync_totals(_counts(spark, sf_dir))


@query(
    f"""WITH {_LOG}, used AS (SELECT DISTINCT blob_hour, run_id, group_no FROM have JOIN data USING (blob_hour, run_id, group_no))
SELECT (SELECT count(*) FROM have) AS blobs_count, (SELECT CAST(sum(events_count) AS BIGINT) FROM have) AS events_count,
  (SELECT CAST(sum(group_no * 1000 + 1) AS BIGINT) FROM used) AS parquet_size_bytes,
  (SELECT max(materialized_at) FROM have) AS last_materialized_at"""
)
def status_row(spark, sf_dir):
    log = _log(spark, sf_dir)
    return cached.status_row(cache.manifest_current(log), _stored(log))


# ----------------------------------------------------------- archive and cache


@query(
    f"""WITH {FILED} SELECT blob_path, blob_partition, blob_name AS file_name,
  CAST(sum(length(raw_json) + 1) AS BIGINT) AS size FROM filed GROUP BY ALL"""
)
def archive_listing(spark, sf_dir):
    hours = hours_frame(spark, *w.time_span(spark, sf_dir))
    return archive.list_archive(hours, w.archive(spark, sf_dir), w.FOLDER)


@query(f"WITH {FILED} SELECT {_INDEXED}, raw_json, blob_path, blob_hour FROM filed")
def synced_events(spark, sf_dir):
    """Archive files through a sync into Parquet and back."""
    return cache.read_events(spark, w.cache(spark, sf_dir)).drop("run_id", "group_no", "parquet_path")


@query(
    f"""WITH {FILED} SELECT blob_path, blob_name AS file_name, blob_partition, CAST(0 AS BIGINT) AS group_no,
  CAST(sum(length(raw_json) + 1) AS BIGINT) AS size, count(*) AS events_count, count(*) AS searchable_count,
  min("timestamp") AS first_event, max("timestamp") AS last_event, min(event_id) AS first_id, max(event_id) AS last_id,
  CAST(0 AS BIGINT) AS refused_count, CAST(1 AS BIGINT) AS group_files, false AS removed, blob_hour FROM filed GROUP BY ALL"""
)
def synced_manifest(spark, sf_dir):
    current = cache.manifest_current(cache.read_manifest(spark, w.cache(spark, sf_dir)))
    return current.drop("run_id", "materialized_at", "blob_day", "group_bytes")


@query(
    f"""WITH {FILED} SELECT blob_path, blob_name AS file_name, blob_partition, CAST(sum(length(raw_json) + 1) AS BIGINT) AS size,
  count(*) AS events_count, blob_hour, 2 AS single_runs FROM filed WHERE "timestamp" < TIMESTAMP '2024-01-06' GROUP BY ALL"""
)
def merged_manifest(spark, sf_dir):
    """Five runs of a day each, merged after the third and after the fourth: two are still stored singly."""
    root, container = scratch_path(spark, "cache"), w.archive(spark, sf_dir)
    first, _ = w.time_span(spark, sf_dir)
    for part in range(1, 6):
        sync.sync(spark, container, root, first, datetime(2024, 1, 1 + part), folder=w.FOLDER)
        if part in (3, 4):
            merge_runs(spark, root)
    single = len(child_names(spark, join_path(root, "commits", "*")))
    current = cache.manifest_current(cache.read_manifest(spark, root))
    return current.select(
        "blob_path", "file_name", "blob_partition", "size", "events_count", "blob_hour", F.lit(single).alias("single_runs")
    )


@query(
    f"""WITH {FILED}, half AS (SELECT min("timestamp") + (max("timestamp") - min("timestamp")) / 2 AS mid FROM filed)
SELECT blob_partition, count(DISTINCT blob_name) AS discovered,
  CASE WHEN blob_partition <= max(strftime(mid, '%Y/%m/%d/%H')) THEN 0 ELSE count(DISTINCT blob_name) END AS materialized,
  CASE WHEN blob_partition <= max(strftime(mid, '%Y/%m/%d/%H')) THEN count(DISTINCT blob_name) ELSE 0 END AS skipped
FROM filed, half GROUP BY blob_partition"""
)
def resync_counts(spark, sf_dir):
    """The first half of the time is synced, then all of it."""
    span = w.table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).head()
    root, container = scratch_path(spark, "cache"), w.archive(spark, sf_dir)
    mid = span["a"] + (span["b"] - span["a"]) / 2
    first, end = w.time_span(spark, sf_dir)
    sync.sync(spark, container, root, first, mid, folder=w.FOLDER)
    return sync.sync(spark, container, root, first, end, folder=w.FOLDER)


@query(
    f"""WITH {FILED}, one AS (SELECT blob_path FROM filed WHERE event_id = '7')
SELECT blob_path, blob_name AS file_name, count(*) AS events_count, min("timestamp") AS first_event
FROM filed WHERE blob_path IN (SELECT blob_path FROM one) GROUP BY ALL"""
)
def manifest_entry(spark, sf_dir):
    """Point read: the manifest row of the file that holds event 7."""
    root = w.cache(spark, sf_dir)
    path = cache.read_events(spark, root).where("event_id = '7'").head()["blob_path"]
    return cache.manifest_entry(spark, root, path).select("blob_path", "file_name", "events_count", "first_event")


@query(
    f"WITH {FILED} SELECT event_id, blob_partition, blob_name, file_line AS source_line, raw_json "
    "FROM filed WHERE event_id = '7'"
)
def lookup_event(spark, sf_dir):
    """Search one ID, then read its stored event at the location found."""
    root = w.cache(spark, sf_dir)
    at = results.search_cache(spark, root, *w.time_span(spark, sf_dir), {"event_id": "7"}).head()
    events = cache.read_events(spark, root, (at["blob_hour"], at["blob_hour"]))
    return lookup.lookup_event(events, at["event_id"], at["blob_path"], at["source_line"], at["blob_partition"])


@query(
    f"""WITH {FILED} SELECT count(DISTINCT blob_path) AS blobs_count, count(*) AS events_count,
  true AS has_bytes, true AS ran FROM filed"""
)
def cache_status(spark, sf_dir):
    """Bytes and time of the last run are those of the cache's own files and manifest."""
    root = w.cache(spark, sf_dir)
    stored = sync.data_files(spark, root).agg(F.sum("size").alias("b"))
    last = cache.read_manifest(spark, root).agg(F.max("materialized_at").alias("t"))
    found = status.cache_status(spark, root).join(stored, F.col("b") == F.col("parquet_size_bytes"), "left")
    return found.join(last, F.col("t") == F.col("last_materialized_at"), "left").select(
        "blobs_count", "events_count", F.col("b").isNotNull().alias("has_bytes"), F.col("t").isNotNull().alias("ran")
    )


@query(f"WITH {FILED} SELECT blob_hour, 1 AS files, count(*) AS events FROM filed GROUP BY blob_hour")
def events_per_stored_file(spark, sf_dir):
    """Each hour's files are one group, and a group is one stored file."""
    events = cache.read_events(spark, w.cache(spark, sf_dir))
    return events.groupBy("blob_hour").agg(
        F.count_distinct("parquet_path").cast("int").alias("files"), F.count("*").alias("events")
    )


@query(f'WITH {FILED} SELECT event_id, blob_path, file_line AS source_line FROM filed ORDER BY "timestamp" DESC, event_id LIMIT 100')
def search_newest(spark, sf_dir):
    """No filter over all hours: the manifest rules out all but the last ones."""
    found = results.search_cache(spark, w.cache(spark, sf_dir), *w.time_span(spark, sf_dir))
    return found.select("event_id", "blob_path", "source_line")


_LAST_SQL = f"""WITH {FILED}, found AS (SELECT *, file_line AS source_line FROM filed
  WHERE {MONTH_SQL} AND category = 'account' ORDER BY "timestamp" DESC, event_id LIMIT 1000)"""


def _search_archive(spark, sf_dir):
    """Sync what is missing, search, store: the whole way of one search, in a cache of its own."""
    root = scratch_path(spark, "cache")
    first, end = w.time_span(spark, sf_dir)
    found = results.search_archive(
        spark, w.archive(spark, sf_dir), root, first, end, {"category": "account"}, 1000, folder=w.FOLDER
    )
    return root, found


@query(_LAST_SQL + f" SELECT {SUMMARY} FROM found")
def search_archive(spark, sf_dir):
    return _search_archive(spark, sf_dir)[1].drop("parquet_path")


@query(_LAST_SQL + " SELECT event_id, blob_partition, blob_name, source_line, raw_json FROM found")
def lookup_from_last(spark, sf_dir):
    root, _ = _search_archive(spark, sf_dir)
    return results.lookup_last(spark, root)


@query(_LAST_SQL + " SELECT event_id FROM found WHERE starts_with(event_id, '9') ORDER BY event_id LIMIT 20")
def prefix_search(spark, sf_dir):
    root, _ = _search_archive(spark, sf_dir)
    return results.find_last_ids(spark, root, "9")


_EXPRESSION_SQL = f"""WITH {CACHED} SELECT {SUMMARY} FROM et WHERE organization_id = 'org-3'
  AND {_range_sql("2024-01-17 18:30:00", "2024-01-18 18:30:00")} {NEWEST} LIMIT 50"""


@query(_EXPRESSION_SQL)
def search_expression(spark, sf_dir):
    """`yesterday` in a zone five and a half hours ahead, in one call."""
    found = results.search_expression(
        spark, w.archive(spark, sf_dir), scratch_path(spark, "cache"), expr="Yesterday", tz="Asia/Kolkata",
        now=datetime(2024, 1, 18, 20, 15), filters={"organization_id": "org-3"}, limit=50, folder=w.FOLDER,
    )
    return found.drop("parquet_path")


@query(f"WITH {FILED} SELECT 0 AS results, 100 AS earlier, count(*) AS events FROM filed")
def cleared_results(spark, sf_dir):
    """Clearing drops the stored results and nothing else."""
    root = scratch_path(spark, "cache")
    span = w.time_span(spark, sf_dir)
    sync.sync(spark, w.archive(spark, sf_dir), root, *span, folder=w.FOLDER)
    earlier = results.search_and_store(spark, root, *span).count()
    results.clear_results(spark, root)
    left = results.read_results(spark, root).agg(F.count("*").cast("int").alias("results"))
    events = cache.read_events(spark, root).agg(F.count("*").alias("events"))
    return left.join(events).withColumn("earlier", F.lit(earlier))


_DAY_SQL = _range_sql("2024-01-10", "2024-01-11")


@query(f"WITH {FILED} SELECT event_id, blob_path, file_line AS source_line, 0 AS after_reset FROM filed WHERE {_DAY_SQL}")
def reset_and_sync(spark, sf_dir):
    """A reset cache holds nothing; a sync then stores the same events again."""
    root, day = scratch_path(spark, "cache"), (datetime(2024, 1, 10), datetime(2024, 1, 11))
    container = w.archive(spark, sf_dir)
    sync.sync(spark, container, root, *day, folder=w.FOLDER)
    sync.reset(spark, root)
    left = cache.read_events(spark, root).count()
    sync.sync(spark, container, root, *day, folder=w.FOLDER)
    return cache.read_events(spark, root).select("event_id", "blob_path", "source_line", F.lit(left).alias("after_reset"))


_SYNCED = f"WITH {FILED} SELECT event_id, blob_path, file_line AS source_line, raw_json FROM filed"
_SYNCED_COLUMNS = ("event_id", "blob_path", "source_line", "raw_json")


@query(_SYNCED + f" WHERE {_DAY_SQL}")
def resync_after_loss(spark, sf_dir):
    """One of the stored files of a split group is lost; the next sync brings all events back."""
    root, day = scratch_path(spark, "cache"), (datetime(2024, 1, 10), datetime(2024, 1, 11))
    options = {"folder": w.FOLDER, "split_bytes": 2_000}
    sync.sync(spark, w.archive(spark, sf_dir), root, *day, **options)
    stored = sync.data_files(spark, root)
    split = stored.groupBy("blob_hour").agg(F.count("*").alias("n"), F.max("file_path").alias("file_path"))
    lost = split.orderBy(F.desc("n"), "blob_hour").head()["file_path"]
    remove(spark, join_path(root, "events", lost))
    sync.sync(spark, w.archive(spark, sf_dir), root, *day, **options)
    return cache.read_events(spark, root).select(*_SYNCED_COLUMNS)


def _extended_archive(spark, sf_dir, extra: list[tuple[str, str]]) -> str:
    """An archive of its own: all files, and some more (path, content)."""
    container = scratch_path(spark, "archive")
    w.write_files(w.chunks(spark, sf_dir).select("blob_path", "content"), container)
    if extra:
        paths, contents = zip(*extra, strict=True)
        w.write_files(spark.createDataFrame(pa.table({"blob_path": paths, "content": contents})), container)
    return container


_HOUR_7 = "(SELECT blob_hour FROM filed WHERE event_id = '7')"


@query(_SYNCED + f" WHERE blob_hour <> {_HOUR_7}")
def sync_beside_malformed_hour(spark, sf_dir):
    """One hour has a file with a malformed line: it is refused, the other hours are stored."""
    path = w.chunks(spark, sf_dir).where(F.contains("content", F.lit('"event_id":"7"')) | F.contains("content", F.lit('"event_id":7,')))
    hour = path.select("blob_path").head()["blob_path"].rpartition("/")[0]
    container = _extended_archive(spark, sf_dir, [(f"{hour}/broken.ndjson", '{"event_id":\n')])
    root = scratch_path(spark, "cache")
    try:
        sync.sync(spark, container, root, *w.time_span(spark, sf_dir), folder=w.FOLDER)
    except ingest.MalformedLineError:
        return cache.read_events(spark, root).select(*_SYNCED_COLUMNS)
    raise AssertionError("the malformed line was not noticed")


# Two files an hour, each event in the file of its ID's last bit.
_SMALL_FILES = FILED.replace("'events-' || (event_id // 50000) || '-' || ((event_id // 4) % 2) || '.ndjson'", "'part-' || (event_id % 2) || '.ndjson'")


def _small_syncs(spark, sf_dir) -> tuple[str, str]:
    """An archive synced in two runs, of one file name each; container and cache."""
    lines = w.encoded(spark, sf_dir).withColumn(
        "blob_name", F.concat(F.lit("part-"), (F.col("event_id") % 2).cast("string"), F.lit(".ndjson"))
    )
    container, root = scratch_path(spark, "archive"), scratch_path(spark, "cache")
    w.write_files(w.files_of(lines).select("blob_path", "content"), container)
    listing = pin(archive.list_archive(hours_frame(spark, *w.time_span(spark, sf_dir)), container, w.FOLDER))
    for part in range(2):
        sync.sync_listing(spark, container, root, listing.where(F.col("file_name") == f"part-{part}.ndjson"), None)
    return container, root


def _directories(spark, root) -> DataFrame:
    """The most directories that a reader opens for an hour, and all that are there."""
    needed = cache.hour_dirs(cache.manifest_current(cache.read_manifest(spark, root)))
    most = needed.groupBy("blob_hour").agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("an_hour"))
    stored = sum(
        len(child_names(spark, join_path(root, "events", run, "blob_hour=*"))) for run in child_names(spark, join_path(root, "events", "run_id=*"))
    )
    return most.crossJoin(needed.agg((F.lit(stored) - F.count("*")).cast("int").alias("left_over")))


@query(
    f"""WITH {_SMALL_FILES} SELECT event_id, blob_path, file_line AS source_line, raw_json, 1 AS an_hour,
  (SELECT CAST(count(DISTINCT blob_path) AS INTEGER) FROM filed) AS left_over FROM filed"""
)
def compacted_events(spark, sf_dir):
    """After two syncs, an hour's events lie in up to two directories; re-compaction leaves one to open."""
    _, root = _small_syncs(spark, sf_dir)
    # Hours of one directory too, so that the old directories are as many as the files.
    compact_hours(spark, root, most_directories=0)
    return cache.read_events(spark, root).select(*_SYNCED_COLUMNS).crossJoin(_directories(spark, root))


@query(
    f"""WITH {_SMALL_FILES} SELECT event_id, blob_path, file_line AS source_line, raw_json, 1 AS an_hour, 0 AS left_over,
  (SELECT count(DISTINCT blob_path) FROM filed) AS replaced, (SELECT count(DISTINCT blob_path) FROM filed WHERE blob_name = 'part-1.ndjson') AS uncommitted FROM filed"""
)
def reclaimed_events(spark, sf_dir):
    """One of two syncs never commits; the next sync reads its files again, hours are compacted, and what is left over goes."""
    container, root = _small_syncs(spark, sf_dir)
    rows = cache.read_manifest(spark, root).where(F.col("file_name") == "part-1.ndjson")
    lost = rows.select("run_id").distinct().collect()
    for row in lost:
        remove(spark, join_path(root, "commits", row["run_id"]))
    sync.sync(spark, container, root, *w.time_span(spark, sf_dir), folder=w.FOLDER)
    compact_hours(spark, root, most_directories=0)
    later = datetime.now(timezone.utc) + timedelta(days=3)
    gone = reclaim(spark, root, now=later).groupBy("reason").count().collect()
    counts = {r["reason"]: r["count"] for r in gone}
    found = cache.read_events(spark, root).select(*_SYNCED_COLUMNS).crossJoin(_directories(spark, root))
    return found.select("*", *[F.lit(counts.get(k, 0)).cast("bigint").alias(k) for k in ("replaced", "uncommitted")])


@query(
    f"""WITH {FILED} SELECT 'removed' AS state, event_id, blob_path, file_line AS source_line FROM filed WHERE NOT ends_with(blob_name, '-1.ndjson')
UNION ALL SELECT 'returned', event_id, blob_path, file_line FROM filed"""
)
def deleted_files(spark, sf_dir):
    """Files vanish from the archive and so do their events; they come back with the files."""
    container, root, span = _extended_archive(spark, sf_dir, []), scratch_path(spark, "cache"), w.time_span(spark, sf_dir)
    sync.sync(spark, container, root, *span, folder=w.FOLDER)
    gone = w.chunks(spark, sf_dir).where(F.col("file_name").endswith("-1.ndjson")).select("blob_path", "content")
    w.remove_files(gone, container)
    sync.reconcile_deleted(spark, container, root, *span, folder=w.FOLDER, most_share=0.9)
    columns = ("event_id", "blob_path", "source_line")
    without = pin(cache.read_events(spark, root).select(F.lit("removed").alias("state"), *columns))
    w.write_files(gone, container)
    sync.sync(spark, container, root, *span, folder=w.FOLDER)
    return without.unionByName(cache.read_events(spark, root).select(F.lit("returned").alias("state"), *columns))


def _streamed(spark, sf_dir) -> str:
    """The cache of a stream over an archive with files that are easily lost or mistaken."""
    first = w.time_span(spark, sf_dir)[0].strftime("year=%Y/month=%m/day=%d/hour=%H")
    extra = [
        (f"audit/{first}/empty.ndjson", ""),
        (f"audit/{first}/_blank.ndjson", "\n \n"),
        (f"audit/{first}/part/.dot.ndjson", "\n"),
        # Not in the archive's layout: an old copy, a note, another suffix.
        (f"audit/old/{first}/copy.ndjson", '{"event_id":"copy","timestamp":"2024-01-10T00:00:00Z"}\n'),
        ("audit/readme.ndjson", "not an event"),
        (f"audit/{first}/notes.txt", "not an event"),
    ]
    root = scratch_path(spark, "cache")
    stream = sync_stream(
        spark, _extended_archive(spark, sf_dir, extra), root, scratch_path(spark, "stream"), folder=w.FOLDER
    )
    stream.awaitTermination()
    return root


@query(_SYNCED)
def streamed_events(spark, sf_dir):
    return cache.read_events(spark, _streamed(spark, sf_dir)).select(*_SYNCED_COLUMNS)


@query(
    f"""WITH {FILED}, first AS (SELECT 'audit/' || strftime(min("timestamp"), 'year=%Y/month=%m/day=%d/hour=%H') AS h FROM filed)
SELECT blob_path, blob_name AS file_name, CAST(sum(length(raw_json) + 1) AS BIGINT) AS size, count(*) AS events_count FROM filed GROUP BY ALL
UNION ALL SELECT h || '/empty.ndjson', 'empty.ndjson', 0, 0 FROM first UNION ALL SELECT h || '/_blank.ndjson', '_blank.ndjson', 3, 0 FROM first
UNION ALL SELECT h || '/part/.dot.ndjson', '.dot.ndjson', 1, 0 FROM first"""
)
def streamed_manifest(spark, sf_dir):
    current = cache.manifest_current(cache.read_manifest(spark, _streamed(spark, sf_dir)))
    return current.select("blob_path", "file_name", "size", "events_count")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 3 WHEN 2 THEN date_trunc('week', ts)
  ELSE date_trunc('day', ts) END::TIMESTAMP AS "timestamp" FROM events"""
)
def ingest_date_shapes(spark, sf_dir):
    """Times given as a basic date, as a week date with its day, and as a week."""
    day = F.to_date("ts")
    week = F.concat(
        F.year(F.date_add(F.to_date(F.date_trunc("WEEK", "ts")), 3)).cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )
    shape = F.col("event_id") % 3
    stamp = F.when(shape == 0, F.date_format(day, "yyyyMMdd")).when(
        shape == 1, F.concat(week, F.lit("-"), (F.weekday(day) + 1).cast("string"))
    ).otherwise(week)
    lines = w.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("source_line"),
        F.concat(F.lit('{"event_id":"'), F.col("event_id").cast("string"), F.lit('","timestamp":"'), stamp, F.lit('"}')).alias("raw_json"),
    )
    return ingest.parse_lines(lines).select("event_id", "timestamp")


@query(f"WITH {FILED} SELECT event_id, blob_partition, blob_name, file_line AS source_line, raw_json FROM filed")
def lookup_all(spark, sf_dir):
    """Every event looked up through a result set as large as the table."""
    events = cache.read_events(spark, w.cache(spark, sf_dir))
    return lookup.lookup_results(events, events.select("event_id", "blob_path", "source_line", "blob_partition"))


@query(
    f"""WITH {TABLE}, doubled AS (SELECT user_id AS event_id, event_id AS other, "timestamp", blob_partition, blob_name, source_line,
  blob_path FROM et UNION ALL SELECT user_id, event_id, "timestamp" - INTERVAL 1 HOUR, blob_partition, blob_name, source_line, blob_path FROM et),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp" DESC, blob_partition, blob_name, source_line, blob_path) AS n FROM doubled)
SELECT event_id, other, "timestamp", blob_partition, blob_name, source_line, blob_path FROM n WHERE n = 1"""
)
def latest_results_dedup(spark, sf_dir):
    """Many rows per ID (here the user) reduced to the newest."""
    rows = w.event_table(spark, sf_dir).select(
        F.col("user_id").alias("event_id"), F.col("event_id").alias("other"),
        "timestamp", "blob_partition", "blob_name", "source_line", "blob_path",
    )
    older = rows.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 HOUR"))
    return lookup.unique_results(rows.union(older))


# ------------------------------------------------------------------- display


def _shorten_sql(value: str, n: int) -> str:
    return (
        f"CASE WHEN coalesce(length({value}), 0) = 0 THEN '-' WHEN length({value}) <= {n} THEN {value} "
        f"ELSE substr({value}, 1, {n - 1}) || '…' END"
    )


@query(
    f"""SELECT conv_id || '-' || turn AS event_id, CASE WHEN turn % 3 = 0 THEN '-' ELSE role END AS user_id,
  {_shorten_sql("text", 20)} AS organization_id,
  {_shorten_sql("role", 20)} AS event_name, {_shorten_sql("(role || role)", 10)} AS category,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(61 * conv_id + turn), '%Y-%m-%d %H:%M:%S') AS timestamp_utc
FROM conversations"""
)
def result_projection(spark, sf_dir):
    turns = w.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"),
        F.when(F.col("turn") % 3 == 1, F.col("role")).when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("user_id"),
        F.col("text").alias("organization_id"),
        F.col("role").alias("event_name"),
        F.concat("role", "role").alias("category"),
        F.timestamp_seconds(F.lit(1704067200) + 61 * F.col("conv_id") + F.col("turn")).alias("timestamp"),
    )
    return display.result_table(turns)


@query(
    """WITH s AS (SELECT doc_id, n_chars * CAST(pow(1024, doc_id % 5) AS BIGINT) AS size FROM documents),
u AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2
  WHEN size < 1099511627776 THEN 3 WHEN size < 1125899906842624 THEN 4 ELSE 5 END AS p FROM s)
SELECT doc_id, printf('%.1f', size / pow(1024, p)) || ' ' || (['B', 'KB', 'MB', 'GB', 'TB', 'PB'])[p + 1] AS label FROM u"""
)
def format_size(spark, sf_dir):
    docs = w.table(spark, sf_dir, "documents")
    size = F.col("n_chars") * F.pow(F.lit(1024), F.col("doc_id") % 5).cast("bigint")
    return docs.select("doc_id", display.format_size(size).alias("label"))


@query(f"WITH {EV} SELECT event_id, blob_partition || '/' || blob_name AS label FROM ev")
def source_labels(spark, sf_dir):
    events = w.event_table(spark, sf_dir)
    return events.select(
        "event_id", display.source_label(F.col("blob_partition"), F.col("blob_name")).alias("label")
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive -> sync -> search one day, newest 100."""
    configure(spark)
    container = w.archive(spark, sf_dir)
    found = results.search_archive(
        spark, container, scratch_path(spark, "cache"), datetime(2024, 1, 10), datetime(2024, 1, 11), folder=w.FOLDER
    )
    return w.as_ntz(found.drop("parquet_path"))
