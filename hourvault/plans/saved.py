"""Many saved searches over one event table, in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourvault.functions.hours import hour_bounds, hour_of, hours_of_ranges
from hourvault.operators.search import DEFAULT_LIMIT, MAX_LIMIT, SUMMARY_COLUMNS, check_limit, newest_first
from hourvault.operators.timerange import from_micros
from hourvault.schema import FILTER_FIELDS
from hourvault.session import broadcast_if_small, pin
from hourvault.sources.cache import read_events

_SALTS = 32
_PAIR = ["e_hour", "e_mask", "e_values"]


def _asked(fields: list[str]) -> tuple[Column, Column]:
    """Which filters a search sets, as a number with a bit for each, and their values in that order."""
    mask = sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    return mask, F.array_compact(F.array(*[F.col(f) for f in fields])) if fields else F.array().cast("array<string>")


def _offered(fields: list[str], masks: list[int]) -> Column:
    """The (mask, values) under which searches could ask for an event; none where a value is NULL."""
    keys = []
    for mask in masks:
        used = [F.col(f) for i, f in enumerate(fields) if mask >> i & 1]
        values = F.array(*used) if used else F.array().cast("array<string>")
        known = F.lit(True)
        for value in used:
            known = known & value.isNotNull()
        keys.append(F.when(known, F.struct(F.lit(mask).alias("mask"), values.alias("values"))))
    return F.array_compact(F.array(*keys))


def top_per_search(matches: DataFrame, order: list[Column], max_limit: int, limit: Column | int) -> DataFrame:
    """First `limit` rows per `search_id`, whatever share of rows one search has.

    Each map task keeps at most `max_limit` rows per search before the shuffle;
    a first round over salted parts then leaves one task `_SALTS * max_limit`
    rows of a search at most. The salt only spreads work: any value gives the
    same rows.
    """
    salted = matches.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    part = Window.partitionBy("search_id", "_salt").orderBy(*order)
    whole = Window.partitionBy("search_id").orderBy(*order)
    first = salted.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= max_limit)
    ranked = first.drop("_n", "_salt").withColumn("rank", F.row_number().over(whole))
    return ranked.where((F.col("rank") <= max_limit) & (F.col("rank") <= limit))


def _reachable(by_hour: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    """Drop hours that cannot reach a search's newest `limit` rows.

    `stats` has rows, first and last event time per (hour, filters). Hours that
    lie wholly in a search's range and hold `limit` rows between them set a
    floor: nothing older can be among the newest.
    """
    known = by_hour.join(stats, _PAIR)
    whole = (F.col("first") >= F.col("s_from")) & (F.col("last") < F.col("s_to"))
    counted = F.sum(F.when(whole, F.col("rows")).otherwise(0)).over(
        Window.partitionBy("search_id").orderBy(F.desc("first"))
    )
    enough = F.max(F.when(whole & (F.col("_sum") >= limit), F.col("first"))).over(
        Window.partitionBy("search_id")
    )
    floored = known.withColumn("_sum", counted).withColumn("_floor", enough)
    return (
        floored.where(F.col("_floor").isNull() | (F.col("last") >= F.col("_floor")))
        .withColumn("s_from", F.greatest("s_from", "_floor"))
        .drop("rows", "first", "_sum", "_floor")
    )


def _in_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of (hour, filters, order), with the number of the range in `_part`.

    Ranges are cut from samples of the whole order, down to its last tie-breaker, so
    they are about equally long, however many rows one hour or one instant has.
    """
    return pin(rows.repartitionByRange(*_PAIR, *order).withColumn("_part", F.spark_partition_id()))


def _numbered(events: DataFrame, ends: DataFrame, order: list[Column]) -> DataFrame:
    """Events of each (hour, filters) numbered from the newest, and before each search end the number of later events.

    `ends` has the pair and `timestamp`; the result has `_no` and `_is_end`. Rows
    are numbered range by range, and the rows of earlier ranges are added from
    sums, so neither a crowded hour nor a crowded instant is one task.
    """
    marks = ends.withColumn("_is_end", F.lit(True))
    rows = events.withColumn("_is_end", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # An event at the very end of a search is not in it: it counts as later.
    full = [F.desc("timestamp"), F.asc("_is_end"), *order]
    rows = _in_ranges(rows, full)
    is_event = F.when(F.col("_is_end"), 0).otherwise(1)
    parts = rows.groupBy(*_PAIR, "_part").agg(F.sum(is_event).alias("_rows"))
    later = Window.partitionBy(*_PAIR).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*_PAIR, "_part", F.coalesce(F.sum("_rows").over(later), F.lit(0)).alias("_later"))
    within = Window.partitionBy(*_PAIR, "_part").orderBy(*full).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_n", F.sum(is_event).over(within))
        .join(offsets, [*_PAIR, "_part"])
        .withColumn("_no", F.col("_n") + F.col("_later"))
        .drop("_n", "_later", "_part")
    )


def run_saved_searches(
    events: DataFrame, searches: DataFrame, *, limit: int = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT
) -> DataFrame:
    """Newest events of every search: `search_id`, result columns, `rank`.

    `searches` has `search_id`, `from_utc`, `to_utc` and any of the filter
    fields (NULL means not set); rows without a range are ignored.

    Searches meet events on (hour, all filters). Counts per (hour, filters) rule
    out hours too old for the limit. In the hours left, events are numbered from
    the newest, and a search meets only the `limit` numbers from its end on (two
    blocks of `limit` numbers hold them). So a search meets a few times `limit`
    events, with or without filters, however crowded its hours are.
    """
    check_limit(limit, max_limit)
    present = [f for f in FILTER_FIELDS if f in searches.columns]
    mask, values = _asked(present)
    keyed = pin(
        searches.where(F.col("from_utc") < F.col("to_utc")).select(
            "search_id",
            F.col("from_utc").alias("s_from"),
            F.col("to_utc").alias("s_to"),
            mask.alias("e_mask"),
            values.alias("e_values"),
        )
    )
    # At most 64 kinds of searches.
    masks = sorted(r["e_mask"] for r in keyed.select("e_mask").distinct().collect())
    by_hour = hours_of_ranges(keyed, "s_from", "s_to").drop("blob_partition").withColumnRenamed("blob_hour", "e_hour")

    extra = [c for c in ("parquet_path", "blob_path") if c in events.columns]
    hour = F.col("blob_hour") if "blob_hour" in events.columns else hour_of(F.col("timestamp"))
    columns = list(dict.fromkeys([*SUMMARY_COLUMNS, *extra]))
    used = list(dict.fromkeys([*columns, *present]))
    offered = (
        events.where(F.col("event_id").isNotNull() & F.col("timestamp").isNotNull())
        .select(*used, hour.alias("e_hour"))
        .select(*columns, "e_hour", F.explode(_offered(present, masks or [0])).alias("_key"))
        .select(*columns, "e_hour", F.col("_key.mask").alias("e_mask"), F.col("_key.values").alias("e_values"))
    )
    pairs, _ = broadcast_if_small(pin(by_hour.select(*_PAIR).distinct()))
    stats = (
        offered.join(pairs, _PAIR, "left_semi")
        .groupBy(*_PAIR)
        .agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    )
    reachable = pin(_reachable(by_hour, stats, limit))
    # Only searches that end before an hour's last event need a number to begin at.
    cut = F.col("s_to") <= F.col("last")
    ends = reachable.where(cut).select(*_PAIR, F.col("s_to").alias("timestamp")).distinct()
    left, _ = broadcast_if_small(pin(reachable.select(*_PAIR).distinct()))
    order = newest_first(columns)[1:]
    numbered = pin(_numbered(offered.join(left, _PAIR, "left_semi"), ends, order))
    begins = numbered.where("_is_end").select(*_PAIR, F.col("timestamp").alias("s_to"), F.col("_no").alias("_begin"))
    placed = reachable.join(begins, [*_PAIR, "s_to"], "left").withColumn("_begin", F.coalesce("_begin", F.lit(0)))
    block = F.floor(F.col("_begin") / limit)
    wanted = placed.withColumn("_block", F.explode(F.array(block, block + 1))).drop("_begin", "last")
    found = numbered.where(~F.col("_is_end")).withColumn("_block", F.floor((F.col("_no") - 1) / limit))
    instant = F.col("timestamp")
    matches = (
        found.join(wanted, [*_PAIR, "_block"])
        .where((instant >= F.col("s_from")) & (instant < F.col("s_to")))
        .select("search_id", *SUMMARY_COLUMNS, *extra)
    )
    return top_per_search(matches, newest_first(matches.columns), limit, limit)


def run_saved_on_cache(
    spark: SparkSession, root: str, searches: DataFrame, *, lateness_hours: int = 0, **options
) -> DataFrame:
    """Saved searches over the synced cache; only the hours between the first start and the last end are opened."""
    ends = (F.min(F.unix_micros("from_utc")).alias("a"), F.max(F.unix_micros("to_utc")).alias("b"))
    span = searches.where("from_utc < to_utc").agg(*ends).head()
    if span["a"] is None:
        bounds = ("0", "0")
    else:
        bounds = hour_bounds(from_micros(span["a"]), from_micros(span["b"]), lateness_hours)
    return run_saved_searches(read_events(spark, root, bounds), searches, **options)
