"""Greedy size grouping of files within an hour, without one task per hour.

The rule is sequential: going through an hour's files by name, start a new
group when adding the next file would pass the target. A crowded hour may hold
a third of all files, so no task may fold over a whole hour. Instead files are
range-partitioned by (hour, name) and cut into blocks of bounded length, many short
ones to a partition, and

1. each block is summarised as a function: total size of the open group on
   entry -> that size and the number of new groups on exit;
2. where an hour has more than `FAN` blocks, the functions of `FAN` neighbours are
   composed into one, level by level, until `FAN` are left; these are applied one
   after the other, and their entry states handed down the levels again. So no
   task sees more than `FAN` summaries of an hour at a time;
3. each block, now knowing its entry state, numbers its own files.

The result equals the sequential rule exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourvault.lean import lean
from hourvault.session import pin

BLOCK_ROWS = 200_000
#: Files a partition holds at least, so that short blocks are not a task each.
PART_ROWS = 20_000
#: Rows and steps of summaries that leave a task at once.
BATCH_STEPS = 10_000
#: Summaries of one hour that a task composes or walks through.
FAN = 32


def _next_starts(totals: np.ndarray, target: int) -> np.ndarray:
    """For a group that starts at file i of the block, where the next one starts."""
    before = np.concatenate(([0], totals[:-1]))
    reach = np.searchsorted(totals, before + target, side="right")
    return np.maximum(reach, np.arange(1, len(totals) + 1))


def summarise_block(sizes: np.ndarray, target: int) -> dict:
    """The block as a step function of the open group's size on entry.

    Entry size s opens the first new group at the first file where s plus the
    running total passes the target, so files are steps with falling thresholds;
    below the lowest one no new group starts.
    """
    totals = np.cumsum(sizes, dtype=np.int64)
    count = len(totals)
    following = _next_starts(totals, target).tolist()
    before = np.concatenate(([0], totals[:-1])).tolist()
    carry, groups = [0] * count, [0] * count
    last = int(totals[-1])
    for i in range(count - 1, -1, -1):
        j = following[i]
        if j >= count:
            carry[i], groups[i] = last - before[i], 1
        else:
            carry[i], groups[i] = carry[j], groups[j] + 1
    # Only the first file of each threshold, down to threshold 0, can be reached.
    thresholds = target - totals + 1
    reachable = np.flatnonzero(np.concatenate(([True], totals[1:] > totals[:-1])))
    stop = int(np.searchsorted(-thresholds[reachable], 0, side="left")) + 1
    steps = reachable[:stop]
    return {
        "total": last,
        "thresholds": thresholds[steps].tolist(),
        "carries": [carry[i] for i in steps],
        "groups": [groups[i] for i in steps],
    }


def apply_summary(carry: int | None, summary: dict) -> tuple[int, int]:
    """Open-group size on exit and new groups started; None enters an hour."""
    if carry is None:
        return summary["carries"][0], summary["groups"][0]
    thresholds = np.asarray(summary["thresholds"], dtype=np.int64)
    step = int(np.searchsorted(-thresholds, -carry, side="left"))
    if step == len(thresholds):
        return carry + summary["total"], 0
    return int(summary["carries"][step]), int(summary["groups"][step])


def compose(first: dict, second: dict) -> dict:
    """The summary of two neighbouring stretches of files as one.

    Sizes that open a group in the first go on through the second from what that
    leaves. Sizes that open none enter the second larger by the first's total, so
    its steps count from thresholds lower by as much. Steps end at threshold 0,
    as those of a block do: there are at most as many as files in one target.
    """
    after = np.asarray(first["carries"], dtype=np.int64)
    thresholds = np.asarray(second["thresholds"], dtype=np.int64)
    step = np.searchsorted(-thresholds, -after, side="left")
    opens = step < len(thresholds)
    step = np.minimum(step, len(thresholds) - 1)
    carries = np.where(opens, np.asarray(second["carries"], dtype=np.int64)[step], after + second["total"])
    groups = np.asarray(first["groups"], dtype=np.int64) + np.where(opens, np.asarray(second["groups"], dtype=np.int64)[step], 0)
    out = {"total": first["total"] + second["total"], "thresholds": list(first["thresholds"]), "carries": carries.tolist(), "groups": groups.tolist()}
    for threshold, carry, opened in zip((thresholds - first["total"]).tolist(), second["carries"], second["groups"], strict=True):
        if out["thresholds"][-1] <= 0:
            break
        if threshold < out["thresholds"][-1]:
            out["thresholds"].append(threshold)
            out["carries"].append(carry)
            out["groups"].append(opened)
    return out


def number_files(sizes: np.ndarray, target: int, carry: int | None, started: int) -> tuple[np.ndarray, int, int]:
    """Group numbers of consecutive files, and the state after the last one."""
    totals = np.cumsum(sizes, dtype=np.int64)
    count = len(totals)
    following = _next_starts(totals, target)
    opens = np.zeros(count, dtype=np.int64)
    at = 0 if carry is None else int(np.searchsorted(totals, target - carry, side="right"))
    latest = -1
    while at < count:
        opens[at] = 1
        latest = at
        at = int(following[at])
    numbers = started - 1 + np.cumsum(opens)
    if latest < 0:
        left = carry + int(totals[-1])
    else:
        left = int(totals[-1]) - (int(totals[latest - 1]) if latest else 0)
    return numbers, left, int(numbers[-1]) + 1


_SUMMARY = (
    "key string, block_no bigint, total bigint, "
    "thresholds array<bigint>, carries array<bigint>, groups array<bigint>"
)
_SUMMARY_ARROW = pa.schema(
    [
        ("key", pa.string()),
        ("block_no", pa.int64()),
        ("total", pa.int64()),
        ("thresholds", pa.list_(pa.int64())),
        ("carries", pa.list_(pa.int64())),
        ("groups", pa.list_(pa.int64())),
    ]
)


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, int, int]]:
    """Stretches (values, start, end) of equal values in a sorted batch."""
    columns = [batch.column(name).dictionary_encode() for name in names]
    changes = np.zeros(batch.num_rows - 1, dtype=bool)
    for column in columns:
        changes |= np.diff(column.indices.to_numpy()) != 0
    edges = (np.flatnonzero(changes) + 1).tolist()
    for start, end in zip([0, *edges], [*edges, batch.num_rows]):
        yield tuple(column[start].as_py() for column in columns), start, end


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Short rows many at a time; a long summary goes alone."""
    ready: list[dict] = []
    steps = 0
    for row in rows:
        ready.append(row)
        steps += 1 + len(row.get("thresholds", ()))
        if steps >= BATCH_STEPS:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
            ready, steps = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=schema)


def _summaries(target: int):
    """One summary per stretch of (key, block) in a partition; a partition holds whole blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current: tuple[str, int] | None = None
        parts: list[np.ndarray] = []

        def close() -> dict:
            return {"key": current[0], "block_no": current[1], **summarise_block(np.concatenate(parts), target)}

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size").to_numpy()
            for found, start, end in _runs(batch, "key", "block_no"):
                if found != current:
                    if parts:
                        yield close()
                    current, parts = found, []
                parts.append(sizes[start:end])
        if parts:
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(rows(batches), _SUMMARY_ARROW)

    return run


def _numbered(target: int, size: str):
    """Number files sorted by (key, block, order), from each block's entry state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, carry, started = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(size).cast(pa.int64()).to_numpy()
            numbers = []
            for (stretch,), start, end in _runs(batch, "_stretch"):
                if stretch != current:
                    current = stretch
                    carry = batch.column("carry")[start].as_py()
                    started = batch.column("started")[start].as_py()
                found, carry, started = number_files(sizes[start:end], target, carry, started)
                numbers.append(found)
            kept = batch.drop_columns(["carry", "started", "block_no", "_stretch"])
            yield kept.append_column("group_no", pa.array(np.concatenate(numbers), pa.int64()))

    return run


def _summary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Summaries one at a time, as a single one may be long."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary per (key, parent) of rows sorted by (key, parent, block)."""

    def rows() -> Iterator[dict]:
        current: tuple[str, int] | None = None
        whole: dict = {}
        for row in _summary_rows(batches):
            if (row["key"], row["parent"]) == current:
                whole = compose(whole, row)
                continue
            if current:
                yield {**whole, "key": current[0], "block_no": current[1]}
            current, whole = (row["key"], row["parent"]), row
        if current:
            yield {**whole, "key": current[0], "block_no": current[1]}

    return _in_batches(rows(), _SUMMARY_ARROW)


_STATE = "key string, block_no bigint, carry bigint, started bigint"


def _entry_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the summaries of each (key, parent) in block order, from the state in which the parent is entered."""
    schema = pa.schema(
        [("key", pa.string()), ("block_no", pa.int64()), ("carry", pa.int64()), ("started", pa.int64())]
    )

    def rows() -> Iterator[dict]:
        current, carry, started = None, None, 0
        for row in _summary_rows(batches):
            if (row["key"], row["parent"]) != current:
                current, carry, started = (row["key"], row["parent"]), row["carry"], row["started"]
            yield {"key": row["key"], "block_no": row["block_no"], "carry": carry, "started": started}
            carry, opened = apply_summary(carry, row)
            started += opened

    return _in_batches(rows(), schema)


def _by_parent(summaries: DataFrame, fan: int) -> DataFrame:
    return summaries.withColumn("parent", F.expr(f"block_no div {fan}"))


def _walk(summaries: DataFrame) -> DataFrame:
    return (
        summaries.repartition("key", "parent")
        .sortWithinPartitions("key", "parent", "block_no")
        .mapInArrow(lean(_entry_states), _STATE)
    )


def block_states(summaries: DataFrame, blocks: int, fan: int = FAN) -> DataFrame:
    """Size of the open group and number of groups begun when each block of a key is entered."""
    levels = [summaries]
    while blocks > fan:
        levels[-1] = pin(levels[-1])
        placed = _by_parent(levels[-1], fan).repartition("key", "parent").sortWithinPartitions("key", "parent", "block_no")
        levels.append(placed.mapInArrow(lean(_composed), _SUMMARY))
        blocks = -(-blocks // fan)
    top = levels.pop().withColumns({"parent": F.lit(0), "carry": F.lit(None).cast("bigint"), "started": F.lit(0).cast("bigint")})
    states = _walk(top)
    while levels:
        entered = states.withColumnRenamed("block_no", "parent")
        states = _walk(_by_parent(levels.pop(), fan).join(entered, ["key", "parent"]))
    return states


def _in_blocks(files: DataFrame, key: str, order: str, block_rows: int, count: int) -> tuple[DataFrame, int]:
    """Files in the order of the rule with the number of their block, and how many numbers there are.

    Blocks are counted within partitions, so their numbers go up in the order of the
    files; partitions of fewer blocks than the longest leave numbers out.
    """
    parts = max(1, -(-count // max(block_rows, PART_ROWS)))
    # The numbers of rows count from 2^33 times the partition.
    placed = pin(
        files.repartitionByRange(parts, key, order).sortWithinPartitions(key, order).withColumn("_at", F.monotonically_increasing_id())
    )
    part, row = F.expr("_at div (1L << 33)"), F.expr("_at % (1L << 33)")
    a_part = 1
    if count > block_rows:
        last = placed.agg(F.max(part).alias("part"), F.max(row).alias("row")).head()
        parts, a_part = last["part"] + 1, last["row"] // block_rows + 1
    block_no = part * F.lit(a_part).cast("bigint") + F.expr(f"_at % (1L << 33) div {block_rows}")
    return placed.withColumn("block_no", block_no).drop("_at"), parts * a_part


def assign_groups(
    files: DataFrame,
    target_size: int,
    key: str = "blob_hour",
    order: str = "blob_path",
    size: str = "size",
    block_rows: int = BLOCK_ROWS,
    count: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Add `group_no` (from 0 within each `key`) by the greedy rule.

    `order` must be unique within `key`. `count` is the number of files if the
    caller already knows it.
    """
    if target_size < 1:
        raise ValueError("target_size must be at least 1")
    if block_rows < 1:
        raise ValueError("block_rows must be at least 1")
    if fan < 2:
        raise ValueError("fan must be at least 2")
    if count is None:
        count = files.count()
    ordered, blocks = _in_blocks(files, key, order, block_rows, count)
    summaries = ordered.select(
        F.col(key).cast("string").alias("key"), "block_no", F.col(size).cast("bigint").alias("size")
    ).mapInArrow(lean(_summaries(target_size)), _SUMMARY)
    states = block_states(summaries, blocks, fan).select(
        F.col("key").alias("_key"), F.col("block_no").alias("_block"), "carry", "started"
    )
    names = files.columns
    text_key = F.col(key).cast("string")
    located = (
        ordered.join(states, (text_key == F.col("_key")) & (F.col("block_no") == F.col("_block")))
        .select(*names, "block_no", "carry", "started", F.concat_ws("#", text_key, "block_no").alias("_stretch"))
        .repartition(key, "block_no")
        .sortWithinPartitions(key, "block_no", order)
    )
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return located.mapInArrow(lean(_numbered(target_size, size)), f"{out}, group_no bigint")


def group_totals(assigned: DataFrame, key: str = "blob_hour", size: str = "size") -> DataFrame:
    """Files and input bytes per group; groups of empty files are kept."""
    return assigned.groupBy(key, "group_no").agg(
        F.count("*").alias("files_count"), F.sum(size).alias("input_bytes")
    )
