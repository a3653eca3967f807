"""The NDJSON archive: list its hours and read its files.

Both run as Spark tasks over DataFrames of names, so the driver never holds a
file list, and only the wanted files are opened. File I/O is the one place that
uses Python: Spark's own text source needs the path list on the driver, skips
zero-length files and cannot number the lines of a file it splits. Parsing
stays on native expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourvault.functions.hours import partition_to_hour
from hourvault.lean import lean
from hourvault.sources.storage import join_path, open_storage, qualified

SUFFIX = ".ndjson"
SPLIT_BYTES = 64 * 1024 * 1024
CHUNK_BYTES = 8 * 1024 * 1024
PARALLEL_READS = 16
#: Bytes of small files that leave a reading task at once; it holds them several times.
GATHER_BYTES = 1024 * 1024
#: Names of files that a reading task holds as Python objects.
NAMES = 500


def hour_prefix(partition: Column, folder: str = "") -> Column:
    """`2026/09/09/08` -> `folder/year=2026/month=09/day=09/hour=08`."""
    parts = F.split(F.trim(partition, F.lit("/")), "/")
    names = [
        F.concat(F.lit(f"{name}="), parts[i]) for i, name in enumerate(("year", "month", "day", "hour"))
    ]
    base = [F.lit(folder.strip("/"))] if folder.strip("/") else []
    return F.concat_ws("/", *base, *names)


def partition_of_path(path: Column) -> Column:
    """The reverse of `hour_prefix`, from anywhere inside a path."""
    pattern = r"(?:^|/)year=(\d{4})/month=(\d{2})/day=(\d{2})/hour=(\d{2})/"
    return F.concat_ws("/", *[F.regexp_extract(path, pattern, i) for i in (1, 2, 3, 4)])


_FOUND = "blob_path string, blob_partition string, size bigint, is_dir boolean"


def _list_under(container: str, recursive: bool, suffix: str = SUFFIX):
    """Expand rows marked as directories, pass the others on."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(container)
        for batch in batches:
            files = batch.filter(pc.invert(batch.column("is_dir")))
            if files.num_rows:
                yield files.select(schema.names).cast(schema)
            for row in batch.filter(batch.column("is_dir")).to_pylist():
                selector = pafs.FileSelector(
                    join_path(root, row["blob_path"]), allow_not_found=True, recursive=recursive
                )
                # The file system's own listing is walked once; rows leave 10,000 at a time.
                infos = iter(filesystem.get_file_info(selector))
                while page := list(islice(infos, 10_000)):
                    kept = [
                        info for info in page if info.type == pafs.FileType.Directory or info.path.endswith(suffix)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([info.path[len(root) :].lstrip("/") for info in kept], pa.string()),
                            pa.array([row["blob_partition"]] * len(kept), pa.string()),
                            pa.array([info.size for info in kept], pa.int64()),
                            pa.array([info.type == pafs.FileType.Directory for info in kept], pa.bool_()),
                        ],
                        schema=schema,
                    )

    schema = pa.schema(
        [
            ("blob_path", pa.string()),
            ("blob_partition", pa.string()),
            ("size", pa.int64()),
            ("is_dir", pa.bool_()),
        ]
    )
    return expand


def list_archive(hours: DataFrame, container: str, folder: str = "") -> DataFrame:
    """Files of the given hours (`blob_partition`): path, hour, name and size.

    One task per hour lists its direct children; sub-folders are then dealt out
    to other tasks, so one crowded hour does not list alone.
    """
    container = qualified(hours.sparkSession, container)
    tasks = 4 * hours.sparkSession.sparkContext.defaultParallelism
    roots = hours.select(
        hour_prefix(F.col("blob_partition"), folder).alias("blob_path"),
        "blob_partition",
        F.lit(0).cast("bigint").alias("size"),
        F.lit(True).alias("is_dir"),
    )
    direct = roots.mapInArrow(lean(_list_under(container, recursive=False)), _FOUND)
    nested = direct.repartition(tasks, "blob_path").mapInArrow(
        lean(_list_under(container, recursive=True)), _FOUND
    )
    return nested.where(~F.col("is_dir")).select(
        "blob_path",
        "blob_partition",
        F.substring_index("blob_path", "/", -1).alias("file_name"),
        "size",
    )


def _count_breaks(container: str, split_schema: pa.Schema, chunk_bytes: int):
    """Per byte range: its line breaks, and whether the byte before it is one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(container)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                with filesystem.open_input_file(join_path(root, row["blob_path"])) as source:
                    row["after_break"] = (
                        row["start"] == 0 or source.read_at(1, row["start"] - 1) == b"\n"
                    )
                    row["breaks"] = sum(
                        source.read_at(min(chunk_bytes, row["end"] - at), at).count(b"\n")
                        for at in range(row["start"], row["end"], chunk_bytes)
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=split_schema)

    return count


def byte_ranges(files: DataFrame, container: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cut files into ranges `[start, end)`, each with the number of its first line.

    Files up to `split_bytes` are one range. Larger ones are cut, and their line
    breaks counted per range first; the counts are summed over the (few) ranges
    of a file, never over its lines.
    """
    container = qualified(files.sparkSession, container)
    small = (
        files.where(F.col("size") <= split_bytes)
        .withColumn("start", F.lit(0).cast("bigint"))
        .withColumn("end", F.col("size"))
        .withColumn("first_line", F.lit(1).cast("bigint"))
    )
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint"))
    large = files.where(F.col("size") > split_bytes)
    if large.isEmpty():
        return small
    cut = large.withColumn("start", F.explode(starts)).withColumn(
        "end", F.least(F.col("start") + split_bytes, F.col("size"))
    )
    counted_schema = pa.schema(
        [
            ("blob_path", pa.string()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("after_break", pa.bool_()),
            ("breaks", pa.int64()),
        ]
    )
    tasks = large.sparkSession.sparkContext.defaultParallelism * 4
    counted = (
        cut.select("blob_path", "start", "end")
        .repartition(tasks, "blob_path", "start")
        .mapInArrow(
            lean(_count_breaks(container, counted_schema, CHUNK_BYTES)),
            "blob_path string, start bigint, end bigint, after_break boolean, breaks bigint",
        )
    )
    earlier = Window.partitionBy("blob_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.select(
        "blob_path",
        "start",
        (
            F.coalesce(F.sum("breaks").over(earlier), F.lit(0))
            + F.when(F.col("after_break"), 1).otherwise(2)
        ).alias("first_line"),
    )
    return small.unionByName(cut.join(numbered, ["blob_path", "start"]))


def _line_chunks(
    source, start: int, end: int, first_line: int, chunk_bytes: int
) -> Iterator[tuple[int, bytes]]:
    """Whole-line chunks of the lines that begin in `[start, end)`."""
    size = source.size()
    at = start
    if start > 0:
        # A line that begins before the range belongs to the range before it.
        at = start - 1
        while at < size:
            block = source.read_at(min(chunk_bytes, size - at), at)
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(block)
    while at < min(end, size):
        block = source.read_at(min(chunk_bytes, size - at), at)
        if at + len(block) > end:
            cut = block.find(b"\n", max(end - at - 1, 0))
        elif at + len(block) == size:
            cut = len(block) - 1
        else:
            cut = block.rfind(b"\n")
        if cut < 0 and at + len(block) < size:
            # No break yet: the line goes on past this block.
            pieces = [block]
            rest = at + len(block)
            while rest < size:
                more = source.read_at(min(chunk_bytes, size - rest), rest)
                stop = more.find(b"\n")
                pieces.append(more if stop < 0 else more[: stop + 1])
                rest += len(pieces[-1])
                if stop >= 0:
                    break
            block = b"".join(pieces)
        elif cut >= 0:
            block = block[: cut + 1]
        yield first_line, block
        first_line += block.count(b"\n")
        at += len(block)


def read_ranges(
    ranges: DataFrame, container: str, keep: list[str], chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Text of the ranges as rows of whole lines (`first_line`, `content`).

    `keep` names columns passed through. Files are fetched a few at a time per
    task, as small files cost latency rather than bandwidth.
    """
    container = qualified(ranges.sparkSession, container)
    fields = [f for f in ranges.schema.fields if f.name in keep]
    out_spark = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    arrow_types = {"string": pa.string(), "bigint": pa.int64()}
    out_schema = pa.schema(
        [(f.name, arrow_types[f.dataType.simpleString()]) for f in fields]
        + [("first_line", pa.int64()), ("content", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(container)

        def to_batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=out_schema)

        def open_source(row: dict):
            return filesystem.open_input_file(join_path(root, row["blob_path"]))

        def whole(row: dict) -> dict:
            with open_source(row) as source:
                return {**row, "content": source.read()}

        with ThreadPoolExecutor(PARALLEL_READS) as pool:
            for names in (batch.slice(at, NAMES) for batch in batches for at in range(0, batch.num_rows, NAMES)):
                small: list[dict] = []
                pending = 0
                for row in names.to_pylist():
                    span = row["end"] - row["start"]
                    if row["start"] == 0 and row["end"] == row["size"] and span <= chunk_bytes:
                        if small and pending + span > GATHER_BYTES:
                            yield to_batch(list(pool.map(whole, small)))
                            small, pending = [], 0
                        small.append(row)
                        pending += span
                    else:
                        with open_source(row) as source:
                            for first_line, content in _line_chunks(
                                source, row["start"], row["end"], row["first_line"], chunk_bytes
                            ):
                                yield to_batch([{**row, "first_line": first_line, "content": content}])
                if small:
                    yield to_batch(list(pool.map(whole, small)))

    return ranges.mapInArrow(lean(read), f"{out_spark}, first_line bigint, content binary")


def with_names(paths: DataFrame) -> DataFrame:
    """Listing columns for rows that only have `blob_path` and `size`."""
    return paths.select(
        "blob_path",
        partition_of_path(F.col("blob_path")).alias("blob_partition"),
        F.substring_index("blob_path", "/", -1).alias("file_name"),
        "size",
    )


def with_hour(files: DataFrame) -> DataFrame:
    return files.withColumn("blob_hour", partition_to_hour(F.col("blob_partition")))


def list_stored(events_root: str, dirs: DataFrame) -> DataFrame:
    """Parquet files under directories (`run_id`, `blob_hour`), with keys and size."""
    events_root = qualified(dirs.sparkSession, events_root)
    tasks = 4 * dirs.sparkSession.sparkContext.defaultParallelism
    roots = dirs.select(
        F.concat(F.lit("run_id="), "run_id", F.lit("/blob_hour="), "blob_hour").alias("blob_path"),
        F.lit("").alias("blob_partition"),
        F.lit(0).cast("bigint").alias("size"),
        F.lit(True).alias("is_dir"),
    ).repartition(tasks, "blob_path")
    found = roots.mapInArrow(lean(_list_under(events_root, recursive=True, suffix=".parquet")), _FOUND)
    path, pattern = F.col("blob_path"), r"run_id=([^/]+)/blob_hour=([^/]+)/group_no=(\d+)/"
    return found.where(~F.col("is_dir")).select(
        F.regexp_extract(path, pattern, 2).alias("blob_hour"),
        F.regexp_extract(path, pattern, 1).alias("run_id"),
        F.regexp_extract(path, pattern, 3).cast("bigint").alias("group_no"),
        path.alias("file_path"),
        "size",
    )
