"""Incremental sync as a Structured Streaming job.

A source of its own finds files: its offsets are hours, and each micro-batch
lists, in tasks, the hours that are new and those that may still receive files.
It sees what a batch sync of these hours sees, by exact paths: nothing outside
`<folder>/year=../month=../day=../hour=../`, and everything in it. Each
micro-batch then goes through the same run as a batch sync, and the manifest
alone decides what is missing, so hours listed again and replayed batches add
nothing. The driver and the checkpoint hold hours, never files.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from hourvault.functions.hours import as_utc
from hourvault.plans.sync import sync_listing
from hourvault.session import pin
from hourvault.sources import archive
from hourvault.sources.storage import child_names, join_path, open_storage, qualified

_LISTING = "blob_path string, blob_partition string, file_name string, size bigint"
_HOUR = 3600
_DAY = 24 * _HOUR


class _Day(InputPartition):
    """Some hours of one day, as seconds since 1970."""

    def __init__(self, first: int, end: int):
        super().__init__(None)
        self.first, self.end = first, end


class _HourReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.container, self.folder = options["container"], options["folder"]
        self.first, self.again = int(options["first"]), int(options["again"])
        self.until = int(options["until"]) if options.get("until") else None
        self.fixed = options.get("fixed") == "true"
        self.born = int(time.time())

    def initialOffset(self) -> dict:
        return {"hour": self.first, "seen": 0}

    def latestOffset(self) -> dict:
        now = int(time.time())
        end = now - now % _HOUR + _HOUR
        # `seen` moves on within an hour too, as the hour still receives files.
        return {"hour": max(self.first, min(end, self.until) if self.until else end), "seen": now}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # Files may have come to any hour while the stream was down, and do so, if rarely, while it runs.
        if start["seen"] < self.born or start["seen"] // _DAY != end["seen"] // _DAY:
            at = self.first if self.fixed else min(self.first, self._earliest())
        else:
            at = max(self.first, start["hour"] - self.again * _HOUR)
        days = []
        while at < end["hour"]:
            stop = min(at - at % (24 * _HOUR) + 24 * _HOUR, end["hour"])
            days.append(_Day(at, stop))
            at = stop
        return days

    def _earliest(self) -> int:
        """The hour, or the start of the day, month or year, of the archive's first folder now."""
        filesystem, root = open_storage(self.container)
        path, found = join_path(root, self.folder) if self.folder else root, []
        for level in ("year", "month", "day", "hour"):
            infos = filesystem.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            names = [i.base_name for i in infos if i.type == pafs.FileType.Directory]
            values = sorted(n.partition("=")[2] for n in names if n.startswith(f"{level}=") and n.partition("=")[2].isdigit())
            if not values:
                break
            found.append(values[0])
            path = join_path(path, f"{level}={values[0]}")
        if not found:
            return self.first
        year, month, day, hour = [*map(int, found), *(1, 1, 1, 0)[len(found) :]]
        return int(datetime(year, month, day, hour, tzinfo=timezone.utc).timestamp())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        filesystem, root = open_storage(self.container)
        at = datetime.fromtimestamp(partition.first, timezone.utc)
        day = join_path(self.folder, f"year={at:%Y}", f"month={at:%m}", f"day={at:%d}")
        if filesystem.get_file_info(join_path(root, day)).type != pafs.FileType.Directory:
            return
        for hour in range(partition.first, partition.end, _HOUR):
            at = datetime.fromtimestamp(hour, timezone.utc)
            selector = pafs.FileSelector(join_path(root, day, f"hour={at:%H}"), allow_not_found=True, recursive=True)
            infos = iter(filesystem.get_file_info(selector))
            while page := list(islice(infos, 10_000)):
                files = [i for i in page if i.type == pafs.FileType.File and i.path.endswith(archive.SUFFIX)]
                if files:
                    paths = [i.path[len(root) :].lstrip("/") for i in files]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(paths), pa.array([f"{at:%Y/%m/%d/%H}"] * len(files)),
                            pa.array([p.rpartition("/")[2] for p in paths]), pa.array([i.size for i in files], pa.int64()),
                        ],
                        ["blob_path", "blob_partition", "file_name", "size"],
                    )


class ArchiveHours(DataSource):
    """Stream of the files in the hours of an archive."""

    @classmethod
    def name(cls) -> str:
        return "archive_hours"

    def schema(self) -> str:
        return _LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _HourReader(dict(self.options))


def _first_hour(spark: SparkSession, container: str, folder: str) -> datetime:
    """The archive's earliest hour, from its folder names; this hour if it has none."""
    path = join_path(container, folder) if folder else container
    found = []
    for level in ("year", "month", "day", "hour"):
        names = child_names(spark, join_path(path, f"{level}=*"))
        values = sorted(n.partition("=")[2] for n in names if n.partition("=")[2].isdigit())
        if not values:
            break
        found.append(values[0])
        path = join_path(path, f"{level}={values[0]}")
    if not found:
        return datetime.now(timezone.utc)
    year, month, day, hour = [*map(int, found), *(1, 1, 1, 0)[len(found) :]]
    return datetime(year, month, day, hour, tzinfo=timezone.utc)


def new_files(
    spark: SparkSession,
    container: str,
    folder: str = "",
    from_utc: datetime | None = None,
    to_utc: datetime | None = None,
    again_hours: int = 24,
) -> DataFrame:
    """Stream of archive files as listing rows, from an hour on (default: the archive's first).

    The first micro-batch after a start lists all of these hours; each later one
    its own, and the `again_hours` before them, for files that arrive late. The
    first one of each UTC day lists all hours again, without `from_utc` also those
    before the hour that was first at the start.
    """
    spark.dataSource.register(ArchiveHours)
    container, folder = qualified(spark, container), folder.strip("/")
    first = int(as_utc(from_utc or _first_hour(spark, container, folder)).timestamp())
    options = {"container": container, "folder": folder, "first": str(first - first % _HOUR), "again": str(again_hours)}
    options["fixed"] = "true" if from_utc else "false"
    if to_utc is not None:
        hours = -((datetime(1970, 1, 1, tzinfo=timezone.utc) - as_utc(to_utc)) // timedelta(hours=1))
        options["until"] = str(hours * _HOUR)
    return spark.readStream.format("archive_hours").options(**options).load()


def sync_stream(
    spark: SparkSession,
    container: str,
    root: str,
    checkpoint: str,
    *,
    folder: str = "",
    from_utc: datetime | None = None,
    to_utc: datetime | None = None,
    again_hours: int = 24,
    available_now: bool = True,
    interval: str = "1 minute",
    **options,
) -> StreamingQuery:
    """Start the stream; with `available_now` it ends when all files are in.

    Options are those of `sync_listing`.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        listing = pin(batch)
        span = listing.agg(
            F.min("blob_partition").alias("first"), F.max("blob_partition").alias("last")
        ).head()
        if span["first"] is None:
            return
        bounds = (span["first"].replace("/", "-"), span["last"].replace("/", "-"))
        sync_listing(spark, container, root, listing, bounds, **options)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        new_files(spark, container, folder, from_utc, to_utc, again_hours)
        .writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
