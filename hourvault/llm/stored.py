"""Written intermediate tables and files in the folder the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from hourvault.session import scratch_path
from hourvault.sources.storage import remove

#: Tables this process has written and not cleaned yet.
_TABLES: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _TABLES.append(path)
    with _shuffles_end(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it has ended: its table takes their place."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def clean(spark: SparkSession) -> int:
    """Remove the tables `written` so far; their number.

    Results are read from them lazily: call it once all results are stored.
    """
    n = len(_TABLES)
    while _TABLES:
        remove(spark, _TABLES.pop())
    return n


def small_transfers(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Rows and bytes that travel to a Python worker at once: both ends hold a batch several times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attempt_name(prefix: str) -> str:
    """A file name that no other attempt of this task uses; only names in the committed table count."""
    return f"{prefix}-{uuid.uuid4().hex}"
