"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes up to which a small side may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app_name: str = "hourvault", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the package relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Lets a per-search top-n up to the largest allowed limit drop rows before the shuffle.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    # Directory listing of many hours: as many tasks as there are cores to run them.
    spark.conf.set(
        "spark.sql.sources.parallelPartitionDiscovery.parallelism",
        str(max(32, 4 * spark.sparkContext.defaultParallelism)),
    )
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session without one (a test) gets a temporary folder; on a
    cluster that would be a folder of one machine, so it is refused.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors reach")
            current = tempfile.mkdtemp(prefix="hourvault-")
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run meanwhile."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def open_writers(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Let each task keep up to `most` output files open, instead of sorting its rows by their file first.

    A task that meets more files than that sorts the rest of its rows.
    """
    return _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(most)})


def small_batches(spark: SparkSession, rows: int, size: str) -> AbstractContextManager[None]:
    """Let no more than so many rows, or about so many bytes, travel to a Python worker at once."""
    return _settings(
        spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: its texts and binaries, and 16 for each column."""
    total = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    return total


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """Broadcast hint only after rows and bytes of the side are known; (frame, was it hinted).

    Pass a frame that is cheap to read twice: a pinned one or a small table.
    """
    size = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum(_row_bytes(df)).alias("bytes")).head()
    if size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes:
        return F.broadcast(df), True
    return df, False
