"""File-system access: pyarrow inside tasks, Spark's Hadoop layer on the driver.

The driver side only sees things counted in hours and runs, never files.
"""

from __future__ import annotations

from urllib.parse import urlparse

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def open_storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a container; used inside tasks."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        path = uri[len("file:") :] if scheme else uri
        return pafs.LocalFileSystem(), "/" + path.strip("/")
    if scheme in ("s3a", "s3n"):  # Spark's names for it
        uri = "s3" + uri[3:]
    filesystem, path = pafs.FileSystem.from_uri(uri)
    return filesystem, path.rstrip("/")


def join_path(*parts: str) -> str:
    head, *tail = [p for p in parts if p]
    return "/".join([head.rstrip("/"), *[p.strip("/") for p in tail]])


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the driver's Hadoop layer resolves it.

    In a task a path without a scheme would be the task's local disk.
    """
    filesystem, jvm_path = _hadoop(spark, path)
    return filesystem.makeQualified(jvm_path).toString()


def child_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names matching a glob; for directories counted in hours or runs."""
    filesystem, path = _hadoop(spark, pattern)
    found = filesystem.globStatus(path)
    return sorted(status.getPath().getName() for status in found) if found else []


def parent_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the directories that hold what matches a glob; for directories counted in hours or runs."""
    filesystem, path = _hadoop(spark, pattern)
    found = filesystem.globStatus(path)
    return sorted({status.getPath().getParent().getName() for status in found}) if found else []


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, jvm_path = _hadoop(spark, path)
    return filesystem.exists(jvm_path)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    filesystem, jvm_path = _hadoop(spark, path)
    filesystem.create(jvm_path).close()


def remove(spark: SparkSession, path: str) -> bool:
    filesystem, jvm_path = _hadoop(spark, path)
    return filesystem.delete(jvm_path, True)
