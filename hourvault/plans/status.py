"""Cache status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourvault.operators.cached import status_row
from hourvault.plans.sync import data_files
from hourvault.sources.cache import HourBounds, manifest_current, read_manifest


def cache_status(spark: SparkSession, root: str, bounds: HourBounds | None = None) -> DataFrame:
    return status_row(
        manifest_current(read_manifest(spark, root, bounds)), data_files(spark, root, bounds)
    )
