"""Written tables: what is left on disk when they are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourvault.llm import stored
from hourvault.llm.worker import lean

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_written_tables_outlive_their_shuffles_and_the_setting_is_put_back(spark):
    before = spark.conf.get(CLEANUP)
    made = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(map(tuple, stored.written(made, "t").collect())) == sorted(map(tuple, made.collect()))
    again = stored.written(made, "t")  # the shuffle of the first write is gone, and is made again
    assert again.count() == 7 and spark.conf.get(CLEANUP) == before


def test_lean_functions_give_the_same_batches(spark):
    rows = spark.range(100).mapInArrow(lean(lambda batches: (b for b in batches)), "id long")
    assert sorted(r.id for r in rows.collect()) == list(range(100))
