from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourvault.functions import display


def value(spark, column):
    return spark.range(1).select(column).head()[0]


@pytest.mark.parametrize(
    ("text", "length", "expected"),
    [
        (None, 20, "-"), ("", 20, "-"), ("AUDIT_LOG", 20, "AUDIT_LOG"), ("x" * 20, 20, "x" * 20),
        ("VERY_LONG_EVENT_NAME_THAT_SHOULD_BE_SHORTENED", 20, "VERY_LONG_EVENT_NAM…"), ("абвгдежзийк", 10, "абвгдежзи…"),
    ],
)
def test_shorten(spark, text, length, expected):
    assert value(spark, display.shorten(F.lit(text).cast("string"), length)) == expected


@pytest.mark.parametrize(
    ("size", "expected"),
    [
        (0, "0.0 B"), (512, "512.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1024**2, "1.0 MB"),
        (1024**3, "1.0 GB"), (1024**4, "1.0 TB"), (1024**5, "1.0 PB"), (1024**6, "1024.0 PB"), (1280, "1.2 KB"), (1792, "1.8 KB"),
    ],
)
def test_format_size(spark, size, expected):
    assert value(spark, display.format_size(F.lit(size).cast("bigint"))) == expected
    assert f"{size / 1024 ** min(5, (size.bit_length() - 1) // 10 if size else 0):.1f}" == expected.split()[0]


def test_result_table(spark):
    row = spark.createDataFrame(
        [("e", "", None, "n" * 30, "c" * 11, datetime(2026, 9, 9, 8, 30, 0, 999999), 5)],
        "event_id string, user_id string, organization_id string, event_name string, category string, timestamp timestamp, source_line long",
    )
    assert tuple(display.result_table(row).head()) == ("e", "-", "-", "n" * 19 + "…", "c" * 9 + "…", "2026-09-09 08:30:00")


def test_source_label(spark):
    assert value(spark, display.source_label(F.lit("2026/09/09/08"), F.lit("a.ndjson"))) == "2026/09/09/08/a.ndjson"
