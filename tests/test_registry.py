from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, connection, name):
    passed, text = check.compare(spark, connection, name, SF)
    assert passed, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
