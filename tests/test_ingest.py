from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hourvault.operators import ingest


def parse(spark, *lines, **options):
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(lines)], "n int, raw_json string")
    return ingest.parse_lines(frame, **options).orderBy("n").collect()


def chunk(spark, content: bytes, first_line: int = 1):
    return spark.createDataFrame(
        [("a/f.ndjson", "2026/09/10/08", "f.ndjson", first_line, bytearray(content))],
        "blob_path string, blob_partition string, file_name string, first_line long, content binary",
    )


def test_nested_fields_win_over_fallbacks(spark):
    (row,) = parse(
        spark,
        '{"event_id":"a","event":{"name":"N","category":"C"},"event_name":"x","category":"y",'
        '"actor":{"user_id":"u","organization_id":"o"},"attributes":{"user_id":"p","organization_id":"q"}}',
    )
    assert (row.event_name, row.category, row.user_id, row.organization_id) == ("N", "C", "u", "o")


def test_fallbacks_when_nested_is_absent_null_or_not_an_object(spark):
    rows = parse(
        spark,
        '{"event_name":"N","category":"C","attributes":{"user_id":"u","organization_id":"o"}}',
        '{"event":null,"event_name":"N","category":"C","actor":null,"attributes":{"user_id":"u","organization_id":"o"}}',
        '{"event":"x","event_name":"N","category":"C","actor":[1],"attributes":{"user_id":"u","organization_id":"o"}}',
    )
    for row in rows:
        assert (row.event_name, row.category, row.user_id, row.organization_id) == ("N", "C", "u", "o")


def test_missing_actor_gives_null(spark):
    (row,) = parse(spark, '{"event_id":"a"}')
    assert row.bad_reason is None
    assert row.user_id is None and row.organization_id is None and row.event_name is None


def test_empty_text_is_a_value_unless_asked(spark):
    text = '{"event":{"name":""},"event_name":"N"}'
    assert parse(spark, text)[0].event_name == ""
    assert parse(spark, text, empty_as_missing=True)[0].event_name == "N"


def test_scalars_become_json_text(spark):
    (row,) = parse(
        spark, '{"event_id":7,"application":1.0,"actor":{"user_id":12345678901234567890123,"organization_id":true}}'
    )
    assert (row.event_id, row.application, row.user_id, row.organization_id) == (
        "7", "1.0", "12345678901234567890123", "true",
    )


@pytest.mark.parametrize(
    "text",
    [
        "{no colon here}", '["not","an","object"]', "null", "1", '"text"', '{"event_id":"a"}{"event_id":"b"}',
        '{"event_id":"a"} {"event_id":"b"}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '{"a":1},"x":{"b":1}',
        '{"a":NaN}', "{'a':1}", "{a:1}", '{"a":1} // note', '{"a":1}}', '{"a":1}]', '{"a":[1,{"b":[', '{"a":01}',
        '{"a":"\t"}', '{"a":1}],[{"a":2},', '{"event_id":"a",}',
    ],
)
def test_lines_that_are_not_one_object_are_refused(spark, text):
    (row,) = parse(spark, text)
    assert row.bad_reason == ingest.BAD_JSON
    assert row.event_id is None


@pytest.mark.parametrize("value", ['"invalid"', "123", "20260909", '"2026-W54-1"', '"2026-W37-8"', "true", '{"a":1}', '"2026-02-30T00:00:00Z"'])
def test_timestamps_that_are_not_iso_text_are_refused(spark, value):
    (row,) = parse(spark, '{"event_id":"a","timestamp":' + value + "}")
    assert row.bad_reason == ingest.BAD_TIME
    assert row.event_id is None and row.timestamp is None


def test_missing_timestamp_keeps_the_row(spark):
    for row in parse(spark, '{"event_id":"a"}', '{"event_id":"a","timestamp":null}'):
        assert row.bad_reason is None and row.event_id == "a" and row.timestamp is None


@pytest.mark.parametrize(
    "text",
    [
        "2026-09-09T08:30:00Z", "2026-09-09T08:30:00", "2026-09-09T11:30:00+03:00", "2026-09-09 11:30:00+0300",
        "2026-09-09T05:30:00-03", " 2026-09-09T08:30:00Z ", "2026-09-09T08:30Z", "20260909T083000Z", "20260909T0830",
        "2026-09-09T08:30:00.000000999Z", "2026-09-09T08:30:00,0", "20260909T113000+0300",
        "2026-W37-3T08:30:00Z", "2026W373T0830",
    ],
)
def test_equal_instants(spark, text):
    (row,) = parse(spark, '{"timestamp":"' + text + '"}')
    assert row.timestamp == datetime(2026, 9, 9, 8, 30)


@pytest.mark.parametrize("text", ["20260907", "2026-W37", "2026W37", "2026-W37-1", "2026-09-07"])
def test_dates(spark, text):
    (row,) = parse(spark, '{"timestamp":"' + text + '"}')
    assert row.timestamp == datetime(2026, 9, 7)


def test_time_does_not_depend_on_the_session_zone(spark):
    frame = spark.createDataFrame([('{"timestamp":"2026-09-09T08:30:00"}',)], "raw_json string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        micros = ingest.parse_lines(frame).select(F.unix_micros("timestamp")).head()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert micros == 1788942600 * 1_000_000


def test_blank_lines_are_counted_and_dropped(spark):
    content = b'\n{"event_id":"a"}\n \t\r\n{"event_id":"b"}\r\n\x0b\n'
    rows = ingest.to_events(chunk(spark, content)).orderBy("source_line").collect()
    assert [(r.event_id, r.source_line) for r in rows] == [("a", 2), ("b", 4)]
    assert rows[1].raw_json == '{"event_id":"b"}'
    assert (rows[0].blob_partition, rows[0].blob_name, rows[0].blob_path) == (
        "2026/09/10/08", "f.ndjson", "a/f.ndjson",
    )


def test_lone_carriage_return_does_not_split(spark):
    rows = ingest.to_events(chunk(spark, b'{"event_id":"a"}\r{"event_id":"b"}\n{"event_id":"c"}')).collect()
    assert sorted((r.source_line, r.bad_reason) for r in rows) == [(1, ingest.BAD_JSON), (2, None)]


def test_invalid_utf8_is_refused(spark):
    rows = ingest.to_events(chunk(spark, b'{"event_id":"\xff"}\n{"event_id":"\xc3\xa9"}')).orderBy("source_line").collect()
    assert [r.bad_reason for r in rows] == [ingest.BAD_JSON, None]
    assert rows[1].event_id == "é"


def test_bad_line_does_not_change_its_neighbours(spark):
    good = '{"event":{"name":""},"event_name":"N","event_id":5}'
    alone = parse(spark, good)[0]
    beside = parse(spark, "{", good, "[]")[1]
    assert alone[2:] == beside[2:]


def test_quarantine_and_failfast(spark):
    parsed = ingest.to_events(chunk(spark, b'{"event_id":"a"}\n{x\n{"timestamp":"no"}\n')).persist()
    assert [tuple(r) for r in ingest.quarantine(parsed).orderBy("source_line").collect()] == [
        ("a/f.ndjson", "2026/09/10/08", 2, "{x", ingest.BAD_JSON),
        ("a/f.ndjson", "2026/09/10/08", 3, '{"timestamp":"no"}', ingest.BAD_TIME),
    ]
    assert ingest.good_events(parsed).count() == 1
    with pytest.raises(ingest.MalformedLineError, match="a/f.ndjson at line 2"):
        ingest.raise_on_malformed(parsed)
    parsed.unpersist()


def test_no_python_on_the_parse_path(spark, capsys):
    ingest.to_events(chunk(spark, b"{}")).explain()
    assert "Python" not in capsys.readouterr().out
