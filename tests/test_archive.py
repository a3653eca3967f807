from __future__ import annotations

import random
from datetime import datetime

import pyarrow as pa
import pytest
from conftest import put
from pyspark.sql import functions as F

from hourvault.functions.hours import hours_frame
from hourvault.operators.ingest import to_events
from hourvault.sources import archive
from workload import write_files

HOUR = "2026/09/10/08"
SPAN = (datetime(2026, 9, 10, 8), datetime(2026, 9, 10, 10))


def listed(spark, container, folder="audit"):
    rows = archive.list_archive(hours_frame(spark, *SPAN), container, folder).orderBy("blob_path").collect()
    return [tuple(r) for r in rows]


def test_listing(spark, container):
    put(container, HOUR, "b.ndjson", "xx\n")
    put(container, HOUR, "a b+c.ndjson", "x")
    put(container, HOUR, "empty.ndjson", "")
    put(container, HOUR, "sub/deep/c.ndjson", "xyz")
    put(container, HOUR, "note.txt", "x")
    put(container, HOUR, "events.json", "x")
    put(container, "2026/09/10/09", "b.ndjson", "x")
    put(container, "2026/09/10/10", "out.ndjson", "x")
    base = "audit/year=2026/month=09/day=10/hour=08/"
    assert listed(spark, container) == [
        (base + "a b+c.ndjson", HOUR, "a b+c.ndjson", 1),
        (base + "b.ndjson", HOUR, "b.ndjson", 3),
        (base + "empty.ndjson", HOUR, "empty.ndjson", 0),
        (base + "sub/deep/c.ndjson", HOUR, "c.ndjson", 3),
        ("audit/year=2026/month=09/day=10/hour=09/b.ndjson", "2026/09/10/09", "b.ndjson", 1),
    ]


def test_listing_without_folder_or_files(spark, container):
    assert listed(spark, container, "") == []
    put(container, HOUR, "a.ndjson", "x", folder="")
    assert [r[0] for r in listed(spark, container, "")] == ["year=2026/month=09/day=10/hour=08/a.ndjson"]


@pytest.mark.parametrize(
    ("folder", "key", "expected"),
    [
        ("audit", "2026/09/09/08", "audit/year=2026/month=09/day=09/hour=08"),
        ("/a/b/", "/2026/09/09/08/", "a/b/year=2026/month=09/day=09/hour=08"),
        ("", "2026/09/09/08", "year=2026/month=09/day=09/hour=08"),
    ],
)
def test_hour_prefix_and_back(spark, folder, key, expected):
    row = spark.range(1).select(archive.hour_prefix(F.lit(key), folder).alias("p"))
    row = row.select("p", archive.partition_of_path(F.concat("p", F.lit("/f.ndjson"))).alias("k")).head()
    assert row.p == expected
    assert row.k == key.strip("/")


def test_container_as_uri(spark, container):
    put(container, HOUR, "a.ndjson", "x")
    assert len(listed(spark, "file://" + container)) == 1
    assert len(listed(spark, "file:" + container + "/")) == 1


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 1000, 10**6])
@pytest.mark.parametrize("chunk_bytes", [5, 50, 8 * 1024 * 1024])
def test_split_files_keep_every_line_and_number(spark, container, split_bytes, chunk_bytes):
    if split_bytes == 1 and chunk_bytes != 50:
        pytest.skip("one combination of the smallest split is enough")
    rng = random.Random(split_bytes)
    contents = {
        "a.ndjson": "\n".join('{"event_id":"%s"}' % ("x" * rng.randint(0, 60)) for _ in range(40)),
        "b.ndjson": "\n\n\n" + "\n".join('{"event_id":"%d"}\r' % i for i in range(20)) + "\n\n",
        "c.ndjson": '{"event_id":"%s"}' % ("y" * 300),
        "d.ndjson": "\n",
        "e.ndjson": "",
    }
    if split_bytes == 1:
        contents = {"b.ndjson": contents["b.ndjson"][:60], "c.ndjson": contents["c.ndjson"][:40]}
    for name, content in contents.items():
        put(container, HOUR, name, content)
    files = archive.list_archive(hours_frame(spark, *SPAN), container, "audit").where("size > 0")
    ranges = archive.byte_ranges(files, container, split_bytes)
    keep = ["blob_path", "blob_partition", "file_name"]
    events = to_events(archive.read_ranges(ranges, container, keep, chunk_bytes))
    got = sorted((r.blob_name, r.source_line, r.raw_json) for r in events.collect())
    want = sorted(
        (name, number, text.rstrip("\r"))
        for name, content in contents.items()
        for number, text in enumerate(content.split("\n"), start=1)
        if text.strip()
    )
    assert got == want


def test_line_chunks_directly():
    """All ranges and chunk lengths over small texts, without Spark."""
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(400):
        text = b"".join(rng.choice([b"\n", b"a", b"bc", b"\r"]) for _ in range(rng.randint(1, 25)))
        split, length = rng.randint(1, 9), rng.randint(1, 9)
        source = pa.BufferReader(text)
        got, number = [], 1
        for start in range(0, len(text), split):
            end = min(start + split, len(text))
            after_break = start == 0 or text[start - 1 : start] == b"\n"
            first = text[:start].count(b"\n") + (1 if after_break else 2)
            for first_line, block in archive._line_chunks(source, start, end, first, length):
                pieces = block.split(b"\n")
                if block.endswith(b"\n"):
                    pieces.pop()
                got += [(first_line + i, piece) for i, piece in enumerate(pieces)]
        want = text.split(b"\n")
        if text.endswith(b"\n"):
            want.pop()
        assert got == list(enumerate(want, start=1)), (text, split, length)


def test_reading_task_gathers_little_at_once(spark, container, monkeypatch):
    """Small files leave a task about a megabyte at a time, and each of them whole."""
    content = {f"{i:02d}.ndjson": f"{i}{'x' * 100_000}\n".encode() for i in range(40)}
    paths = [put(container, "2026/09/10/08", name, text) for name, text in content.items()]
    sizes = [len(text) for text in content.values()]
    rows = [{"blob_path": p, "start": 0, "end": n, "size": n, "first_line": 1} for p, n in zip(paths, sizes, strict=True)]
    frame = spark.createDataFrame(rows)
    tasks = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, task, schema: tasks.append(task))
    archive.read_ranges(frame, container, ["blob_path"])
    batches = list(tasks[0](iter([pa.RecordBatch.from_pylist(rows)])))
    found = {row["blob_path"].rpartition("/")[2]: row["content"] for batch in batches for row in batch.to_pylist()}
    assert found == content
    assert max(batch.nbytes for batch in batches) < 1_200_000


def test_files_are_written_from_small_batches(spark, container, tmp_path, monkeypatch):
    """A writing task meets at most some hundred files at once, as they travel with their content."""
    seen = str(tmp_path / "rows")
    files = spark.range(1200).coalesce(1).select(F.format_string("a/%d.ndjson", "id").alias("blob_path"), F.format_string("é%d\n", "id").alias("content"))
    real = type(files).mapInArrow

    def spied(self, task, schema):
        def run(batches):
            def noted():
                for batch in batches:
                    with open(seen, "a") as out:
                        out.write(f"{batch.num_rows}\n")
                    yield batch

            return task(noted())

        return real(self, run, schema)

    monkeypatch.setattr(type(files), "mapInArrow", spied)
    assert write_files(files, container) == 1200
    rows = [int(n) for n in open(seen)]
    assert sum(rows) == 1200 and max(rows) <= 500
    assert open(f"{container}/a/1199.ndjson").read() == "é1199\n"


def test_files_pass_a_listing_task_in_batches(container):
    """Rows that are files already leave as they came, not one at a time as Python objects; folders are listed."""
    paths = [put(container, HOUR, f"part/{i}.ndjson", "x\n") for i in range(3)]
    folder = paths[0].rpartition("/")[0]
    rows = [{"blob_path": f"{i:04d}.ndjson", "blob_partition": HOUR, "size": i, "is_dir": False} for i in range(1000)]
    rows.insert(500, {"blob_path": folder, "blob_partition": HOUR, "size": 0, "is_dir": True})
    found = list(archive._list_under(container, recursive=True)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(found) <= 2
    got = [row for batch in found for row in batch.to_pylist()]
    want = [r for r in rows if not r["is_dir"]] + [{"blob_path": p, "blob_partition": HOUR, "size": 2, "is_dir": False} for p in paths]
    assert sorted(got, key=lambda r: r["blob_path"]) == sorted(want, key=lambda r: r["blob_path"])
