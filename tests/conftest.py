from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hourvault.session import build_session, scratch_path  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def container(spark, tmp_path):
    return str(tmp_path / "container")


@pytest.fixture
def root(spark):
    return scratch_path(spark, "test-cache")


def event(event_id="e1", timestamp="2026-09-10T08:30:00Z", **extra) -> dict:
    base = {
        "event_id": event_id,
        "timestamp": timestamp,
        "application": "billing",
        "event": {"name": "LOGIN", "category": "AUTH"},
        "actor": {"user_id": "u1", "organization_id": "o1", "roles": ["admin"]},
    }
    return {**base, **extra}


def line(*args, **kwargs) -> str:
    return json.dumps(event(*args, **kwargs))


def put(container: str, hour: str, name: str, content: str | bytes, folder: str = "audit") -> str:
    """Write one archive file; its path inside the container."""
    year, month, day, part = hour.split("/")
    parts = [folder] if folder else []
    path = "/".join([*parts, f"year={year}/month={month}/day={day}/hour={part}", name])
    target = Path(container) / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path
