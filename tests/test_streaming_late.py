from __future__ import annotations

from datetime import datetime, timezone

from conftest import line, put

from hourvault.streaming.incremental import _HourReader


def test_a_running_stream_lists_old_hours_again_each_day(container):
    put(container, "2026/09/01/03", "a.jsonl", line())
    at = lambda *t: int(datetime(2026, 9, *t, tzinfo=timezone.utc).timestamp())
    options = {"container": container, "folder": "audit", "first": str(at(2)), "again": "24"}
    for fixed, first in (("false", at(1, 3)), ("true", at(2))):
        reader = _HourReader(options | {"fixed": fixed})
        reader.born = 0
        start, same, next_day = ({"hour": h, "seen": s} for h, s in ((at(8), at(8, 5)), (at(8), at(8, 6)), (at(9), at(9) + 60)))
        assert reader.partitions(start, same)[0].first == at(7)
        assert reader.partitions(start, next_day)[0].first == first
