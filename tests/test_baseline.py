"""Error counts against what came before, in plain Python."""

import random
import statistics
from datetime import datetime, timedelta

import pytest

from logscope.operators.histogram import error_baseline

STEP = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}
SHOWN = {"minute": "%Y-%m-%d %H:%M", "hour": "%Y-%m-%d %H", "day": "%Y-%m-%d"}


def expected(times, grain, window, factor):
    """(bucket, count, median, deviation, anomaly) of (time, wrong) rows."""
    cut = {"minute": {"second": 0}, "hour": {"minute": 0, "second": 0}, "day": {"hour": 0, "minute": 0, "second": 0}}[grain]
    at = [t.replace(**cut) for t, _ in times]
    counts, out = [], []
    bucket = min(at)
    while bucket <= max(at):
        n = sum(wrong for a, (_, wrong) in zip(at, times) if a == bucket)
        before = counts[-window:]
        median = float(statistics.median(before)) if before else None
        deviation = max(1.0, 1.4826 * statistics.median([abs(x - median) for x in before])) if before else None
        out.append((bucket.strftime(SHOWN[grain]), n, median, deviation, n - median > factor * deviation if before else None))
        counts.append(n)
        bucket += STEP[grain]
    return out


@pytest.mark.parametrize("grain, window, factor", [("hour", 6, 2.0), ("day", 3, 1.0), ("minute", 30, 3.0)])
def test_against_plain_python(lines, grain, window, factor):
    rng = random.Random(window)
    rows, want = [], {}
    for file in ("a", "b"):
        start = datetime(2024, 2, 27, 22, 30)
        spread = {"hour": 60 * 60 * 40, "day": 60 * 60 * 24 * 20, "minute": 60 * 90}[grain]
        times = [(start + timedelta(seconds=rng.randrange(spread)), rng.random() < 0.4) for _ in range(80)]
        times += [(start + timedelta(seconds=spread // 2 + i % 50), True) for i in range(40)]
        rows += [(file, i, f"{t:%Y-%m-%d %H:%M:%S} {'ERROR' if wrong else 'INFO'} x") for i, (t, wrong) in enumerate(times)]
        rows += [(file, 500, "an error without a time"), (file, 501, "2024-99-99 00:00:00 ERROR unreadable"), (file, 502, "03/01/2024 00:00:00 ERROR of another form")]
        want[file] = expected(times, grain, window, factor)
    found = {}
    for r in error_baseline(lines(rows), grain, window, factor, 2024).collect():
        found.setdefault(r.file, []).append((r.bucket, r["count"], r.median, None if r.deviation is None else round(r.deviation, 9), r.anomaly))
    for file, rows in want.items():
        assert found[file] == [(b, n, m, None if d is None else round(d, 9), a) for b, n, m, d, a in rows]
        assert any(a for *_, a in rows) and any(n == 0 for _, n, *_ in rows)


def test_months_and_one_bucket(lines):
    months = error_baseline(lines("2024-01-31 00:00:00 error", "2024-04-01 00:00:00 error"), "month", 2, 1.0).collect()
    assert [(r.bucket, r["count"]) for r in months] == [("2024-01", 1), ("2024-02", 0), ("2024-03", 0), ("2024-04", 1)]
    only = error_baseline(lines("2024-01-31 00:00:00 error")).collect()
    assert [(r.bucket, r["count"], r.median, r.anomaly) for r in only] == [("2024-01-31 00", 1, None, None)]
    assert error_baseline(lines("no time")).collect() == []


def test_a_stray_time_far_off(lines):
    """A mistyped year makes many empty buckets, not an error."""
    rows = error_baseline(lines("2024-01-01 00:00:00 error", "2924-01-01 00:00:00 error"), "hour")
    assert rows.count() == (datetime(2924, 1, 1) - datetime(2024, 1, 1)).days * 24 + 1
