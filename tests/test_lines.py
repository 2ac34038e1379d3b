"""Per-line functions and filters on edge inputs."""

import pytest
from pyspark.sql import functions as F

from logscope.frame import LogFrame
from logscope.functions.messages import with_message
from logscope.functions.severity import severity
from logscope.functions.text import csv_field, sanitize_text
from logscope.functions.timestamps import compare_ts, extract_ts, in_range, normalize_ts, to_epoch
from logscope.operators import errors, filters, histogram, rows, summary


def one(df, make):
    return [r[0] for r in df.orderBy("line_no").select(make(F.col("line"))).collect()]


@pytest.mark.parametrize("profile, line, want", [
    ("csv", "x 2024-01-01T10:00:00.5+02:00 y", "2024-01-01 10:00:00"),
    ("csv", "2024-01-02 10:00:00 and 2024-01-01T11:00:00Z", "2024-01-01 11:00:00"),
    ("csv", "Nov  1 10:00:00 host", "Nov  1 10:00:00 2023"),
    ("csv", "11/01/2023 10:00:00 x", "11/01/2023 10:00:00"),
    ("csv", "10:00:00 x", None),
    ("lexical", "Nov  1 10:00:00 host", None),
    ("view", "Nov  1 10:00:00 host", "Nov  1 10:00:00"),
    ("rich", "2024-01-0110:00:00 x", "2024-01-0110:00:00"),
    ("rich", "Nov  1 10:00:00 2022 x", "Nov  1 10:00:00 2022"),
    ("rich", "Nov  1 10:00:00 x", "Nov  1 10:00:00 2023"),
    ("rich", "at 1700000000 s", "2023-11-14 22:13:20"),
    ("rich", "at 1700000000123 ms", "2023-11-14 22:13:20"),
    ("rich", "id 170000000 no", None),
    ("range", "2021-05-06 | 10:00:00 x", "2021-05-06 10:00:00"),
    ("range", "on 2021-05-06 x", "2021-05-06 12:00:00"),
    ("range", "on 05/06/2021 x", "05/06/2021 12:00:00"),
    ("range", "[2021-05-06 10:00:00] x", "2021-05-06 10:00:00"),
    ("range", "Nov  1 10:00:00 x", "Nov  1 10:00:00 2023"),
    ("detected", "2024-01-01t10:00:00.25+0200 x", "2024-01-01t10:00:00.25+0200"),
    ("detected", "Mon Apr 17 10:13:01 2023 x", "Mon Apr 17 10:13:01 2023"),
    ("api", "2024-01-01T10:00:00Z x", "2024-01-01T10:00:00"),
])
def test_extract(lines, profile, line, want):
    assert one(lines(line), lambda c: extract_ts(c, profile, 2023)) == [want]


@pytest.mark.parametrize("ts, want", [
    ("2024-01-01", "2024-01-01 00:00:00"),
    ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"),
    ("2024-01-01T10:00:00.5Z", "2024-01-01 10:00:00"),
    ("2024-13-99T10:00:00.5Z", "2024-13-99 10:00:00"),
    ("2024-01-01 10:00:00.5+02:00", "2024-01-01 10:00:00.5+02:00"),
    ("Mon Apr 17 10:13:01 2023", "2023-04-17 10:13:01"),
    ("11/01/2023 10:00:00", "2023-11-01 10:00:00"),
    ("1700000000", "2023-11-14 22:13:20"),
    ("Nov  1 10:00:00", "2022-11-01 10:00:00"),
    ("soon", "soon"),
    ("", ""),
])
def test_normalize(lines, ts, want):
    assert one(lines(ts), lambda c: normalize_ts(c, year=2022)) == [want]


def test_normalize_formats(lines):
    assert one(lines("10/Oct/2023:13:55:36 +0200"), lambda c: normalize_ts(c, "apache")) == ["2023-10-10 13:55:36"]
    assert one(lines("2024-01-01T10:00:00Z"), lambda c: normalize_ts(c, "yyyy-MM-dd HH")) == ["2024-01-01 10"]
    assert one(lines("bad"), lambda c: normalize_ts(c, "yyyy")) == ["bad"]


def test_epoch_compare_range(lines):
    df = lines("1700000000", "1700000000123", "2023-11-14T22:13:20Z", "Nov 14 22:13:20", "2023-13-99 00:00:00", "170000")
    assert one(df, lambda c: to_epoch(c, 2023)) == [1700000000] * 4 + [None, None]
    assert one(df, lambda c: compare_ts(c, F.lit("2023-11-14 22:13:20"), 2023))[:1] == [0]
    times = lines("2024-01-01 00:00:00", "2024-01-02", "2023-12-31T23:59:59Z", "x")
    assert one(times, lambda c: compare_ts(c, F.lit("2024-01-01"))) == [0, 1, 2, None]
    assert one(times, lambda c: in_range(c, "2024-01-01", "2024-01-01 23:59:59")) == [True, False, False, None]
    assert one(times, lambda c: in_range(c))[:3] == [True] * 3


def test_severities(lines):
    df = lines("Error x", "xFAILx", "not found", "all finished", "notice: high load", "plain", "TRACE x", "errors")
    assert one(df, lambda c: severity(c, "csv")) == ["UNKNOWN", "ERROR", "ERROR", "INFO", "NOTICE", "UNKNOWN", "UNKNOWN", "ERROR"]
    assert one(df, lambda c: severity(c, "api")) == ["ERROR", "ERROR", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "ERROR"]
    assert one(df, lambda c: severity(c, "contextual")) == ["ERROR", "UNKNOWN", "ERROR", "INFO", "INFO", "UNKNOWN", "DEBUG", "UNKNOWN"]
    assert one(df, lambda c: severity(c, "detected")) == ["Error", "UNKNOWN", "ERROR", "INFO", "notice", "UNKNOWN", "TRACE", "error"]
    assert one(df, lambda c: severity(c, "display"))[0] == "ERROR"


@pytest.mark.parametrize("profile, line, want", [
    ("csv", "2024-01-01 10:00:00 host app: started up", "app: started up"),
    ("csv", "2024-01-01T10:00:00Z ERROR Failed now", "now"),
    ("csv", "no time ERROR: x", "no time ERROR: x"),
    ("detected", "2024-01-01 10:00:00 WARNING disk", "ING disk"),
    ("separator", "2024-01-01 10:00:00 INFO app: a: b\r", "b"),
    ("separator", "2024-01-01 10:00:00 INFO one - two - three", "three"),
    ("separator", "2024-01-01 10:00:00 INFO", None),
    ("separator", "2024-01-01 10:00:00 INFO x: #c", None),
    ("contextual", "2024-01-01T10:00:00.5Z [main] ERROR: disk full ", "disk full"),
    ("contextual", "2024-01-01 10:00:00 a.py:12: boom", "boom"),
    ("contextual", "Nov  1 10:00:00 host app[7]: boom", "boom"),
    ("contextual", "11/01/2023 10:00:00 : rest", "rest"),
])
def test_messages(lines, profile, line, want):
    assert with_message(lines(line), profile, 2024).first().message == want


def test_text_helpers(lines):
    assert one(lines('a\x07\x1b"b"\tc'), sanitize_text) == ['a\\"b\\"\tc']
    assert one(lines('say "x"'), csv_field) == ['say ""x""']


def test_window_edges(lines):
    df = lines(
        "2024-01-05 00:00:00 a", "2024-01-05T23:59:59Z b", "2024-01-06 00:00:00 c", "plain", "2024-13-99 00:00:00 d",
        "# 2024-01-05 10:00:00", "Jan  5 10:00:00 e", "01/05/2024 10:00:00 f",
    )
    kept = lambda p: [r.line_no for r in filters.where(df, p).orderBy("line_no").collect()]
    line = F.col("line")
    assert kept(filters.in_time_window(line, "2024-01-05", "2024-01-05", year=2024)) == [1, 2, 4, 5, 6, 7, 8]
    assert kept(filters.in_time_window(line, "01/05/2024", "01/05/2024", "range", 2024, True)) == [1, 2, 4, 5, 7, 8]
    assert kept(filters.in_time_window(line, "2024-01-06", year=2024)) == [3, 4, 5]
    assert kept(filters.in_time_window(line, "2024-01-07", "2024-01-05", year=2024)) == [4, 5]  # inverted
    assert kept(filters.in_time_window(line, "whenever", year=2024)) == list(range(1, 9))
    assert kept(filters.in_lexical_window(line, None, "2024-01-05")) == [4, 7, 8]
    assert kept(filters.in_lexical_window(line, "2024-01-05T12:00:00")) == [2, 3, 4, 5, 7, 8]


def test_filters_and_search(lines):
    df = lines("ERROR a.b", "error aXb", "FATAL", "ok", "errors a.b")
    kept = lambda keep: [r.line_no for r in df.where(keep(F.col("line"))).orderBy("line_no").collect()]
    assert kept(filters.has_error) == [1, 2, 5]
    assert kept(filters.has_broad_error) == [1, 2, 3, 5]
    assert kept(lambda c: filters.text_filter(c, "A.B")) == [1, 5]
    assert kept(lambda c: filters.text_filter(c, "a.b", regex=True)) == [1, 2, 5]
    nearest = lambda *a: filters.search(df, "a.b", *a).first().line_no
    assert [nearest(2), nearest(4, "backward"), nearest(6), nearest(0, "backward")] == [5, 1, None, None]


def test_frame_filters_replace_and_clear(lines):
    frame = LogFrame(lines("2024-01-01 00:00:00 error x", "2024-01-02 00:00:00 error y", "2024-01-03 00:00:00 fine x", "fail"))
    view = frame.text("y").errors_only().text("x")
    assert view.labels == ['Text: "x"', "Errors only"]
    assert view.view.count() == 1 and view.without("errors").view.count() == 2 and view.clear().view.count() == 4
    assert frame.toggle_errors().view.count() == 3 and frame.toggle_errors().toggle_errors().view.count() == 4
    timed = frame.from_time("2024-01-02").between("2024-01-01", "2024-01-02", "instant").errors_only()
    assert timed.labels == ["From time: 2024-01-02", "Time range: 2024-01-01 to 2024-01-02", "Errors only"]
    assert tuple(timed.counts().first()) == (1, 4)
    assert timed.view.count() == 1
    assert timed.summary().first().total_lines == 4
    assert timed.summary(filtered=True).first().total_lines == 1
    assert frame.severity(r"FINE\|fail").view.count() == 2


def test_histogram_of_many_times_per_line(lines):
    df = lines("2024-01-01 00:00:00 to 2024-01-01T05:00:00+02:00", "01/09/2024 00:00:00 other form", "2024-99-01 00:00:00")
    got = {r["bucket"]: r["count"] for r in histogram.time_histogram(df, "hour").collect()}
    assert got == {"2024-01-01 00": 1, "2024-01-01 03": 1, "2024-99-01 00:00:00": 1}
    assert histogram.time_histogram(df, "century").count() == 3
    only_us = lines("01/09/2024 00:00:00 a", "01/09/2024 00:30:00 b")
    assert [(r["bucket"], r["count"]) for r in histogram.time_histogram(only_us, "day").collect()] == [("2024-01-09", 2)]


def test_time_range_forms(lines):
    syslog = lines("x Nov 1 10:00:00 Nov 12 11:00:00", "plain", "Dec 25 00:00:01")
    row = summary.time_range(syslog).first()
    assert (row.time_start, row.time_end) == ("Nov 1 10:00:00", "Dec 25 00:00:01")
    mixed = lines("2024-01-01 10:00:00 s", "2024-01-02T10:00:00 t and 2024-01-01T09:00:00", "2024-01-03 10:00:00 s")
    row = summary.time_range(mixed).first()
    assert (row.time_start, row.time_end) == ("2024-01-02 10:00:00", "2024-01-01 09:00:00")
    row = summary.iso_time_range(mixed).first()
    assert (row.time_start, row.time_end) == ("2024-01-01 10:00:00", "2024-01-03 10:00:00")
    nothing = lines("a", "b")
    assert summary.time_range(nothing).first().time_start is None
    assert summary.iso_time_range(nothing).first().time_end == "Unknown"


def test_top_errors_ties_and_display(lines):
    df = lines("error  b", "error  b", "ERROR a", "error c", "ok")
    assert [tuple(r) for r in errors.top_errors(df, 2).collect()] == [(2, "error  b", "error b"), (1, "error c", "error c")]
    many = lines([("f", i, f"error {i % 50}") for i in range(2000)])
    errors_per_file = errors.top_per_group
    counted = many.groupBy("file", "line").count()
    big = errors_per_file(counted, ["file"], [F.desc("count"), F.desc("line")], 1001)
    assert big.count() == 50


def test_csv_row_profiles(lines):
    df = lines("# note", "   ", "2024-01-01 00:00:00 INFO a: b", "2024-01-01 00:00:00 INFO")
    assert rows.csv_rows(df).count() == 2
    assert [r.message for r in rows.csv_rows(df, "separator").collect()] == ["b"]
    assert rows.log_entries(df).count() == 3
