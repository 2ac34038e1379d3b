"""Known results of the ten-line example (its text starts with a newline: 11 lines)."""

from logscope import LogOptions, analyze_string
from logscope.operators import errors, histogram, ranking, summary
from tests.conftest import EXAMPLE


def test_summary(example):
    row = example.summary().first()
    assert (row.total_lines, row.error_count, row.warning_count, row.info_count) == (11, 3, 2, 5)
    assert (row.time_start, row.time_end) == ("2023-09-01 12:00:00", "2023-09-01 12:09:50")
    assert [(e.occurrences, e.message[11:19]) for e in row.top_errors] == [(1, "12:08:40"), (1, "12:05:10"), (1, "12:03:45")]


def test_unique_errors(example):
    found = {r.message: r.occurrences for r in example.unique_errors().collect()}
    assert found == {
        "Failed to connect to payment gateway: timeout": 2, "Cannot process order #12345: invalid payment": 1,
    }
    assert [r.message for r in example.unique_errors(2).collect()] == ["Failed to connect to payment gateway: timeout"]


def test_histogram_and_peak(example):
    hist = example.time_histogram()
    assert [(r["bucket"], r["count"]) for r in hist.collect()] == [("2023-09-01 12", 10)]
    assert histogram.peak(hist).first().peak_count == 10
    assert histogram.time_chart(example.time_histogram("minute")).where("bar = repeat('#', 50)").count() == 10


def test_csv_messages(example):
    rows = example.csv_rows().orderBy("line_no").collect()
    assert [r.message for r in rows] == [
        "started on port 3000", "login: user123", "database query took 2.5s", "to connect to payment gateway: timeout",
        "logout: user123", "process order #12345: invalid payment", "user registered: user456", "usage above 80%",
        "to connect to payment gateway: timeout", "health check completed",
    ]
    assert [r.severity for r in rows][:4] == ["INFO", "INFO", "WARNING", "ERROR"]


def test_window_keeps_lines_without_time(example):
    for window in ("lexical", "instant"):
        view = example.between("2023-09-01 12:02:00", "2023-09-01 12:05:00", window)
        assert [r.line[11:19] for r in view.view.orderBy("line_no").collect()] == ["", "12:02:30", "12:03:45", "12:04:50"]


def test_sample_of_few_lines_is_everything(example):
    assert ranking.systematic_sample(example.lines).count() == 11


def test_chart(example):
    bars = {r.occurrences: r.bar for r in errors.error_chart(example.lines).collect()}
    assert bars == {2: "#" * 50, 1: "#" * 25}


def test_report_kinds(example):
    long = {(r.report_type, r.key): r.value for r in example.report("csv").collect()}
    assert long["statistics", "total_lines"] == "11" and long["time_range", "last"] == "2023-09-01 12:09:50"
    assert sum(kind == "top_errors" for kind, _ in long) == 1  # three errors with one key
    assert '"error_count":3' in example.report("json").first().json
    parts = example.report("text")
    assert parts["error_chart"].count() == 0 and parts["time_distribution"].count() == 1


def test_analyze(spark):
    result = analyze_string(spark, EXAMPLE, LogOptions(errors_only=True, csv=True))
    assert result.summary.first().total_lines == 11
    assert result.csv.count() == 3 and result.logs.count() == 3
    shown = analyze_string(spark, EXAMPLE * 3)
    assert shown.csv is None and shown.logs.count() <= 20
    limited = analyze_string(spark, EXAMPLE, LogOptions(limit=3))
    assert [r.severity for r in limited.logs.collect()] == ["INFO", "INFO"]  # the first line is blank
    sampled = analyze_string(spark, EXAMPLE, LogOptions(sample=True, start="2023-09-01 12:05:00"))
    assert sampled.logs.count() == 5
    assert summary.severity_distribution(result.view.view).first()["count"] == 3
