"""Very long lines, and regular expressions in the two dialects."""

import time

import pytest
from pyspark.sql import functions as F

from logscope.operators import errors, filters, formats, histogram, records, rows

STAMP = "2024-01-05 10:00:00"
N = 100_000
HOSTILE = {
    "dotted": f"{STAMP} " + "a." * N, "letters": f"{STAMP} " + "x" * N, "blanks": STAMP + " " * N + "end", "colons": f"{STAMP} " + ":" * N,
    "digits": f"{STAMP} " + "7" * N, "heads": "a." * N + "LostException", "levels": f"{STAMP} ERROR" + " " * N, "millis": f"{STAMP},123 ERROR" + " " * N + "x",
    "words": f"{STAMP} " + "ab " * (N // 3), "tokens": f"{STAMP} " + "a:1" * (N // 3), "brackets": f"{STAMP} " + "[" * N, "kube": "2024-01-05T10:00:00.1Z INFO" + " " * N,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_long_lines(lines, name):
    df = lines(HOSTILE[name], "plain")
    start = time.time()
    assert rows.csv_rows(df).count() == 2
    for profile in ("csv", "separator", "view"):
        rows.csv_rows(df, profile).select(F.md5("message")).collect()
    records.stacktrace_records(df).collect()
    formats.detect_format(df).collect()
    formats.parse_detected(df).select(F.md5("message")).collect()
    assert time.time() - start < 60


def test_long_head_is_read(lines):
    row = records.stacktrace_records(lines("a." * N + "LostException: boom", "\tat b")).first()
    assert (len(row.exception), row.message, row.n_lines) == (2 * N + 13, "boom", 2)


def test_basic_and_java_expressions(lines):
    df = lines("a|b", "ab", "aab", "a+b", "(x)", "x{2}", "xx")
    kept = lambda pattern, **o: [r.line_no for r in df.where(filters.matches(F.col("line"), pattern, **o)).orderBy("line_no").collect()]
    assert kept("a|b") == [1] and kept(r"a\|x") == [1, 2, 3, 4, 5, 6, 7]
    assert kept("a+b") == [4] and kept(r"^a\+b") == [2, 3]
    assert kept("(x)") == [5] and kept(r"\(x\)") == [5, 6, 7]
    assert kept("x{2}") == [6] and kept(r"x\{2\}") == [7]
    assert kept("a|b", dialect="java") == [1, 2, 3, 4] and kept("^a+b", dialect="java") == [2, 3]
    with pytest.raises(ValueError):
        filters.matches(F.col("line"), "a", "other")


def test_order_of_results(lines):
    texts = ["2024-01-0%d 00:00:00 ERROR %s" % (9 - i % 5, "abc"[i % 3]) for i in range(10)]
    found = [(r.occurrences, r.message) for r in errors.unique_errors(lines(*texts)).collect()]
    assert found == sorted(found, reverse=True) and len(found) == 3
    assert [r.message for r in errors.error_chart(lines(*texts)).collect()] == [m for _, m in found]
    buckets = [r.bucket for r in histogram.time_histogram(lines(*texts), "day").collect()]
    assert buckets == sorted(buckets) and len(buckets) == 5
    assert [r.bucket for r in histogram.time_chart(histogram.time_histogram(lines(*texts), "day")).collect()] == buckets


def test_header_that_repeats_a_name(lines):
    row = formats.w3c_rows(lines("#Fields: date time ip ip", "2024-01-01 00:00:00 1 2")).first()
    assert row["row"] == {"date": "2024-01-01", "time": "00:00:00", "ip": "2"}


def test_simple_log_passes_through(lines):
    assert [r.entry for r in formats.parse_format(lines("a b", ""), "simple_log").orderBy("line_no").collect()] == ["a b", ""]
