"""The expressions in SQL."""

import pytest
from pyspark.sql import functions as F

from logscope.functions import sql
from logscope.functions.messages import error_message, with_message
from logscope.functions.severity import PROFILES as SEVERITIES
from logscope.functions.severity import severity
from logscope.functions.text import csv_field, sanitize_text
from logscope.functions.timestamps import PROFILES, extract_ts, normalize_ts, to_epoch
from logscope.operators.formats import FormatRegistry, parse_format

LINES = [
    "2024-01-01T10:00:00.5+02:00 ERROR x: it's \"bad\" \\n", "Nov  1 10:00:00 host app[7]: WARN slow", "11/01/2023 10:00:00 x", "at 1700000000 s", "# note", "",
    "2021-05-06 | 10:00:00 said 'no'", "Mon Apr 17 10:13:01 2023 FATAL é🎉", "<34>1 2023-10-15T08:00:01.003Z host1 su 1234 ID47 - su root failed", "a\u0007b\tc", None,
]


@pytest.fixture
def table(spark, lines):
    names = sql.register(spark, 2024)
    rows = lines([("f", i, t) for i, t in enumerate(LINES)])
    rows.createOrReplaceTempView("some_lines")
    return rows, names


def test_functions_are_the_expressions(spark, table):
    rows, names = table
    line = F.col("line")
    columns = {f"ts_{p}": extract_ts(line, p, 2024) for p in PROFILES} | {f"severity_{p}": severity(line, p) for p in SEVERITIES}
    columns |= {
        "msg_error": F.nullif(error_message(line), F.lit("")), "ts_normal": normalize_ts(line, year=2024), "ts_epoch": to_epoch(line, 2024),
        "clean_text": sanitize_text(line), "csv_text": csv_field(line),
    }
    assert set(columns) < set(names)
    want = rows.select("line_no", *[c.alias(n) for n, c in columns.items()])
    got = spark.sql("SELECT line_no, " + ", ".join(f"{n}(line) AS {n}" for n in columns) + " FROM some_lines")
    assert sorted(got.collect()) == sorted(want.collect())
    messages = {r.line_no: r.message for r in with_message(rows, "csv", 2024).collect()}
    assert {r.line_no: r.m for r in spark.sql("SELECT line_no, msg_csv(line) AS m FROM some_lines").collect()} == messages


def test_formats_and_plans(spark, table):
    rows, _ = table
    got = spark.sql("SELECT fields_syslog(line).hostname AS h, fields_syslog(line).message AS m FROM some_lines WHERE fields_syslog(line) IS NOT NULL")
    assert [tuple(r) for r in got.collect()] == [("host1", "su root failed")]
    assert [r.hostname for r in parse_format(rows, "syslog").where("hostname IS NOT NULL").collect()] == ["host1"]
    plan = spark.sql("SELECT ts_rich(line), severity_contextual(line) FROM some_lines")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regexp" in plan


def test_filters_and_aggregates(spark, table):
    rows, _ = table
    found = spark.sql("SELECT severity_csv(line) AS s, count(*) AS n FROM some_lines WHERE ts_csv(line) >= '2023' GROUP BY 1")
    want = rows.where(extract_ts(F.col("line"), "csv", 2024) >= "2023").groupBy(severity(F.col("line"), "csv")).count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 1


def test_formats_of_the_user(spark, table):
    registry = FormatRegistry()
    registry.register("pair", "key value", r"^(\w+)=(\S*) it's$", 0)
    assert "fields_pair" in sql.register(spark, registry=registry)
    assert tuple(spark.sql("SELECT x.* FROM (SELECT fields_pair('a=\"b\" it\\'s') AS x)").first()) == ("a", '"b"')
