"""Files in and out."""

from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logscope import LogOptions, analyze, read, read_text
from logscope.sources.csv import read_csv, write_csv
from logscope.sources.files import number_lines, read_lines
from logscope.sources.memory import lines_from_table, lines_from_text, split_text
from logscope.sources.scratch import scratch_path


def test_line_ends(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\r\ntwo\rstill two\n\nlast")
    got = number_lines(read_lines(spark, str(path))).orderBy("line_no").collect()
    assert [r.line for r in got] == ["one\r", "two\rstill two", "", "last"]
    text = lines_from_text(spark, path.read_bytes().decode()).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in text] == [(r.line_no, r.line) for r in got]


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    frame = read(spark, str(tmp_path / "empty.log"))
    assert frame.view.count() == 0 and frame.sample().count() == 0 and frame.page_count().first().pages == 1
    with pytest.raises(AnalysisException):
        read(spark, str(tmp_path / "missing.log"))


def test_split_text(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, "\n"), (4, "x")], "id int, text string")
    assert [tuple(r) for r in split_text(df, "text", "id").orderBy("id", "line_no").collect()] == [
        (1, 1, "a"), (1, 2, ""), (1, 3, "b"), (3, 1, ""), (4, 1, "x"),
    ]


def test_lines_from_table(spark):
    df = spark.createDataFrame([(7, "x", "h")], "n int, body string, host string")
    assert tuple(lines_from_table(df, "body", "n", "host").first()) == ("h", 7, "x")
    assert lines_from_table(df, "body", F.col("n"), "app").first().file == "app"


def test_csv_round_trip(spark, tmp_path):
    values = [("", "ERROR", 'say "hi", x'), ("t", "INFO", "  blanks  "), ("t", "INFO", "tab\tand, comma"), ("t", "I", "back\\slash")]
    rows = spark.createDataFrame(values, "timestamp string, severity string, message string")
    write_csv(rows.coalesce(1), str(tmp_path / "out"))
    back = read_csv(spark, str(tmp_path / "out")).collect()
    assert [tuple(r) for r in back] == [(*v, None) for v in values]
    text = next((tmp_path / "out").glob("part*.csv")).read_text().splitlines()
    assert text[:2] == ['"timestamp","severity","message"', '"","ERROR","say ""hi"", x"']


def test_export(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01 00:00:00 ERROR: a\n2024-01-01 00:00:01 INFO: b\n")
    view = read(spark, str(tmp_path / "a.log")).errors_only()
    for scope, n in (("filtered", 1), ("full", 2)):
        view.export(str(tmp_path / scope), scope)
        assert read_csv(spark, str(tmp_path / scope / "data")).count() == n
        meta = spark.read.json(str(tmp_path / scope / "metadata")).first()
        assert (meta.total_entries, meta.filtered_entries, meta.filters, meta.export_type) == (2, 1, ["Errors only"], scope)
    with pytest.raises(ValueError):
        view.export(str(tmp_path / "x"), "some")


def test_analyze_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-01 00:00:00 ERROR a\n" * 30)
    (tmp_path / "b.log").write_text("2024-02-01 00:00:00 INFO b\n" * 30)
    result = analyze(spark, str(tmp_path), LogOptions(start="2024-02-01", limit=40))
    assert {r.file[-5:]: r.error_count for r in result.summary.collect()} == {"a.log": 30, "b.log": 0}
    assert result.summary.where("file like '%b.log'").first().top_errors == []
    assert result.logs.count() == 30
    with pytest.raises(ValueError):
        LogOptions(limit=-5)


def test_scratch_path_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    unset = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(
        conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    assert scratch_path(session("local[2]"), "x") != scratch_path(session("local[2]"), "x")
    with pytest.raises(ValueError):
        scratch_path(session("yarn"), "x")


def test_export_reads_once(spark, tmp_path, measured):
    (tmp_path / "in.log").write_text("".join(f"2024-01-01 00:00:00 {'ERROR' if i % 3 else 'INFO'} message {i}\n" for i in range(300)) + "# note on errors\n\n")
    view = read(spark, str(tmp_path / "in.log")).errors_only().between("2024-01-01", window="instant", year=2024)
    _, metrics = measured(lambda: view.export(str(tmp_path / "out")))
    assert metrics["inputRecords"] == 302 + 1  # and the one row of the metadata
    meta = spark.read.json(str(tmp_path / "out" / "metadata")).first()
    assert (meta.total_entries, meta.filtered_entries) == (302, 201)
    assert read_csv(spark, str(tmp_path / "out" / "data")).count() == 200


def test_export_of_nothing(spark, tmp_path):
    read_text(spark, "").errors_only().export(str(tmp_path / "out"))
    meta = spark.read.json(str(tmp_path / "out" / "metadata")).first()
    assert (meta.total_entries, meta.filtered_entries) == (0, 0)


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from logscope.frame import LogFrame

def lose_first(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
lines = spark.range(100, numPartitions=3).select(F.lit("f").alias("file"), (F.col("id") + 1).alias("line_no"), F.concat(F.lit("error "), "id").alias("line"))
LogFrame(lines.mapInArrow(lose_first, lines.schema)).text("7").export(sys.argv[1])
print(spark.read.json(sys.argv[1] + "/metadata").first())
"""


def test_export_counts_after_retries(tmp_path):
    """Every task is lost after it has seen all its lines; the counts are of the attempts that succeed."""
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path / "out")], capture_output=True, text=True, cwd=Path(__file__).parent.parent, timeout=200)
    assert "total_entries=100" in done.stdout and "filtered_entries=19" in done.stdout, done.stderr[-2000:]
