"""Files that arrive while a stream runs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logscope.operators.histogram import time_histogram
from logscope.operators.records import stacktrace_records
from logscope.operators.rows import csv_rows
from logscope.sources.csv import read_csv
from logscope.streaming import traces, windows
from logscope.streaming.piped import running_counts, stream_lines, write_rows


def test_rows_of_files_as_they_come(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-01 00:00:00 ERROR one\n# note\n\n")
    for name in (None, "b.log", None):
        if name:
            (tmp_path / "in" / name).write_text('2024-01-02 00:00:00 INFO "two" more\n')
        write_rows(csv_rows(stream_lines(spark, source), year=2024), out, checkpoint).awaitTermination()
    got = sorted((r.timestamp, r.severity, r.message) for r in read_csv(spark, out).collect())
    assert got == [("2024-01-01 00:00:00", "ERROR", "one"), ("2024-01-02 00:00:00", "INFO", '"two" more')]


def test_running_counts(spark, tmp_path):
    (tmp_path / "a.log").write_text("error\nwarn error\nx\n")
    counts = running_counts(stream_lines(spark, str(tmp_path)))
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("counts_so_far")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    row = spark.table("counts_so_far").first()
    assert (row.total_lines, row.error_count, row.warning_count, row.info_count) == (3, 2, 1, 0)


# -- windows over event time ----------------------------------------------------------------


def hour(h, minute=0, day=1):
    return f"2024-01-{day:02d} {h:02d}:{minute:02d}:00 INFO x"


@pytest.fixture
def arriving(spark, tmp_path):
    """Runs a stream of counts over what is there, again and again, from one checkpoint."""
    (tmp_path / "in").mkdir()

    def run(interval="hour", delay="1 hour", **files):
        for name, texts in files.items():
            (tmp_path / "in" / f"{name}.log").write_text("\n".join(texts) + "\n")
        lines = stream_lines(spark, str(tmp_path / "in")).withColumn("file", F.lit("app.log"))
        counts = windows.windowed_counts(lines, interval, 2024, delay)
        query = windows.write_windows(counts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        found = {r.bucket: r["count"] for r in windows.histogram(spark, str(tmp_path / "out"), interval).collect()}
        return found, windows.late_rows(query)

    return run


def test_windows_finish_once(arriving):
    """Windows stay open until the watermark is past them; a restart goes on with the open ones; late rows are dropped and told."""
    found, late = arriving(a=[hour(8), hour(8, 59), hour(9, 30), hour(11, 10)])
    assert (found, late) == ({"2024-01-01 08": 2, "2024-01-01 09": 1}, 0)  # up to 10:10
    found, late = arriving(b=[hour(10, 20), hour(11, 30), hour(8, 5), hour(10, 59)])
    assert late == 1 and found == {"2024-01-01 08": 2, "2024-01-01 09": 1}  # 10 is open up to 11:30 - 1 h
    found, late = arriving(c=[hour(14)])
    assert (found, late) == ({"2024-01-01 08": 2, "2024-01-01 09": 1, "2024-01-01 10": 2, "2024-01-01 11": 2}, 0)
    assert arriving()[0] == found  # nothing new


def test_windows_equal_the_histogram(spark, arriving):
    """All finished windows of batches in any order within the delay equal the histogram at rest, also by month and by the first form."""
    rng = random.Random(5)
    texts = [hour(rng.randrange(24), rng.randrange(60), rng.randrange(1, 29)) for _ in range(300)] + ["01/05/2024 10:00:00 other form", "no time", "2024-99-99 10:00:00 unreadable"]
    rng.shuffle(texts)
    for i in range(3):
        arriving(interval="month", delay="40 days", **{f"part{i}": texts[i::3]})
    found, late = arriving(interval="month", delay="40 days", end=["2024-06-01 00:00:00 end"])
    rows = spark.createDataFrame([("app.log", i, t) for i, t in enumerate(texts)], "file string, line_no long, line string")
    want = {r.bucket: r["count"] for r in time_histogram(rows, "month", 2024).collect() if r.bucket.startswith("2024-0")}
    assert late == 0 and found == want


# -- stack traces ---------------------------------------------------------------------------

HEAD, AT = "java.io.IOException: lost {}", "\tat com.example.A.b{}(A.java:1)"


def trace_stream(spark, folder, batches, **how):
    """Closed and open records of ``batches`` of (file, line_no, line), as they come one after another."""
    schema = "file string, line_no long, line string"
    closed = None
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/lines")
        records = traces.stream_stacktraces(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines"), **how)
        query = records.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        closed = spark.read.schema(records.schema).parquet(f"{folder}/out")
    return closed, traces.open_records(spark, f"{folder}/checkpoint")


def rows_of(df):
    return sorted((r.file, r.head_no, r.n_lines, r.exception, r.message, r.stacktrace) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_cut_anywhere(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = [
        (f, i, rng.choice([HEAD.format(i), AT.format(i), AT.format(i), AT.format(i), "plain", ""]))
        for f in ("a", "b") for i in range(1, 60)
    ]
    cuts = {f: sorted(rng.sample(range(1, 60), 2)) for f in ("a", "b")}
    batches = [[r for r in lines if sum(r[1] > c for c in cuts[r[0]]) == k] for k in range(3)]
    for batch in batches:
        rng.shuffle(batch)  # within a batch the line numbers tell the order
    closed, still_open = trace_stream(spark, str(tmp_path), batches)
    whole = stacktrace_records(spark.createDataFrame(lines, "file string, line_no long, line string"))
    assert rows_of(closed) + rows_of(still_open) and sorted(rows_of(closed) + rows_of(still_open)) == rows_of(whole)
    for f in ("a", "b"):
        assert sum(r[0] == f for r in rows_of(still_open)) <= 1


def test_open_trace_goes_on(spark, tmp_path):
    closed, still_open = trace_stream(spark, str(tmp_path), [[("a", 1, HEAD.format(1)), ("a", 2, AT.format(2))]])
    assert rows_of(closed) == [] and [r[:3] for r in rows_of(still_open)] == [("a", 1, 2)]
    closed, still_open = trace_stream(spark, str(tmp_path), [[("a", 3, AT.format(3)), ("a", 4, "plain"), ("a", 5, AT.format(5))]])
    assert [r[:3] for r in rows_of(closed)] == [("a", 1, 3)] and rows_of(still_open) == []


def test_timer_closes_a_silent_file(spark, tmp_path):
    """The rows of one file come, then only those of another: the first file's record closes after its time."""
    from pyspark.sql.streaming.state import GroupState

    class State:
        def __init__(self, held=None, timed_out=False):
            self.get, self.exists, self.hasTimedOut, self.waits, self.removed = held, held is not None, timed_out, None, False

        def update(self, held):
            self.get, self.exists = held, True

        def setTimeoutDuration(self, ms):
            self.waits = ms

        def remove(self):
            self.removed = True

    assert set(vars(State())) - {"waits", "removed"} <= set(dir(GroupState))
    batch = pd.DataFrame({"line_no": [2, 1], "kind": ["at", "head"], "line": ["\tat x", "E: m"]})
    state = State()
    assert next(traces._advance(("a",), iter([batch]), state, 500)).empty and state.waits == 500
    done = next(traces._advance(("a",), iter([]), State(state.get, timed_out=True), 500))
    assert done.to_dict("records") == [{"file": "a", "head_no": 1, "n_lines": 2, "head": "E: m", "stacktrace": "\tat x"}]


def test_few_lines_go_to_the_state(spark):
    """Of a long stretch only the lines at its ends may belong to records beyond it."""
    import pyarrow as pa

    kinds = ["at", "at"] + ["head", "at", "at", "other"] * 2000 + ["head", "at"]
    batch = pa.RecordBatch.from_pydict({
        "file": ["a"] * len(kinds), "line_no": list(range(5, 5 + len(kinds))), "line": [None if k == "other" else f"{k} {i}" for i, k in enumerate(kinds)], "kind": kinds,
    })
    batch = batch.take(pa.array(random.Random(3).sample(range(len(kinds)), len(kinds))))
    (outer,), (inner,) = traces._outer(iter([batch])), traces._inner(iter([batch]))
    assert outer.column("line_no").to_pylist() == [5, 6, 7, 5 + len(kinds) - 2, 5 + len(kinds) - 1]
    assert outer.column("kind").to_pylist() == ["at", "at", "other", "head", "at"] and outer.column("line")[2].as_py() is None
    assert inner.num_rows == 2000 and inner.column("n_lines").to_pylist() == [3] * 2000 and inner.column("stacktrace")[0].as_py() == "at 3\nat 4"
