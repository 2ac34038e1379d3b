"""Line numbers and positions over many splits and blocks."""

import random

import pytest
from pyspark.sql import functions as F

from logscope import read
from logscope.operators import formats, ranking, records, report, summary
from logscope.sources.files import number_lines, read_lines

TRACE = "java.io.IOException: lost"
AT = "\tat com.example.A.b(A.java:1)"


@pytest.fixture
def split_files(spark, tmp_path):
    """Two files in many splits; the last line of one has no newline."""
    rng = random.Random(1)
    texts = {}
    for name, n in (("a.log", 3000), ("b.log", 1500)):
        texts[name] = [f"{i} " + "x" * rng.randrange(80) for i in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(texts[name]) + ("\n" if name == "a.log" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    spark.conf.set("spark.sql.files.openCostInBytes", 1024)
    yield tmp_path, texts
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("broadcast_blocks", [400_000, 0])
def test_line_numbers(spark, split_files, broadcast_blocks):
    path, texts = split_files
    raw = read_lines(spark, str(path))
    assert raw.rdd.getNumPartitions() > 10
    got = {}
    for r in number_lines(raw, broadcast_blocks).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
    for name, lines in texts.items():
        assert got[name] == dict(enumerate(lines, start=1))


def test_time_range_over_splits(spark, tmp_path, split_files):
    path = tmp_path / "t"
    path.mkdir()
    times = [f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}" for i in range(2000)]
    (path / "t.log").write_text("\n".join(f"{t} line {t[:4]}" for t in times))
    raw = read_lines(spark, str(path))
    for frame in (raw, number_lines(raw)):
        row = summary.time_range(frame).first()
        assert (row.time_start, row.time_end) == (times[0], times[-1])
        row = summary.date_range(frame).first()
        assert (row.time_start, row.time_end) == (times[0], times[-1])
    assert summary.file_statistics(raw).first().total_lines == 2000


def test_head_of_files(spark, split_files):
    heads = formats.head_lines(read_lines(spark, str(split_files[0]))).collect()
    assert len(heads) == 40 and {int(r.line.split()[0]) for r in heads} == set(range(1, 21))


@pytest.mark.parametrize("n", [0, 19, 20, 39, 40, 100, 101, 1000, 1001])
def test_sample_and_pages(spark, n):
    df = spark.range(1, 3 * n + 1).select(
        F.when(F.col("id") > n, "b").otherwise("a").alias("file"), F.col("id").alias("line_no"),
        F.col("id").cast("string").alias("line"),
    ).where("line_no % 3 = 0")
    want = [3 * i for i in range(1, n + 1)]
    size = 50 if n > 1000 else 30 if n > 100 else 20
    step = max(1, n // size)
    sample = ranking.systematic_sample(df, block=7).orderBy("position").collect()
    assert [r.line_no for r in sample] == want[step - 1::step]
    page = ranking.page(df, 2, block=7).orderBy("position").collect()
    first = 40 if n > 40 else 0  # a view of one page has no second one
    assert [(r.position, r.line_no) for r in page] == list(enumerate(want[first : first + 40], start=first + 1))
    assert ranking.page_count(df).first().pages == max(1, -(-n // 40))
    assert [r.line_no for r in ranking.positions(df, block=7).orderBy("position").collect()] == want
    assert [r.line_no for r in ranking.limit_lines(df, 25).collect()] == want[:25]


def test_limit_is_sorted_at_any_size(spark):
    df = spark.range(1, 30_000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.lit("x").alias("line")).repartition(7)
    for n in (120, 20_000):
        assert [r.line_no for r in ranking.limit_lines(df, n).collect()] == list(range(1, n + 1))
    with pytest.raises(ValueError):
        ranking.limit_lines(df, -1)


def test_pages_are_clamped(spark):
    df = spark.range(1, 96).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.lit("x").alias("line"))
    first_of = lambda number, frame=df: [r.line_no for r in ranking.page(frame, number, block=7).orderBy("position").limit(1).collect()]
    assert [first_of(n) for n in (-3, 0, 1, 2, 3, 4, 10**9)] == [[1], [1], [1], [41], [81], [81], [81]]
    assert first_of(2, df.where("false")) == []


def brute_records(texts):
    out, head = [], None
    for i, text in enumerate(texts, start=1):
        if text.startswith("java."):
            head = i
            out.append((i, [text]))
        elif text.startswith("\tat ") and head:
            out[-1][1].append(text)
        else:
            head = None
    return {no: "\n".join(body[1:]) for no, body in out}


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_records_across_blocks(lines, block):
    rng = random.Random(block)
    texts = [rng.choice([TRACE, AT, AT, AT, "plain"]) for _ in range(300)]
    got = {r.head_no: r.stacktrace for r in records.stacktrace_records(lines(*texts), block).collect()}
    assert got == brute_records(texts)


def test_long_record_is_one_row(lines):
    texts = ["plain", TRACE] + [f"\tat x.Y.z(Y.java:{i})" for i in range(25_000)] + ["plain", AT]
    rows = records.stacktrace_records(lines(*texts), block=1000).collect()
    assert [(r.head_no, r.n_lines) for r in rows] == [(2, 25_001)]
    assert rows[0].stacktrace == "\n".join(texts[2:25_002]) and rows[0].exception is not None and rows[0].message is not None


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write_logs(folder, **texts):
    folder.mkdir()
    for name, body in texts.items():
        (folder / f"{name}.log").write_text("".join(f"{line}\n" for line in body))
    return str(folder)


def test_records_of_files_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    logs = {name: [rng.choice([TRACE, AT, AT, AT, "plain"]) for _ in range(700)] for name in "ab"}
    frame = read(spark, write_logs(tmp_path / "logs", **logs))
    assert frame.lines.rdd.getNumPartitions() > 6
    got = {(r.file.rsplit("/", 1)[1][0], r.head_no): r.stacktrace for r in frame.stacktraces().collect()}
    assert got == {(name, no): text for name, texts in logs.items() for no, text in brute_records(texts).items()}
    assert len({r.line_no for r in frame.stacktrace_lines().where("file like '%a.log'").collect()}) > 100


def test_w3c_of_files_over_splits(spark, tmp_path, small_splits):
    logs = {}
    for name in "ab":
        logs[name] = ["2024-01-01 00:00:00 early"]
        for field in ("a", "b", "c"):
            logs[name] += [f"#Fields: date time {field} {field}"] + [f"2024-01-01 00:00:01 {name}{field} {i}" for i in range(200)]
    frame = read(spark, write_logs(tmp_path / "logs", **logs))
    rows = [(r.file.rsplit("/", 1)[1][0], r.row) for r in frame.w3c_rows().collect()]
    assert len(rows) == 1200 and all(set(row) - {"date", "time"} <= set("abc") for _, row in rows)
    # the last value of a name that its header repeats
    assert sorted((name, f, row[f]) for name, row in rows for f in row if f in "abc") == sorted(
        (name, f, str(i)) for name in "ab" for f in "abc" for i in range(200))


def test_scans_of_files(spark, tmp_path):
    """How often the text files are read, and that no line is sorted for a head or a window over all of it."""
    frame = read(spark, write_logs(tmp_path / "logs", a=[TRACE, AT, "2024-01-01 00:00:00 ERROR x"]))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scans = lambda df: plan(df).count("Scan text") or plan(df).count("FileScan text")
    assert scans(frame.stacktraces()) == 2
    rows = frame.w3c_rows()
    rows.collect()
    final = plan(rows).split("== Initial Plan ==")[0]
    assert final.count("FileScan text") <= 3  # the table of blocks, lines of plain blocks, and of others if there are any
    assert scans(frame.export_metadata()) == 1
    assert scans(summary.date_range(frame.lines)) == 2 and scans(summary.iso_time_range(frame.lines)) == 2
    assert scans(report.report_long(frame.lines)) == 4  # frequent errors: their hashes, then the lines wanted
    assert scans(formats.head_lines(frame.lines)) == 2 and "row_number" not in plan(formats.head_lines(frame.lines))


def test_planning_starts_no_job(spark, tmp_path):
    frame = read(spark, write_logs(tmp_path / "logs", a=["2024-01-01 00:00:00 ERROR x"] * 50))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    for df in (frame.numbered, frame.page(2), frame.sample(), frame.stacktraces(), formats.parse_detected(frame.lines), frame.w3c_rows()):
        df._jdf.queryExecution().executedPlan()
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext._jsc.clearJobGroup()


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_w3c_header_carries_over_blocks(lines, block):
    texts = ["2024-01-01 00:00:00 early"]
    for names in ("date time a", "date time b", "date time b"):
        texts += [f"#Fields: {names}"] + [f"2024-01-01 00:00:0{i} {names[-1]}{i}" for i in range(5)]
    rows = formats.w3c_rows(lines(*texts), block).orderBy("line_no").collect()
    assert [next(v for k, v in r["row"].items() if k in "ab") for r in rows] == [f"{n}{i}" for n in "abb" for i in range(5)]
    assert [set(r["row"]) - {"date", "time"} for r in rows] == [{n} for n in "abb" for _ in range(5)]


def test_read_is_lazy_about_numbers(spark, split_files):
    frame = read(spark, str(split_files[0]))
    assert "line_no" not in frame.view.columns and "line_no" in frame.numbered.columns
    lines = [line for name in ("a.log", "b.log") for line in split_files[1][name]]
    shown = lambda df: [r.line for r in df.collect()]
    assert shown(frame.limit(5)) == lines[:5]
    assert shown(frame.page(2).orderBy("position")) == lines[40:80]
    assert shown(frame.page(76).orderBy("position")) == lines[3000:3040]  # the second file
    assert shown(frame.sample().orderBy("position")) == lines[89::90]
    nines = [line for line in lines if line.split()[0].endswith("9")]
    view = frame.text("9 ")
    assert shown(view.sample().orderBy("position")) == nines[14::15]
    assert shown(ranking.positions(view.view).orderBy("position")) == nines


def test_range_of_files_without_times(spark, tmp_path, small_splits):
    logs = {"a": ["plain"] * 400, "b": ["x"] * 300 + ["2024-01-01 00:00:01 a 2024-01-01 00:00:02"] * 2 + ["y"] * 300, "c": [""]}
    frame = read(spark, write_logs(tmp_path / "logs", **logs))
    named = lambda df: {r.file.rsplit("/", 1)[1][0]: (r.time_start, r.time_end) for r in df.collect()}
    assert named(summary.date_range(frame.lines)) == {"a": (None, None), "b": ("2024-01-01 00:00:01", "2024-01-01 00:00:02"), "c": (None, None)}
    assert named(summary.iso_time_range(frame.lines))["a"] == ("Unknown", "Unknown")
    assert {r.total_lines for r in summary.date_range(frame.lines, counts=True).collect()} == {400, 602, 1}
