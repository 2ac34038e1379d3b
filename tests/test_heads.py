"""The beginning of files without the rest of them."""

import pytest
from pyspark.sql import functions as F

from logscope import read
from logscope.sources import heads
from logscope.sources.files import split_bound

LINE = "2024-01-01 00:00:00 INFO line {} with some text to fill it up\n"


@pytest.fixture
def store(tmp_path):
    """Two files of some megabytes, small ones, an empty one, one without a newline at its end, odd names."""
    texts = {"big 1.log": 60_000, "big[2].log": 40_000, "three.log": 3, "seven.log": 7, "twenty.log": 20, "more.log": 21}
    for name, n in texts.items():
        (tmp_path / name).write_text("".join(LINE.format(i) for i in range(1, n + 1)))
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "blank.log").write_text("\n\n")
    (tmp_path / "open.log").write_text("one\r\ntwo")
    return tmp_path, {**texts, "blank.log": 2, "open.log": 2}


def name(column):
    return F.replace(F.replace(F.replace(F.regexp_extract(column, "[^/]+$", 0), F.lit("%20"), F.lit(" ")), F.lit("%5B"), F.lit("[")), F.lit("%5D"), F.lit("]"))


@pytest.mark.parametrize("packed", [heads.PACKED, 100, 1 << 40])
def test_heads_of_files(spark, store, packed):
    path, texts = store
    found = heads.read_heads(spark, str(path), 20, packed=packed)
    rows = [(r.name, r.line_no, r.line) for r in found.select(name("file").alias("name"), "line_no", "line").collect()]
    for file, n in texts.items():
        own = sorted(r[1:] for r in rows if r[0] == file)
        assert [i for i, _ in own] == list(range(1, min(n, 20) + 1))
        if file not in ("blank.log", "open.log"):
            assert [line for _, line in own] == [LINE.format(i).rstrip("\n") for i, _ in own]
    assert [r[2] for r in sorted(rows) if r[0] == "open.log"] == ["one\r", "two"]
    assert {r[0] for r in rows} == set(texts)


def test_detection_reads_first_blocks(spark, store, measured):
    path, _ = store
    log = read(spark, str(path))
    found, metrics = measured(lambda: {r.file.rsplit("/", 1)[1]: (r.format, r.lines) for r in log.detect_format().collect()})
    assert found["big%201.log"] == ("simple", 20) and found["three.log"] == ("simple", 3) and found["open.log"] == ("custom", 2)
    whole = sum(f.stat().st_size for f in path.iterdir())
    assert 0 < metrics["inputBytes"] < 300_000 < whole / 15


def test_many_large_files_are_scanned(spark, store):
    path, _ = store
    assert heads.read_heads(spark, str(path), 20, packed=100, scans=2) is None
    assert len(heads.large_files(spark, str(path), packed=1000, most=10)) == 4


def test_heads_of_views_and_text(spark, example, store):
    assert example.heads(3).count() == 3
    assert example.detect_format().first().format == "simple"
    path, _ = store
    view = read(spark, str(path)).text("line 30 ")
    parsed = view.parse_detected()
    assert {(r.timestamp, r.severity) for r in parsed.collect()} == {("2024-01-01 00:00:00", "INFO")} and parsed.count() == 2


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read(spark, str(tmp_path / "none.log"))


@pytest.mark.parametrize("size, number", [("512MB", 1 << 29), ("512m", 1 << 29), ("134217728", 1 << 27), ("134217728b", 1 << 27), ("64k", 1 << 16)])
def test_split_sizes_as_spark_writes_them(spark, store, size, number):
    path, texts = store
    lines = read(spark, str(path)).lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        size_of_all, files = sum(f.stat().st_size for f in path.iterdir()), len(lines.inputFiles())
        assert size_of_all // number + files <= split_bound(lines) <= 2 * size_of_all // number + files
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
