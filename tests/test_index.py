"""Stored facts about files: same results, few files read, changes noticed."""

import random

import pytest
from pyspark.sql import functions as F

from logscope import read
from logscope.index import FileIndex
from logscope.operators.ranking import positions

LINES = 300


@pytest.fixture
def store(spark, tmp_path):
    """Twelve files of a day each; two have lines without a timestamp."""
    folder = tmp_path / "logs"
    folder.mkdir()
    rng = random.Random(8)
    for day in range(1, 13):
        lines = [f"2024-01-{day:02d} {h:02d}:{rng.randrange(60):02d}:00 {rng.choice(['ERROR', 'INFO'])} line {i}" for i, h in enumerate(sorted(rng.randrange(24) for _ in range(LINES)))]
        if day in (4, 9):
            lines.insert(7, "no time here, an error though")
        (folder / f"day {day:02d}.log").write_text("\n".join(lines) + "\n")
    return folder, read(spark, str(folder)), FileIndex(spark, str(folder), str(tmp_path / "index"))


def names(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def rows(df):
    return sorted((r.file, r.line) for r in df.select("file", "line").collect())


@pytest.mark.parametrize("start, end", [("2024-01-05", "2024-01-06"), ("2024-01-12 05:00:00", None), (None, "2024-01-01"), ("2025-01-01", None), (None, None)])
def test_windows_open_the_files_they_meet(store, measured, start, end):
    folder, log, index = store
    want = rows(log.between(start, end, "instant").view)
    assert rows(index.between(log, start, end).view) == want  # builds the table
    files = {f.rsplit("/", 1)[1] for f in index.files_between(start, end)}
    holding = {f.rsplit("/", 1)[1] for f, _ in want}
    assert files == holding and {"day%2004.log", "day%2009.log"} <= files
    view = index.between(log, start, end).view
    got, metrics = measured(lambda: rows(view))
    assert got == want
    assert metrics["inputRecords"] == sum(len((folder / f.replace("%20", " ")).read_text().splitlines()) for f in files)


def test_other_filters_stay(store):
    _, log, index = store
    view = log.errors_only().text("line 1")
    assert rows(index.between(view, "2024-01-03", "2024-01-03").view) == rows(view.between("2024-01-03", "2024-01-03", "instant").view)


def placed(df):
    return sorted((r.position, r.file, r.line) for r in df.select("position", "file", "line").collect())


def test_pages_and_samples(store, measured):
    _, log, index = store
    view = log.errors_only()
    every = placed(positions(view.view))
    for number in (0, 1, 3, 6, 10**6):
        assert placed(index.page(view, number, 37)) == placed(view.page(number, 37))
    assert placed(index.sample(view)) == placed(view.sample())
    got, metrics = measured(lambda: placed(index.page(view, 2, 15)))
    assert got == every[15:30]
    # two scans of a file, and the rows of tables of files
    assert metrics["inputRecords"] <= 2 * LINES + 20 * 12
    nothing = log.text("nowhere at all")
    assert placed(index.page(nothing, 1)) == placed(index.sample(nothing)) == []


def test_changes_are_noticed(spark, store, measured):
    folder, log, index = store
    view = log.text("error")
    before = {r.file.rsplit("/", 1)[1]: r.n for r in index.counts(view).collect()}
    _, metrics = measured(lambda: index.counts(view).count())
    assert metrics["inputRecords"] <= 8 * 12  # nothing but tables of files
    with open(folder / "day 02.log", "a") as f:
        f.write("one more error\n")
    (folder / "day 11.log").unlink()
    (folder / "day 13.log").write_text("error\nfine\n")
    log = read(spark, str(folder))
    after = {r.file.rsplit("/", 1)[1]: r.n for r in index.counts(log.text("error")).collect()}
    want = {**before, "day%2002.log": before["day%2002.log"] + 1, "day%2013.log": 1}
    del want["day%2011.log"]
    assert after == want
    assert placed(index.page(log.text("error"), 2)) == placed(log.text("error").page(2))
    late = {r.file.rsplit("/", 1)[1]: (r.untimed, r.lines) for r in index.times().collect()}
    assert late["day%2013.log"] == (2, 2) and late["day%2002.log"] == (1, LINES + 1) and late["day%2001.log"] == (0, LINES)


def test_views_have_tables_of_their_own(store):
    _, log, index = store
    broad, plain = log.errors_only(broad=True), log.errors_only()
    assert broad.labels == plain.labels  # so labels cannot name them
    assert index.counts(broad).agg(F.sum("n")).first()[0] == broad.view.count()
    assert index.counts(plain).agg(F.sum("n")).first()[0] == plain.view.count()
    window = log.between("2024-01-02", "2024-01-04", "instant")
    assert placed(index.page(window, 1)) == placed(window.page(1))


def test_statistics_after_arrivals_equal_one_pass(spark, store):
    """States of files that came at three times, merged, are those of all files at once."""
    from logscope.operators import errors, summary

    folder, _, index = store
    held = {f: f.read_text() for f in sorted(folder.iterdir())}
    for f in held:
        f.unlink()
    files = list(held)
    for part in (files[:1], files[1:7], files[7:]):
        for f in part:
            f.write_text(held[f])
        (folder / "grows.log").write_text("2024-03-01 00:00:00 ERROR again\n" * (len(part) + 1))
        lines = read(spark, str(folder)).lines
        assert sorted(index.statistics().collect()) == sorted(summary.file_statistics(lines).select(*index.statistics().columns).collect())
        assert sorted(map(tuple, index.rollup().collect()), key=str) == sorted(map(tuple, summary.rollup_by_file(lines).collect()), key=str)
        for threshold in (1, 3):
            assert index.unique_errors(threshold).collect() == errors.unique_errors(lines, threshold).collect()
