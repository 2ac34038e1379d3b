"""Logs written as files: one per part, in order, sorted in pieces."""

from logscope.plans import dataset as D

N = 3_000


def rows_read(spark, group):
    """Rows that each task of a job group read from a shuffle."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    tracker, store = spark.sparkContext.statusTracker(), context.statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    read = []
    for s in stages:
        tasks = store.taskList(s, 0, 10_000)
        read += [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())]
    return read


def test_files_are_sorted_in_pieces(spark, tmp_path, monkeypatch):
    """One file holds nearly all lines, with gaps in their numbers; no task sorts more than a part of it."""
    monkeypatch.setattr(D, "PIECE_BYTES", 4_000, raising=False)
    texts = [("", "blank \r", "tab\t{}", "ünï {}", "line {} of some more text")[i % 5].format(i) for i in range(N)]
    of = lambda i: 0 if i % 100 == 7 else 12
    made = [(i**2, texts[i], of(i)) for i in range(N)]
    lines = spark.createDataFrame(made[::-1], "line_no bigint, line string, part bigint").repartition(5, "line")
    path = str(tmp_path / "log [1]")
    spark.sparkContext.setJobGroup("pieces", "pieces")
    try:
        D.add_to_log(lines, path)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    for part in (0, 12):
        file, = (tmp_path / "log [1]" / f"part={part}").glob("part-*.txt")
        assert file.read_bytes().decode() == "".join(f"{texts[i]}\n" for i in range(N) if of(i) == part)
    read = rows_read(spark, "pieces")
    assert sum(read) >= N and max(read) < N / 3


def test_more_and_no_lines(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b", 0), (1, "a", 0), (1, None, 1)], "line_no bigint, line string, part bigint")
    path = str(tmp_path / "log")
    D.add_to_log(lines.where("part > 1"), path)
    assert spark.read.text(path).count() == 0
    D.add_to_log(lines.where("part = 0"), path)
    D.add_to_log(lines.where("part = 1"), path)
    assert sorted(tuple(r) for r in spark.read.text(path).collect()) == [("", 1), ("a", 0), ("b", 0)]
