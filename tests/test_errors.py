"""Frequent errors counted by hash: ties, hidden ties, equal hashes, what is shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logscope.operators import errors


def expected(texts, n):
    counted = Counter(t for t in texts if "error" in t.lower())
    return [(c, t) for t, c in sorted(counted.items(), key=lambda x: (x[1], x[0].encode()), reverse=True)[:n]]


def top(df, n, **how):
    return [(r.occurrences, r.message) for r in errors.top_errors(df, n, **how).orderBy(F.desc("occurrences"), F.desc("message")).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50])
def test_ties_beyond_the_first_characters(lines, n):
    """Many lines share count and first characters with the n-th place."""
    lead = "x" * errors.LEAD
    texts = [f"{lead} error {i:03d}" for i in range(40)] * 2 + [f"{lead} error 000"] + ["ERROR a", "error b", "error b", "error b", "é error", "plain"] + [f"{lead} error 007"] * 3
    random.Random(1).shuffle(texts)
    assert top(lines(*texts), n) == expected(texts, n)


def test_random_lines(lines):
    rng = random.Random(7)
    for alphabet, length in (("ab", 3), ("aé🎉z", 30)):
        texts = ["error " + "".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(400)]
        for n in (1, 4, 9):
            assert top(lines(*texts), n) == expected(texts, n)


def test_by_file(lines):
    rng = random.Random(3)
    rows = [(rng.choice("pqr"), i, f"error {rng.randrange(6)}" + "-" * 40 + rng.choice("ab")) for i in range(300)] + [(None, 1, "error of no file")]
    found = {}
    for r in errors.top_errors(lines(rows), 3, by_file=True).collect():
        found.setdefault(r.file, set()).add((r.occurrences, r.message))
    for file in ("p", "q", "r", None):
        assert found[file] == set(expected([t for f, _, t in rows if f == file], 3))


def test_no_errors(lines):
    assert top(lines("fine", "also fine"), 5) == []
    assert errors.top_errors(lines("fine"), 5, by_file=True).collect() == []


def test_equal_hashes_are_told(lines, monkeypatch):
    """With a hash that is the same for all lines, a merged count is found out instead of returned."""
    real = F.xxhash64
    monkeypatch.setattr(errors.F, "xxhash64", lambda *columns: real(columns[0]))
    lead = "x" * errors.LEAD
    for n in (1, 2):
        with pytest.raises(Exception, match="same hash"):
            top(lines(f"{lead} error a", f"{lead} error a", f"{lead} error b", "error c"), n)


def test_text_is_not_shuffled(spark, measured):
    """Bytes shuffled per different line stay far below its length."""
    long = 2000
    df = spark.range(20_000, numPartitions=4).select(
        F.lit("f").alias("file"), F.col("id").alias("line_no"),
        F.concat(F.lit("error "), F.sha2(F.col("id").cast("string"), 512), F.repeat(F.sha2((-F.col("id")).cast("string"), 512), (long - 134) // 128)).alias("line"),
    )
    rows, metrics = measured(lambda: errors.top_errors(df, 5).collect())
    assert len(rows) == 5 and 0 < metrics["shuffleWriteBytes"] < 20_000 * 120
