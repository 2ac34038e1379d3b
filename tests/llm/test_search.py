"""Ranked search by pipelined term owners against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logscope.llm import term_pipeline
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """Sorted (item_id, rank, doc_id, score) of all rows of items."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 100 - 75 + 75 * c.total() * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scores.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], start=1) if s < 0]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10, clash=False, **sizes):
    rows, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    if clash:
        extra = {c: F.lit("own") for c in ("shard", "bundle", "terms", "score", "item", "rank", "query", "df")}
        rows, asked = rows.withColumns(extra), asked.withColumns(extra)
    return sorted(map(tuple, term_pipeline.search(rows, asked, k, **sizes).collect()), key=repr)


def test_odd_rows(spark):
    docs = [(d, t) for d, t, *_ in cases.odd_rows()]
    items = [(1, "w1 w2 w3 W2"), (2, None), (3, "-- !"), (4, "Ñandú 🎉 é x"), (4, "a a line"), (None, "w7 one"), (5, "absent")]
    assert found(spark, docs, items, clash=True) == ranked(docs, items, 10)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ties_and_copies(spark, k):
    """A third of the rows are one text; scores tie in many ways."""
    rng = random.Random(k)
    docs = [(rng.choice([i, i // 2, None]), rng.choice(["hot common words here", " ".join(f"t{rng.randrange(9)}" for _ in range(rng.randrange(6)))])) for i in range(300)]
    items = [(i, " ".join(f"t{rng.randrange(12)}" for _ in range(4)) + rng.choice(["", " common hot"])) for i in range(12)]
    assert found(spark, docs, items, k) == ranked(docs, items, k)


def test_small_shards_and_bundles(spark):
    """Several shards and bundles, and owners that hold terms of every frequency."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{min(rng.randrange(1, 2000), rng.randrange(1, 2000))}" + " the" * rng.randrange(2) for _ in range(rng.randrange(1, 30)))) for i in range(1500)]
    items = [(i, " ".join(f"w{rng.randrange(1, 300)}" for _ in range(12)) + " the") for i in range(11)]
    assert found(spark, docs, items, bundle=4, shard_docs=16) == ranked(docs, items, 10)
