"""Substring, SimHash and suffix-array dedup against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logscope.llm import components as graph
from logscope.llm import simhash_dedup, substring_dedup, suffix_dedup
from tests.llm import cases


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_window(spark, data, clash=False, **options):
    done = substring_dedup.substring_dedup(cases.frame(spark, data, clash), **options)
    return rows(done.select("doc_id", "_n_words", "_n_removed", "_kept_sha256"))


def by_bytes(spark, data, clash=False, **options):
    done = suffix_dedup.suffix_dedup(cases.frame(spark, data, clash), **options)
    return rows(done.select("doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"))


@pytest.mark.parametrize("clash", [False, True])
def test_windows_of_odd_rows(spark, clash):
    data = cases.odd_rows()
    assert by_window(spark, data, clash) == sorted(cases.cut_windows(data, 13), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_windows_of_random_rows(spark, seed):
    data = cases.random_rows(seed, 60, 6, 40)
    assert by_window(spark, data, window=5, gram=2) == sorted(cases.cut_windows(data, 5), key=repr)
    assert by_window(spark, data, window=6, gram=6) == sorted(cases.cut_windows(data, 6), key=repr)


def test_windows_settle_in_buckets_too(spark):
    """Spread over tasks, hardly anything is settled where it is found."""
    data = cases.random_rows(9, 80, 5, 30)
    done = substring_dedup.substring_dedup(cases.frame(spark, data).repartition(40), window=5, gram=3)
    assert rows(done.select("doc_id", "_n_words", "_n_removed", "_kept_sha256")) == sorted(cases.cut_windows(data, 5), key=repr)


def test_kept_text_and_spans(spark):
    words = [f"w{i}" for i in range(40)]
    data = [(1, " ".join(words), "en", "s", 1), (2, "a b " + " ".join(words[5:25]) + " c", "en", "s", 1)]
    done = {r["doc_id"]: r for r in substring_dedup.substring_dedup(cases.frame(spark, data), keep_text=True).collect()}
    assert done[1]["_kept"] == data[0][1] and done[1]["_spans"] == []
    assert done[2]["_kept"] == "a b c" and [tuple(s) for s in done[2]["_spans"]] == [(2, 22)] and done[2]["text"] == data[1][1]


def test_empty_tables(spark):
    none = cases.frame(spark, [])
    assert substring_dedup.substring_dedup(none).count() == suffix_dedup.suffix_dedup(none).count() == simhash_dedup.simhash_dedup(none).count() == 0


@pytest.mark.parametrize("clash", [False, True])
def test_bytes_of_odd_rows(spark, clash):
    data = cases.odd_rows()
    assert by_bytes(spark, data, clash) == sorted(cases.cut_bytes(data, 400), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_bytes_of_random_rows(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randrange(20, 70))) for _ in range(12)]
    data = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(6))), "en", "s", 1) for k in range(50)]
    for length, gram in ((48, 16), (64, 48), (40, 8)):
        assert by_bytes(spark, data, length=length, gram=gram) == sorted(cases.cut_bytes(data, length), key=repr)


def test_bytes_kept(spark):
    data = [(1, "x" * 30 + "y" * 500, "en", "s", 1), (2, "y" * 20, "en", "s", 1)]
    done = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(cases.frame(spark, data), keep_text=True).collect()}
    assert bytes(done[1]["_kept"]) == b"x" * 30 and [tuple(s) for s in done[1]["_spans"]] == [(30, 530)]
    assert bytes(done[2]["_kept"]) == b"y" * 20


def test_blind_trie_sorts():
    rng = random.Random(3)
    for _ in range(200):
        strings = ["".join(rng.choice("ab") for _ in range(8)).encode() for _ in range(rng.randrange(1, 40))]
        leaves = suffix_dedup.blind_trie(strings)
        assert [strings[n] for leaf in leaves for n in leaf] == sorted(strings)
        assert all(len({strings[n] for n in leaf}) == 1 for leaf in leaves) and len(leaves) == len(set(strings))


@pytest.mark.parametrize("clash", [False, True])
def test_simhash_of_odd_rows(spark, clash):
    data = cases.odd_rows()
    done = simhash_dedup.simhash_dedup(cases.frame(spark, data, clash))
    got = rows(done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"))
    assert got == sorted(cases.components(data), key=repr)


def test_anchors_lose_no_link(spark):
    """Chains, hubs, crowds around an anchor, and the free bit."""
    rng = random.Random(11)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        hub = rng.getrandbits(64)
        prints |= {hub ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash_dedup.links(frame)).collect()}
    want = cases.linked(list(prints), 2)
    groups = {}
    for p, s in zip(prints, signed):
        groups.setdefault(want[p], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_long_chain(spark):
    links = spark.range(500).selectExpr("id AS a", "id + 1 AS b").unionAll(spark.range(600, 900).selectExpr("id AS a", "CAST(600 AS LONG) AS b"))
    roots = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert all(roots[n] == 0 for n in range(501)) and all(roots[n] == 600 for n in range(601, 900))


# -- similarity of shingle sets -----------------------------------------------------------


def variants(seed, groups, sizes, targets):
    """Texts with copies in which words are changed until the similarity is what was asked; and (first, second, similarity)."""
    rng = random.Random(seed)
    docs, pairs = [], []
    for k in range(0, 2 * groups, 2):
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.choice(sizes))]
        b, own, goal, j = list(a), cases.shingles(" ".join(a)), rng.uniform(*targets), 1.0
        while j > goal:
            b[rng.randrange(len(b))] = f"w{rng.randrange(5000)}"
            other = cases.shingles(" ".join(b))
            j = len(own & other) / len(own | other)
        docs += [(k, " ".join(a), "en", "s", 0), (k + 1, " ".join(b), "en", "s", 0)]
        pairs.append((k, k + 1, j))
    return docs, pairs


def test_similar_documents_recall(spark):
    """At similarities from 0.8 on 0.95 are found, below none."""
    docs, pairs = variants(3, 400, [30, 60, 150, 600], (0.8, 0.86))
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(cases.frame(spark, docs).repartition(4)).collect()}
    near = [got[b] == a for a, b, j in pairs if j >= 0.8]
    assert len(near) > 40 and sum(near) >= 0.95 * len(near)
    assert all(got[b] == b for a, b, j in pairs if j < 0.8)


def test_similar_documents_of_odd_rows(spark):
    rows = cases.odd_rows()
    got = simhash_dedup.similar_documents(cases.frame(spark, rows, clash=True)).collect()
    assert Counter(map(tuple, got)) == Counter(cases.similar(rows))
    assert simhash_dedup.similar_documents(cases.frame(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    """One text with a word changed here and there, thousands of times, among strangers that share its first words."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(1500):
        own = list(base)
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own), "en", "s", 0))
    rows += [(5000 + k, " ".join(base[:60] + [f"y{rng.randrange(10**6)}" for _ in range(140)]), "en", "s", 0) for k in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(cases.frame(spark, rows).repartition(4)).collect()}
    assert all(got[k] == 0 for k in range(1500)) and all(got[5000 + k] == 5000 + k for k in range(200))


def test_near_copies_among_strangers_with_a_passage(spark):
    """Most of each text is one passage, so hundreds of strangers share fingerprints; copies with a word changed are found among them."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(110)]
    rows, near = [], {}
    for k in range(400):
        own = [f"o{k}x{i}" for i in range(40)]
        rows.append((k, " ".join(passage + own), "en", "s", 0))
        if k % 8 == 0:
            own[-1] = "changed"
            near[1000 + k] = k
            rows.append((1000 + k, " ".join(passage + own), "en", "s", 0))
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(cases.frame(spark, rows).repartition(4)).collect()}
    assert sum(got[d] == k for d, k in near.items()) >= 0.95 * len(near)
    assert all(got[k] == k for k in range(400))


def test_shingle_sets_are_freed(spark):
    """The sets of all documents, most of what the near-dedup writes, do not lie beside the stages that follow."""
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    done = simhash_dedup.similar_documents(cases.frame(spark, cases.odd_rows()))
    left = {p.name.split("-")[1] for p in set(folder.iterdir()) - before}
    assert "members" in left and "sets" not in left and done.count() == len(cases.odd_rows())
