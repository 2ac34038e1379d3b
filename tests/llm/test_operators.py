"""Packing, classifiers, rules, extraction, mixing and search."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from check_queries import compare
from logscope.llm import bin_packing, hamming_search, html_wrappers, license_scan, quality_rules, source_mixing, weak_labels
from logscope.llm.catalog import ORACLES
from tests.llm import cases

SF = cases.SF


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_sql(spark, db, name):
    assert compare(spark, db, SF, name).startswith("ok")


# -- best-fit packing -------------------------------------------------------------------


def plain_best_fit(sizes, sources, clusters, capacity):
    """Looks at every bin: the tightest compatible one, of equally tight ones the first that became so."""
    room, held, since, placed = [], [], [], []
    for step, (size, s, c) in enumerate(zip(sizes, sources, clusters)):
        fits = [(room[b], since[b], b) for b in range(len(room)) if room[b] >= size and not held[b][0] & s and not held[b][1] & c]
        b = min(fits)[2] if fits else len(room)
        if not fits:
            room.append(capacity), held.append([0, 0]), since.append(0)
        room[b] -= size
        held[b][0] |= s
        held[b][1] |= c
        since[b] = step
        placed.append(b)
    return placed


def test_best_fit_is_tightest():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 80)
        sizes = sorted((rng.randrange(1, 41) for _ in range(n)), reverse=True)
        sources = [1 << rng.randrange(3) if rng.random() < 0.5 else 0 for _ in range(n)]
        clusters = [1 << rng.randrange(9) if rng.random() < 0.3 else 0 for _ in range(n)]
        got = bin_packing.best_fit(sizes, sources, clusters, 40)
        assert got == plain_best_fit(sizes, sources, clusters, 40)


def check_packing(rows, docs, capacity):
    bins, pieces = defaultdict(list), Counter()
    source = {d: s for d, _, _, s, _ in docs}
    text = {d: " ".join(cases.words(t)) for d, t, *_ in docs}
    for r in rows:
        pieces[r["doc_id"], r["copy"]] += r["n_words"]
        if r["n_words"]:
            bins[r["shard"], r["bin"]].append(r)
        else:
            assert r["bin"] is None
    for own in bins.values():
        assert sum(r["n_words"] for r in own) == own[0]["bin_words"] <= capacity
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len({source[r["doc_id"]] for r in own}) == len({text[r["doc_id"]] for r in own}) == len(own)
    times = Counter(d for d, *_ in docs)
    assert sum(pieces.values()) == sum(len(cases.words(t)) for _, t, *_ in docs)
    assert all(pieces[d, c] == len(cases.words(text[d])) for d in times for c in range(1, times[d] + 1))
    return len(bins)


@pytest.mark.parametrize("shard", [5, 4096])
def test_packing_of_random_rows(spark, shard):
    docs = cases.random_rows(3, 120, 5, 50)
    check_packing(bin_packing.pack(cases.frame(spark, docs), capacity=64, shard=shard).collect(), docs, 64)


def test_packing_of_odd_rows(spark):
    docs = [r for r in cases.odd_rows() if r[0] is not None]
    for clash in (False, True):
        check_packing(bin_packing.pack(cases.frame(spark, docs, clash), capacity=512).collect(), docs, 512)
    with_null = bin_packing.pack(cases.frame(spark, cases.odd_rows())).collect()
    assert sum(r["n_words"] for r in with_null) == sum(len(cases.words(t)) for _, t, *_ in cases.odd_rows())
    assert bin_packing.pack(cases.frame(spark, [])).count() == 0


# -- classifiers and rules ----------------------------------------------------------------


def test_weak_labels_agree_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    done = weak_labels.weak_labels(spark.read.parquet(f"{sf}/documents.parquet"))
    known = done.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", (F.col("score") >= 0.5).cast("int").alias("kept"), (F.col("posterior") >= 0.5).cast("int").alias("weak"))
    rows = known.collect()
    assert sum(r["quality"] == r["kept"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["quality"] == r["weak"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["kept"] for r in rows if r["quality"]) >= 0.97 * sum(r["quality"] for r in rows)


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(1)
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.8]
    counts, truth = Counter(), defaultdict(Counter)
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = [0 if rng.random() < 0.3 else (1 if good == (rng.random() < p) else 2) for p in right]
        pattern = sum(v * 3**k for k, v in enumerate(votes))
        counts[pattern] += 1
        truth[pattern][good] += 1
    posterior, chance = weak_labels.expectation_maximisation(counts)
    for k, p in enumerate(right):
        assert abs(chance[k, weak_labels.GOOD, 1] / (1 - chance[k, 0, 1]) - p) < 0.05
    hits = sum(n[posterior[x] >= 0.5] for x, n in truth.items())
    assert hits >= 0.93 * 20_000


def test_weak_labels_of_odd_rows(spark):
    rows = weak_labels.weak_labels(cases.frame(spark, cases.odd_rows(), clash=True)).collect()
    assert len(rows) == len(cases.odd_rows()) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert weak_labels.weak_labels(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("clash", [False, True])
def test_base_statistics(spark, clash):
    data = cases.odd_rows() + cases.random_rows(8, 60, 3, 60)
    stats = quality_rules.statistics(cases.frame(spark, data, clash)).withColumn("failed", quality_rules.base_failed())
    got = Counter((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")]) for r in stats.collect())
    assert got == Counter((doc, *cases.base_statistics(text)) for doc, text, *_ in data)


def test_rules_are_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    done, rules = quality_rules.quality_rules(docs, labels)
    assert rules and all(len(r) <= quality_rules.CONDITIONS for r in rules)
    rows = done.join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] == (r["rule"] is None) for r in rows)
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.98 * len(rows)
    assert not any(r["kept"] for r in done.where("base_failed").collect())
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == done.where("kept").count()


def test_rules_need_both_kinds_of_labels(spark):
    docs = cases.frame(spark, cases.odd_rows())
    for labels in ([], [(k, 1, 0) for k in range(20)], [(k, None, None) for k in range(5)], [(None, 0, 1)]):
        done, rules = quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert not rules and all(r["kept"] == (not r["base_failed"]) for r in done.collect())
    assert quality_rules.quality_rules(cases.frame(spark, []), spark.createDataFrame([], "doc_id long, quality int"))[0].count() == 0


def test_grown_rule_is_a_conjunction(spark):
    """Bad is what has symbols and short words; neither alone."""
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(600):
        symbols, short = rng.random() < 0.5, rng.random() < 0.5
        word = "ab" if short else "abcdefghij"
        text = " ".join(f"{word}{rng.randrange(9)}{chr(97 + rng.randrange(26))}{'#' if symbols else ''}" for _ in range(60))
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, 0 if symbols and short else 1))
    done, rules = quality_rules.quality_rules(cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"))
    want = dict(labels)
    assert all(r["kept"] == (want[r["doc_id"]] == 1) for r in done.collect()), [[str(c) for c in r] for r in rules]


def test_rules_meet_texts_without_words(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    blank = [(10**6 + k, text, "en", "s", 0) for k, text in enumerate([None, "", " \n\t"])]
    docs = docs.unionByName(cases.frame(spark, blank))
    done, rules = quality_rules.quality_rules(docs, labels)
    assert rules
    rows = [r for r in done.collect() if r["doc_id"] >= 10**6]
    assert len(rows) == 3 and all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows)
    assert quality_rules.kept_documents(docs, labels).count() == done.where("kept").count()


def test_license_notices_are_found(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 30))).capitalize() + "."
    notices = [t for _, t in license_scan.TEMPLATES]
    docs, want = [], set()
    for k in range(300):
        text = [prose() for _ in range(rng.randrange(1, 6))]
        if k % 10 == 0:
            at = rng.randrange(len(text) + 1)
            text.insert(at, notices[k // 10 % len(notices)])
            want.add((k, at, license_scan.TEMPLATES[k // 10 % len(notices)][0]))
        docs.append((k, "\n".join(text), "en", "s", 0))
    docs += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (0, docs[0][1], "en", "s", 0), (None, "Released under the MIT License.", None, None, None)]
    rows = license_scan.scan(cases.frame(spark, docs, clash=True)).collect()
    found = Counter((r["doc_id"], r["line_no"], r["family"]) for r in rows if r["confirmed"])
    assert set(found) == want | {(None, 0, "MIT")} and found[0, [a for k, a, _ in want if k == 0][0], "MIT"] == 2
    assert license_scan.scan(cases.frame(spark, []), cases.frame(spark, docs)).count() == 0


# -- pages ----------------------------------------------------------------------------------


def page(body, nav="<a href='/'>Home</a>"):
    return f"<html><head><title>t</title><script>if (a<b) x='</p>';</script></head><body><nav>{nav}</nav>{body}<footer>&copy; us</footer></body></html>"


def test_extraction_of_pages(spark):
    cases_ = {
        "article": (page("<article><h1>A &amp; B</h1><p>one<br>two <b>three</b><p>four &eacute;&nbsp;x</article>"), "A & B\none two three\nfour é x"),
        "ad inside": (page("<article><p>text</p><div class='ad-box'>buy</div><div class='share'>tweet</div><p>more</p></article>"), "text\nmore"),
        "comments": (page("<article><p>text</p></article><section id='comments'><article><p>first!</p></article></section>"), "text"),
        "form": (page("<main><p>text</p><form><p>name</p></form><aside>see also</aside></main>"), "text"),
        "cookie": (page("<div class='cookie notice'>We use cookies</div><article>plain text</article>"), "plain text"),
        "list": (page("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>"), "a\nb\n1 2"),
        "header": (page("<header>Site</header><article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>"), "Title\nx"),
        "unclosed": ("<html><body><article><p>cut &amp", "cut &"),
        "no tags": ("just text", "just text"),
        "broken": ("<p <b>a</b", "a</b"),
        "empty": ("", ""),
        "null": (None, ""),
        "comment only": ("<!-- <p>no</p> -->", ""),
        "cut in a tag": ("<body><article><p>text</p><a href='x", "text"),
        "less than": ("<article><p>a < b &lt; c</article>", "a < b < c"),
        "hostile": ("<article>x" + "<a " * 40_000 + "</article>", "x" + "<a " * 39_999 + "<a"),
        "deep": ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    }
    rows = [(k, f"https://h{k}.example.com/", html) for k, (html, _) in enumerate(cases_.values())]
    rows += [(0, "https://h0.example.com/", rows[0][2]), (None, None, rows[0][2])]
    got = html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "path": F.lit(3)}))
    found = defaultdict(list)
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        found[r["page_id"]].append(r["text"])
    for k, (name, (_, text)) in enumerate(cases_.items()):
        if name != "broken":
            assert set(found[k]) == {text}, name
    assert len(found[0]) == 2 and found[None] == [cases_["article"][1]]
    assert html_wrappers.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_of_a_host(spark):
    item = lambda n: "<ul>" + "".join(f"<li>{i}</li>" for i in range(n)) + "</ul>"
    pages = [
        "<body><div class=menu>Home</div><div id=c><h2>First</h2><p>long text one</p></div></body>",
        "<body><div class=menu>Home</div><div id=c><h2>Second</h2><p>long text two</p><p>and three</p>" + item(3) + "</div></body>",
    ]
    rows = [(k, "http://x.org/a", p) for k, p in enumerate(pages)]
    made = html_wrappers.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert re.sub("^<#root>|</#root>$", "", made["wrapper"]) == (
        "<body><div menu>Home</div><div c><h2>#</h2>(<p>#</p>)+(<ul>(<li>#</li>)+</ul>)?</div></body>"
    )
    assert made["path"] == '["body", "div c"]'


def test_pages_without_article_are_learned_from_the_host(spark):
    rows = [(k, "http://x.org/", page(f"<div class=wrap><div class=sidebar>links</div><div class=story><p>{'word ' * (20 + k)}</p></div></div>")) for k in range(6)]
    got = html_wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: ("word " * (20 + k)).strip() for k in range(6)}


def test_pages_of_the_tables(spark, db):
    want = set()
    for k, url, html_text in db.sql("SELECT page_id, url, html FROM pages").fetchall():
        body = re.search("<article>(.*?)</article>", html_text, re.S)[1]
        parts = [" ".join(html_wrappers.html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        text = "\n".join(x for x in parts if x)
        want.add((k, url, text, len(text)))
    assert {tuple(r) for r in html_wrappers.op7_html_wrappers(spark, SF).collect()} == want


# -- mixing -----------------------------------------------------------------------------------


def test_mixing_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "b").when(F.col("id") % 4 == 1, None).otherwise("a").alias("source"), F.lit("own").alias("rate"))
    weights = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 0.5), ("b", 0.5), ("c", 9.0)], "source string, weight double")
    done = source_mixing.mix_sources(docs, weights, rows=40_000)
    n = {r["source"]: r["count"] for r in done.groupBy("source").count().collect()}
    assert all(abs(n[s] - share * 40_000) < 5 * math.sqrt(share * 40_000) for s, share in (("a", 0.25), (None, 0.5), ("b", 0.25)))
    again = {tuple(r) for r in source_mixing.mix_sources(docs.repartition(9), weights, rows=40_000).collect()}
    assert again == {tuple(r) for r in done.collect()} and len(again) == sum(n.values())
    copies = done.where("source IS NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("_copy").alias("last")).collect()
    assert all(r["n"] == r["last"] for r in copies)
    mean = sum(r["n"] for r in copies) / 1000
    variance = sum((r["n"] - mean) ** 2 for r in copies) / 1000
    assert abs(mean - 20) < 1 and abs(variance - 20) < 5


def test_mixing_inverts_the_distribution(spark):
    for rate in (0.01, 1.0, 30.0, 5000.0):
        got = spark.range(1).select(source_mixing._distribution(F.lit(rate)).alias("d")).first()["d"]
        assert abs(got[-1] - 1) < 1e-9 and all(a <= b + 1e-15 for a, b in zip(got, got[1:]))
        k = int(rate)
        want = sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k + 1))
        assert abs(got[k] - want) < 1e-9


def test_mixing_of_odd_rows(spark):
    data = cases.odd_rows()
    done = source_mixing.mix_sources(cases.frame(spark, data, clash=True), rows=3000)
    assert 2500 < done.count() < 3500 and set(cases.CLASHES) <= set(done.columns)
    order = [r["_shuffle_key"] for r in done.coalesce(1).collect()]
    assert len(order) == done.count() and source_mixing.mix_sources(cases.frame(spark, [])).count() == 0
    none = spark.createDataFrame([("other", 1.0)], "source string, weight double")
    assert source_mixing.mix_sources(cases.frame(spark, data), none).count() == 0


# -- search -----------------------------------------------------------------------------------


def brute_search(rows, queries, k):
    rows = sorted({(i, c) for i, c in rows if c is not None and i is not None})
    out = set()
    for q, code in {(i, c) for i, c in queries if c is not None and i is not None}:
        best = sorted((((code ^ c) & (1 << 64) - 1).bit_count(), i) for i, c in rows if i != q)[:k]
        out |= {(q, rank, i, d) for rank, (d, i) in enumerate(best, start=1)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_search_is_exact(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(400):
        code = rng.choice(centres)
        for _ in range(rng.choice([0, 0, 1, 3, 8, 30])):
            code ^= 1 << rng.randrange(64)
        rows.append((i, code - (1 << 64) if code >> 63 else code))
    rows += [(5000, None), (None, 5), rows[0]]
    frame = spark.createDataFrame(rows, "id long, code long").withColumn("distance", F.lit("own"))
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = hamming_search.top_k(frame, frame.where("id % 20 = 0"), 7)
    assert {tuple(r) for r in got.collect()} == brute_search(rows, queries, 7)


def test_search_of_few_rows(spark):
    frame = spark.createDataFrame([(1, 0), (2, -1), (3, 0)], "id long, code long")
    assert {tuple(r) for r in hamming_search.top_k(frame, frame, 5).collect()} == {(1, 1, 3, 0), (1, 2, 2, 64), (3, 1, 1, 0), (3, 2, 2, 64), (2, 1, 1, 64), (2, 2, 3, 64)}
    assert hamming_search.top_k(frame.limit(0), frame, 5).count() == hamming_search.top_k(frame, frame.limit(0), 5).count() == 0


def test_codes(spark):
    vectors = [([1.0, -1.0] * 32,), ([0.5] * 64,), ([0.5] * 100,), ([1.0],), ([None, 2.0],), ([],), (None,)]
    got = [r["c"] for r in spark.createDataFrame(vectors, "v array<float>").select(hamming_search.code(F.col("v")).alias("c")).collect()]
    assert got == [-0x5555555555555556, -1, -1, -(1 << 63), 1 << 62, None, None]
