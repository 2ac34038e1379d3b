"""License notices as they stand in files: wrapped, and in comments."""

import itertools
import random
import re
import textwrap
import time

from logscope.llm import license_scan
from tests.llm import cases


def test_wrapped_notices_are_found(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 30))).capitalize() + "."
    long = [(f, t) for f, t in license_scan.TEMPLATES if len(t) > 100]
    docs, want = [], set()
    for k in range(300):
        before, after = prose(), "\n".join(prose() for _ in range(rng.randrange(1, 4)))
        docs.append((k, f"{before}\n\n{after}", "en", "s", 0))
        if k % 5 == 0:
            family, notice = long[k // 5 % len(long)]
            mark = rng.choice(["", " * ", "# ", "// ", "REM "])
            lines = [mark + x for x in textwrap.wrap(notice, rng.randrange(60, 81))]
            docs[-1] = (k, "\n".join([before, mark.rstrip() if mark != "REM " else "", *lines, "", after]), "en", "s", 0)
            want.add((k, 2, family))
    rows = license_scan.scan(cases.frame(spark, docs)).collect()
    found = [(r["doc_id"], r["line_no"], r["family"]) for r in rows if r["confirmed"]]
    assert sorted(found) == sorted(want)


# -- features and scores against plain Python ------------------------------------------------


def tokens(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(words):
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def units_of(text):
    """(first line, number of lines, words) of each run of lines with words that has several, and of each line."""
    lines = (text or "").split("\n")
    out, start = [], 0
    for key, run in itertools.groupby(lines, key=lambda x: bool(tokens(x))):
        run = list(run)
        if key:
            out += [(start + i, 1, tokens(x)) for i, x in enumerate(run)]
            if len(run) > 1:
                out.append((start, len(run), tokens(" ".join(run))))
        start += len(run)
    return out


def test_units_and_features(spark):
    rng = random.Random(2)
    words = ["license", "the", "under", "mit", "gnu", "general", "public", "x", "y", "Z", "É"]
    grams = ["license", "the", "under the", "under the mit", "the mit license", "gnu general public", "general public license", "public", "mit"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(6))) for _ in range(150)] + [None, "", "\n\n", "--\n**"]
    docs = cases.frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    known = sorted({w for g in grams for w in g.split()})
    got = license_scan._features(license_scan._units(docs, known), grams).collect()
    want = {(d, at, n): (w, grams_of(w) & set(grams)) for d, t in enumerate(texts) for at, n, w in units_of(t) if set(w) & set(known)}
    assert {(r.doc_id, r.line_no, r.n_lines): (r.tokens, set(r.grams)) for r in got} == want and len(got) == len(want)


def test_scores(spark):
    rng = random.Random(3)
    grams = [f"g{i}" for i in range(30)]
    weights = {g: [rng.uniform(-2, 2) for _ in license_scan.FAMILIES] for g in grams}
    intercepts = [rng.uniform(-1, 1) for _ in license_scan.FAMILIES]
    units = [(i, rng.sample(grams, rng.randrange(1, 9))) for i in range(200)]
    frame = spark.createDataFrame([(g, *w) for g, w in weights.items()], ["gram", *[f"w{k}" for k in range(len(license_scan.FAMILIES))]])
    got = {r.unit: (r.family, r.margin) for r in license_scan._scored(spark.createDataFrame(units, "unit long, grams array<string>"), ["unit"], frame, intercepts).collect()}
    for unit, own in units:
        z = [b + sum(weights[g][k] for g in own) for k, b in enumerate(intercepts)]
        best = max(range(1, len(z)), key=lambda k: z[k])
        assert got[unit][0] == license_scan.FAMILIES[best] and abs(got[unit][1] - (z[best] - z[0])) < 1e-9


def test_very_long_paragraphs_and_odd_rows(spark):
    """Paragraphs of 20,000 words, one with a notice in it, take seconds; rows of all kinds give what is said of them."""
    rng = random.Random(4)
    notice = license_scan.TEMPLATES[3][1]
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    prose = [(k, " ".join(word() for _ in range(40)) + ".\n" + " ".join(word() for _ in range(9)), "en", "s", 0) for k in range(200)]
    trained_on = cases.frame(spark, prose)
    long = " ".join(word() for _ in range(20_000)) + " license"
    wrapped = "\n".join(" ".join(word() for _ in range(10)) for _ in range(2000)) + "\nunder the license"
    within = "\n".join([" ".join(word() for _ in range(10))] * 1000 + [notice] + [" ".join(word() for _ in range(10))] * 1000)
    start = time.time()
    rows = [(301, long, "en", "s", 0), (302, wrapped, "en", "s", 0), (303, within, "en", "s", 0)] + cases.odd_rows()
    found = license_scan.scan(cases.frame(spark, rows, clash=True), trained_on).collect()
    assert [(r.doc_id, r.line_no, r.family) for r in found if r.confirmed] == [(303, 1000, "Apache-2.0")]
    assert time.time() - start < 150
