"""Personal data: base spans against plain patterns, discovery against scoring in plain Python, no Python on the main path."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logscope.llm import private_data
from tests.llm import cases

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0


def base(text):
    """(start, place of the kind, kind, end), as the contract's patterns give them."""
    out = []
    for at, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), at, kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def result(spark, rows, tmp_path, clash=False):
    frame = cases.frame(spark, [(d, t, "en", "s", 1) for d, t in rows])
    if clash:
        frame = frame.withColumns({c: F.lit("own") for c in ("row", "items", "email", "kind", "start", "end", "found", "value")})
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return private_data.op13_private_data(spark, str(tmp_path)).collect()


def check_base(rows, got):
    want = Counter()
    for d, t in rows:
        spans = base(t)
        want[(d, *[sum(s[2] == k for s in spans) for k in KINDS], hashlib.sha256(written(spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_odd_texts(spark, tmp_path):
    rows = [(d, t) for d, t, *_ in cases.odd_rows()] + [
        (201, "a@b.c a@b.c_x@d.e.f a@b@c.d x@y a.@-.- 🎉é@a.b @@a.b 1@2.3"), (202, "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3 1111.1.1.1.1 0000.0.0.0.0"),
        (203, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 4111111111111111 41111111111111111111 5 4111111111111111 x4111111111111111y"),
        (204, "+1 (743) 555-3824 +1 2 ++1234567890 +1234567890123456 +12(3).4-5 6 7 8 9 0. + 1234567890"), (205, "+4111 1111 1111 1111 and 10.0.0.1@a.b"),
        (206, "1" * 60_000), (207, "1 " * 30_000), (208, "x" * 60_000 + "@"), (209, "a@b" * 20_000), (210, "1." * 30_000), (211, "+1((((" * 10_000), (212, "." * 50_000 + "@a.b"),
        (213, "u@h.io, " * 3000), (214, "a." * 30_000 + "@x"), (215, "x@" + "a." * 30_000 + "b"),
    ]
    check_base(rows, result(spark, rows, tmp_path, clash=True))


def test_random_characters(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("0012345 .-+@ab_%()\né🎉") for _ in range(rng.randrange(120)))) for i in range(1500)]
    check_base(rows, result(spark, rows, tmp_path))


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()]
    got = private_data.op13_private_data(spark, cases.SF).collect()
    check_base(rows, got)
    assert all(r.spans.count(":") == 2 * (r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added) for r in got)


def test_empty_table(spark, tmp_path):
    assert result(spark, [], tmp_path) == []


def card(rng):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def corpus(seed=6):
    """Seeds in telling contexts, other spellings there and elsewhere, other numbers in other contexts."""
    rng = random.Random(seed)
    phone = lambda: f"{rng.randrange(200, 999)} {rng.randrange(200, 999)} {rng.randrange(1000, 9999)}"
    texts, planted = [], {}
    for _ in range(6):
        texts += [f"please call me at +1 {phone()} today", f"write to user{rng.randrange(10**6)}@mail.example.org soon", f"my card number {card(rng)} expires"]
    dotted = ".".join(re.findall("....", card(rng)))
    for text, part, kind in [
        ("please call me at 743 555 3824 tonight", "743 555 3824", "phone"), ("write to bob (at) example (dot) org today", "bob (at) example (dot) org", "email"),
        (f"his card number {dotted} was", dotted, "card"), ("in a list of 743 555 3824 alone", "743 555 3824", "phone"),
    ]:
        planted[len(texts)] = (text.index(part), part, kind)
        texts.append(text)
    texts += [f"order {rng.randrange(10**9, 10**10)} was shipped" for _ in range(8)] + ["in the year 1999 we had 200 units", "serial 1234567890 of the part"]
    return list(enumerate(texts)), planted


def test_discovery(spark, tmp_path):
    """Known contexts reveal other spellings, these are found in other places too, and plain numbers stay."""
    rows, planted = corpus()
    got = {r.doc_id: r for r in result(spark, rows, tmp_path)}
    check_base(rows, got.values())
    for d, text in rows:
        spans = base(text)
        if d in planted:
            start, part, kind = planted[d]
            spans.append((start, list(KINDS).index(kind), kind, start + len(part)))
        assert got[d].spans == written(spans), text
        assert got[d].n_added == (d in planted)


# -- scoring the graph in plain Python ----------------------------------------------------


def scored(items):
    """(kind, value): score of the known instances, by the rules of the docstring."""
    seeds = {(k, v) for k, seed, v, _ in items if seed}
    links = {(c, k, v) for k, _, v, contexts in items for c in contexts}
    known = {}
    for _ in range(private_data.ROUNDS):
        score = lambda k, v: 1.0 if (k, v) in seeds else known.get((k, v), 0.0)
        positive, every = defaultdict(float), defaultdict(float)
        for c, k, v in links:
            s = 1.0 if k is None else score(k, v)
            every[c] += s
            positive[c, k] += s
        open_ = defaultdict(float)
        for c, k, v in links:
            if k and (k, v) not in seeds and positive[c, k] >= private_data.SUPPORT:
                open_[k, v] += math.log(1 - positive[c, k] / (every[c] + 1))
        now = {i: 1 - math.exp(x) for i, x in open_.items() if 1 - math.exp(x) >= private_data.THRESHOLD}
        if now == known:
            break
        known = now
    return {**known, **dict.fromkeys(seeds, 1.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_against_plain_python(spark, seed):
    rng = random.Random(seed)
    items = []
    for _ in range(600):
        kind = rng.choice(["phone", "phone", "email", "card", None])
        value = f"{kind}{rng.randrange(40)}"
        items.append((kind, bool(kind) and rng.random() < 0.3, value, [f"c{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(3))]))
    frame = spark.createDataFrame(items, "kind string, seed boolean, value string, contexts array<string>")
    got = {(r.kind, r.value): r.score for r in private_data.discovered(frame).collect()}
    want = scored(items)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_no_python_on_executors(spark):
    plan = private_data.op13_private_data(spark, cases.SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
