"""Rows that every operator must take, and brute-force versions of what the operators do."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for themselves or return.
CLASHES = ["places", "edges", "words", "n_words", "kept", "rule", "bucket", "bin", "shard", "copy", "fp", "component_id", "votes", "score", "line_no", "_text"]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(40)}" for _ in range(60))
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(30_000))
    texts = [
        None, "", " \n\t", "one", "one", "ÉÈ café ñandú   x", passage, passage, "before " + passage, passage + " after", long, "start " + long,
        "a " * 3000, "x" * 50_000, "A Line\nA Line\nB\n\nA Line", "MIXED Case # * $ text", "🎉 emoji 🎉 text",
    ]
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, passage, "en", "s1", 1), (None, None, None, None, None), (-5, passage + " tail", "en", "s0", 2), (99, "no source", None, None, None)]


def frame(spark, rows, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("own") for c in CLASHES}) if clash else df


def random_rows(seed: int, n: int, vocabulary: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = [" ".join(f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(longest))) for _ in range(n)]
    for k in range(0, n, 4):  # copies of parts, with other words around
        a = words(texts[k])
        texts[(k * 7 + 3) % n] += " " + " ".join(a[len(a) // 3 : 2 * len(a) // 3 + 5])
    return [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]


def cut_windows(rows: list[tuple], window: int) -> list[tuple]:
    """doc_id, words, words removed and the hash of the words kept, of each row."""
    first: dict[tuple, int] = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1 if doc is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def cut_bytes(rows: list[tuple], length: int) -> list[tuple]:
    """doc_id, bytes, bytes removed, runs removed and the hash of the bytes kept, of each row."""
    texts = [(doc, (text or "").encode()) for doc, text, *_ in rows]
    seen = Counter(t[i : i + length] for doc, t in texts if doc is not None for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        change = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1 if doc is not None else 0):
            if seen[t[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def simhash(text: str | None) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints: list[int], threshold: int) -> dict[int, int]:
    """The least fingerprint that each reaches by links of ``threshold`` bits or fewer."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= threshold:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def components(rows: list[tuple]) -> list[tuple]:
    """doc_id, fingerprint and component_id of each row."""
    prints = [simhash(text) for _, text, *_ in rows]
    roots = linked(prints, 2)
    least: dict[int, int] = defaultdict(lambda: None)
    for (doc, *_), p in zip(rows, prints):
        if doc is not None and (least[roots[p]] is None or doc < least[roots[p]]):
            least[roots[p]] = doc
    return [(doc, f"{p:016x}", least[roots[p]]) for (doc, *_), p in zip(rows, prints)]


def base_statistics(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def shingles(text: str | None, n: int = 5) -> set[tuple]:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(rows: list[tuple], least: float = 0.8) -> list[tuple]:
    """doc_id and the least doc_id that links of this Jaccard similarity reach, of each row."""
    sets = [shingles(text) for _, text, *_ in rows]
    holders = defaultdict(list)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        met = Counter(j for s in own for j in holders[s]) if own else Counter({j: 0 for j in range(i) if not sets[j]})
        for j, both in met.items():
            if not own or both >= least * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    first = defaultdict(lambda: None)
    for i, (doc, *_) in enumerate(rows):
        if doc is not None and (first[find(i)] is None or doc < first[find(i)]):
            first[find(i)] = doc
    return [(doc, first[find(i)]) for i, (doc, *_) in enumerate(rows)]
