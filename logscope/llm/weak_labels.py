"""Quality classifier from weak labels.

Eight overlapping heuristics vote good, bad or nothing on each document. Expectation-maximisation estimates, without
any true label, how often good and bad documents get each vote, and from that the posterior of each vote pattern. A
linear scorer on hashed word shapes is trained on posteriors as soft labels, and scores every document.

One pass over the texts gives per document its pattern and its hashed features, as a narrow table; the rest works on
that. Patterns are counted over all documents, and there are 3 ** 8 of them at most, so EM has an input of fixed size.
The scorer is trained on the ``TRAINED`` documents with the least hash (a bounded sample of weakly labelled rows, as a
parameter) in one task. Weights are broadcast; their number is ``FEATURES``.

Word shapes: letters to ``a`` or ``A``, digits to ``0``, other characters as they are, runs of one kind as one.

Defined results: a null or blank text has no words; only the length heuristic votes (bad) and no feature is set;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import common

FEATURES = 1 << 12
TRAINED = 20_000
EPOCHS, RATE, PENALTY = 200, 4.0, 1e-5
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Statistic, bad if at least (or, with "<", below), good if below (or at least). Else, or without a bound, a heuristic abstains.
HEURISTICS = (
    ("words", "<", 5, 50), ("symbols", ">", 0.1, None), ("shouts", ">", 0.1, None), ("capitals", ">", 0.5, None),
    ("echo", ">", 0.1, None), ("distinct", "<", 0.35, 0.5), ("same_lines", ">", 0.2, None), ("oddities", ">", 0.3, 0.02),
)
_ROWS = "doc_id long, votes int, places binary, values binary, order long"

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _described(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of each text its vote pattern and its hashed features."""
    data, text_starts = common.joined(texts)
    n = len(texts)
    starts, ends = common.words(data)
    doc = np.searchsorted(text_starts, starts, "right") - 1

    def per_doc(mask_at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(text_starts, mask_at, "right") - 1, minlength=n + 1)[:n].astype(float)

    def count(values: str) -> np.ndarray:
        return per_doc(np.flatnonzero(np.isin(data, np.frombuffer(values.encode(), np.uint8))))

    words = np.bincount(doc, minlength=n).astype(float)
    h = common.rolling(common.byte_values(data), starts, ends)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    new = common.run_starts(doc[order], h[order]) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(doc[order][new], minlength=n)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    full = np.searchsorted(starts, breaks) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], breaks[full]
    line_doc = np.searchsorted(text_starts, line_starts, "right") - 1
    line_hash = common.rolling(common.byte_values(data), line_starts, line_ends)
    by = np.lexsort((line_hash, line_doc))
    new = common.run_starts(line_doc[by], line_hash[by]) if len(by) else np.zeros(0, bool)
    lines = np.bincount(line_doc, minlength=n)
    same = lines - np.bincount(line_doc[by][new], minlength=n)
    kinds = _KIND[data]
    capitals, letters = per_doc(np.flatnonzero(kinds == 65)), per_doc(np.flatnonzero((kinds == 65) | (kinds == 97)))
    statistic = {
        "words": words, "symbols": _share(count("#*$%&|<>"), words), "shouts": _share(count("!"), words),
        "capitals": _share(capitals, letters), "echo": _share(np.bincount(doc[echo], minlength=n), words),
        "distinct": _share(distinct, words), "same_lines": _share(same, lines),
    }
    statistic["oddities"] = sum(statistic[k] for k in ("symbols", "shouts", "echo", "same_lines"))
    votes = np.zeros(n, np.int64)
    for k, (name, side, bad, good) in enumerate(HEURISTICS):
        x = statistic[name]
        is_bad = x < bad if side == "<" else x >= bad
        is_good = False if good is None else x >= good if side == "<" else x < good
        vote = np.where(is_bad, BAD, np.where(is_good, GOOD, ABSTAIN))
        votes += np.where((words == 0) & (name != "words"), ABSTAIN, vote) * 3**k

    first = np.zeros(len(data), bool)
    first[starts] = True
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    keep[1:] &= (kinds[1:] != kinds[:-1]) | first[1:]
    shape_at = np.concatenate([[0], np.cumsum(keep)])
    shapes = common.rolling(common.byte_values(kinds[keep]), shape_at[starts], shape_at[ends])
    pair = np.concatenate([shapes[:1], common.mix(shapes[:-1] * np.uint64(3) + shapes[1:])]) if len(shapes) else shapes
    slots = np.concatenate([shapes, np.where(echo, common.mix(~pair), pair)]) % np.uint64(FEATURES)
    key, n_key = np.unique(np.tile(doc, 2) * FEATURES + slots.astype(np.int64), return_counts=True)
    owner, bounds = key // FEATURES, np.searchsorted(key // FEATURES, np.arange(n + 1))
    value = np.sqrt(n_key / np.maximum(words[owner], 1)).astype(np.float32)
    return votes, [((key[a:b] % FEATURES).astype(np.uint16), value[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for lo, hi in common.steps(batch, "text"):
            votes, features = _described(batch.column("text")[lo:hi])
            own = np.asarray(ids[lo:hi].fill_null(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([
                ids[lo:hi], pa.array(votes, pa.int32()), pa.array([p.tobytes() for p, _ in features], pa.binary()),
                pa.array([v.tobytes() for _, v in features], pa.binary()), pa.array(common.mix(own).view(np.int64)),
            ], ["doc_id", "votes", "places", "values", "order"])


def expectation_maximisation(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """The posterior that a pattern is good, and per heuristic the chance of each vote given bad (0) and good (1)."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    posterior = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    for _ in range(rounds):
        weight = np.stack([n * (1 - posterior), n * posterior])
        chance = np.stack([[weight[:, votes[:, k] == v].sum(1) for v in range(3)] for k in range(len(HEURISTICS))])
        chance = (chance + 0.1) / (chance + 0.1).sum(1, keepdims=True)
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        log = np.log(prior) + sum(np.log(chance[k])[votes[:, k]] for k in range(len(HEURISTICS)))
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(before - posterior).max() < 1e-9:
            break
    return dict(zip(patterns.tolist(), posterior.tolist())), chance


def _matrix(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each feature that is set."""
    places = [np.frombuffer(x, np.uint16) for x in rows.column("places").to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in rows.column("values").to_pylist()]
    at = np.repeat(np.arange(len(places)), [len(p) for p in places])
    return at, np.concatenate([*places, np.zeros(0, np.uint16)]).astype(np.int64), np.concatenate([*values, np.zeros(0, np.float32)]).astype(float)


def _trainer(posterior: dict[int, float]):
    def train(rows: pa.Table) -> pa.Table:
        """Logistic regression on soft labels by gradient descent with momentum; both classes weigh the same."""
        rows = rows.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("votes", "ascending")])
        y = np.array([posterior[v] for v in rows.column("votes").to_pylist()])
        at, place, value = _matrix(rows)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        weight = (y / share + (1 - y) / (1 - share)) / 2 / len(y)
        w, speed, bias, bias_speed = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
        for _ in range(EPOCHS):
            z = np.bincount(at, value * w[place], len(y)) + bias
            miss = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
            speed = 0.9 * speed - RATE * (np.bincount(place, value * miss[at], FEATURES) + PENALTY * w)
            bias_speed = 0.9 * bias_speed - RATE * miss.sum()
            w, bias = w + speed, bias + bias_speed
        return pa.table({"weights": pa.array([np.append(w, bias).tobytes()], pa.binary())})

    return train


def _scorer(posterior: dict[int, float], weights: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, value = _matrix(batch)
            z = np.bincount(at, value * weights[place], len(batch)) + weights[-1]
            weak = [posterior[v] for v in batch.column("votes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("votes"), pa.array(weak, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))],
                ["doc_id", "votes", "posterior", "score"],
            )

    return score


def weak_labels(docs: DataFrame, trained: int = TRAINED) -> DataFrame:
    """(doc_id, votes, posterior, score) per row of ``docs`` (doc_id, text, ...).

    ``votes`` is the pattern in base 3, ``posterior`` the chance by the heuristics alone that the document is good,
    ``score`` that chance by the trained scorer.
    """
    rows = common.written(docs.select("doc_id", "text").mapInArrow(_describe, _ROWS), "features")
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    if not counts:
        return rows.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"))
    posterior, _ = expectation_maximisation(counts)
    sample = rows.orderBy("order", "doc_id").limit(trained)
    weights = sample.groupBy(F.lit(0).alias("one")).applyInArrow(_trainer(posterior), "weights binary").first()["weights"]
    return rows.mapInArrow(_scorer(posterior, np.frombuffer(weights)), "doc_id long, votes int, posterior double, score double")


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = weak_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.withColumn("kept", F.col("score") >= 0.5)
