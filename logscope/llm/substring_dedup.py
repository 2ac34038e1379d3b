"""Substring dedup: repeated word windows by a compacted De Bruijn graph.

The edges of the graph are windows of 13 words; its nodes here are anchors, the 6-grams with the least hash of some
window, so that every window runs through an anchor that its words alone decide. The *path* through an anchor is all
words of all windows that hold it.

1. Every anchor sends the hash of its path and its place (document, word) to a bucket of its hash. Equal paths that
   meet in one task are settled there: all but those of the smallest document are repeats. Only the first goes on.
2. In its bucket, an anchor with one path only is a nonbranching node: the path is one compacted edge, a repeat in
   all documents but the first. An anchor with several paths branches: each first bearer of a path is listed.
3. The lists are joined with the documents. Branching anchors are resolved edge by edge: their windows are dealt to
   buckets of the windows' hashes, and those with a bearer in a smaller document are repeats.
4. The coordinates found are joined with the documents once more. Each is verified against the words that stand
   there before the words are removed.

A path counts as equal by 128 bits (the anchor's 64 and 64 of the path), a window by 128 bits.

Defined results: a null or blank text has no words and nothing removed; a row without doc_id is kept whole and removes
nothing elsewhere; rows that share a doc_id never remove from one another, and each gives a row of the result. Columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm import common

WINDOW = 13
GRAM = 6
#: Bytes of text whose anchors make up one bucket.
BUCKET_BYTES = 16 << 20

_VALUES = {"a": np.uint64, "c": np.uint64, "doc": np.int64, "pos": np.int32}
_MAIL = "bucket long, a binary, c binary, doc binary, pos binary, settled boolean"
_PLACE = "doc_id long, pos int, kind int, proof long"
PATH, BRANCH, EDGE = 0, 1, 2


class _Words:
    """The words of a run of documents: hashes, owners, least gram of each window, and the words joined by blanks."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        data, self.text_starts = common.joined(texts)
        starts, ends = common.words(data)
        self.window, self.gram, n = window, gram, len(starts)
        self.doc = np.searchsorted(self.text_starts, starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1), "left")
        self.plain, self.at = common.plain(data, starts, ends)
        self.hashes = common.rolling(common.byte_values(data), starts, ends)
        self.n, self.windows = n, max(0, n - window + 1)
        if self.windows:
            i = np.arange(n - gram + 1)
            self.grams = common.rolling(self.hashes, i, i + gram)
            self.whole = self.doc[: self.windows] == self.doc[window - 1 :]
            self.chosen, self.least = common.chosen(self.grams, self.whole, window - gram + 1)

    def anchors(self) -> np.ndarray:
        return self.chosen if self.windows else np.zeros(0, np.int64)

    def path(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the path through each anchor."""
        reach, doc = self.window - self.gram, self.doc[pos]
        return np.maximum(pos - reach, self.first[doc]), np.minimum(pos + self.window, self.first[doc + 1])

    def path_hashes(self, pos: np.ndarray) -> np.ndarray:
        begin, end = self.path(pos)
        text, digest = self.plain, xxhash.xxh3_64_intdigest
        return np.fromiter(
            (digest(text[a:b], s) for a, b, s in zip(self.at[begin].tolist(), (self.at[end] - 1).tolist(), (pos - begin).tolist())),
            np.uint64, len(pos),
        )

    def edges(self, pos: np.ndarray) -> np.ndarray:
        """The windows whose least gram is one of these anchors."""
        found = []
        for back in range(self.window - self.gram + 1):
            w, p = pos - back, pos
            inside = (w >= 0) & (w < self.windows)
            w, p = w[inside], p[inside]
            found.append(w[self.whole[w] & (self.least[w] == self.grams[p])])
        return np.unique(np.concatenate(found))

    def edge_hashes(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, digest = self.plain, xxhash.xxh3_128_digest
        raw = b"".join(
            digest(text[a:b]) for a, b in zip(self.at[begin].tolist(), (self.at[begin + self.window] - 1).tolist())
        )
        both = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id")
    return np.asarray(pc.fill_null(ids.cast(pa.int64()), 0)), np.asarray(ids.is_valid())


def _settle(a: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Sorted by (a, c, doc, pos); and whether a smaller document has the same (a, c)."""
    order = np.lexsort((pos, doc, c, a))
    a, c, doc, pos = a[order], c[order], doc[order], pos[order]
    return a, c, doc, pos, doc > common.spread(common.run_starts(a, c), doc) if len(a) else np.zeros(0, bool)


def _places(doc, pos, kind, proof) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(pos.astype(np.int32)), pa.array(np.broadcast_to(np.int32(kind), len(doc))),
         pa.array(proof.view(np.int64))],
        ["doc_id", "pos", "kind", "proof"],
    )


def _send(parts: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """What one task has found: first bearers by the bucket of their hash, settled repeats spread by document."""
    a, c, doc, pos, repeat = _settle(*(np.concatenate(x) for x in zip(*parts)))
    for settled, keys in ((False, a), (True, common.mix(doc.view(np.uint64)))):
        own = repeat == settled
        mail = common.dealt(keys[own], buckets, {"a": a[own], "c": c[own], "doc": doc[own], "pos": pos[own]})
        yield mail.append_column("settled", pa.array(np.full(len(mail), settled)))


def _paths(batches: Iterator[pa.RecordBatch], window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, known = _ids(batch)
        parts = []
        for lo, hi in common.steps(batch, "text"):
            w = _Words(batch.column("text")[lo:hi], window, gram)
            pos = w.anchors()
            pos = pos[known[lo + w.doc[pos]]]
            if len(pos):
                parts.append((w.grams[pos], w.path_hashes(pos), ids[lo + w.doc[pos]], (pos - w.first[w.doc[pos]]).astype(np.int32)))
        if parts:
            yield from _send(parts, buckets)


def _opened(mail: pa.Table):
    """The messages of a bucket, settled among themselves, and the repeats that were settled before."""
    known = mail.column("settled")
    _, c, doc, pos = common.gathered(mail.filter(known), _VALUES)
    return _settle(*common.gathered(mail.filter(pc.invert(known)), _VALUES)), (c, doc, pos)


def _resolve_paths(mail: pa.Table) -> pa.Table:
    (a, c, doc, pos, repeat), (known_c, known_doc, known_pos) = _opened(mail)
    anchor = np.cumsum(common.run_starts(a)) - 1
    paths = np.bincount(anchor, common.run_starts(a, c))[anchor] if len(a) else np.zeros(0)
    branch = ~repeat & (paths > 1)
    return pa.Table.from_batches([
        _places(known_doc, known_pos, PATH, known_c), _places(doc[repeat], pos[repeat], PATH, c[repeat]),
        _places(doc[branch], pos[branch], BRANCH, c[branch]),
    ])


def _edges(batches: Iterator[pa.RecordBatch], window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("_places")), 0))
        ids, _ = _ids(batch)
        lists, parts = batch.column("_places"), []
        for lo, hi in common.steps(batch, "text"):
            w = _Words(batch.column("text")[lo:hi], window, gram)
            pos = np.concatenate([w.first[r] + _listed(lists[lo + r], BRANCH)[0] for r in range(hi - lo)])
            pos = pos[pos < w.n - gram + 1] if w.windows else pos[:0]
            if not len(pos):
                continue
            begin = w.edges(pos)
            a, c = w.edge_hashes(begin)
            parts.append((a, c, ids[lo + w.doc[begin]], (begin - w.first[w.doc[begin]]).astype(np.int32)))
        if parts:
            yield from _send(parts, buckets)


def _resolve_edges(mail: pa.Table) -> pa.Table:
    (_, c, doc, pos, repeat), (known_c, known_doc, known_pos) = _opened(mail)
    return pa.Table.from_batches([_places(known_doc, known_pos, EDGE, known_c), _places(doc[repeat], pos[repeat], EDGE, c[repeat])])


def _listed(places, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and proofs of a kind in a list of places."""
    if not places.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kinds, pos, proof = (np.asarray(places.values.field(f)) for f in ("kind", "pos", "proof"))
    wanted = kinds == kind
    return pos[wanted].astype(np.int64), proof[wanted].view(np.uint64)


def _remove(batches: Iterator[pa.RecordBatch], window: int, gram: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, texts, spans = [], [], [], []
        for lo, hi in common.steps(batch, "text"):
            w = _Words(batch.column("text")[lo:hi], window, gram)
            change = np.zeros(w.n + 1, np.int32)
            for column in ("_places", "_edges"):
                for kind in (PATH, EDGE):
                    pos, proof = [], []
                    for r in range(hi - lo):
                        p, q = _listed(batch.column(column)[lo + r], kind)
                        fits = w.first[r] + p + (gram if kind == PATH else window) <= w.first[r + 1]
                        pos.append(w.first[r] + p[fits])
                        proof.append(q[fits])
                    pos, proof = np.concatenate(pos), np.concatenate(proof)
                    if kind == PATH:
                        pos, (begin, end) = pos[ok := w.path_hashes(pos) == proof], w.path(pos[ok])
                    else:
                        begin = pos[w.edge_hashes(pos)[1] == proof]
                        end = begin + window
                    np.add.at(change, begin, 1)
                    np.add.at(change, end, -1)
            gone = np.cumsum(change[:-1]) > 0
            for r in range(hi - lo):
                a, b = int(w.first[r]), int(w.first[r + 1])
                out = gone[a:b]
                counts.append((b - a, int(out.sum())))
                if out.any():
                    marks = np.flatnonzero(np.diff(np.concatenate([[1], out.view(np.int8), [1]])))
                    kept = b"".join(w.plain[w.at[a + x] : w.at[a + y]] for x, y in zip(marks[::2].tolist(), marks[1::2].tolist()))[:-1]
                    holes = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                    spans.append([{"start": x, "end": y} for x, y in zip(holes[::2].tolist(), holes[1::2].tolist())])
                else:
                    kept = w.plain[w.at[a] : w.at[b]][:-1]
                    spans.append([])
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if keep_text else b"")
        names = [n for n in batch.schema.names if n not in ("_places", "_edges") and (keep_text or n != "text")]
        columns = [batch.column(n) for n in names] + [
            pa.array([x for x, _ in counts], pa.int64()), pa.array([x for _, x in counts], pa.int64()), pa.array(digests, pa.string()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
        names += ["_n_words", "_n_removed", "_kept_sha256", "_spans"]
        if keep_text:
            names.append("_kept")
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names)


def _per_document(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "pos", "proof")).alias("_places"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) with ``_n_words``, ``_n_removed``, ``_kept_sha256`` and ``_spans``, the
    removed runs of words; with ``keep_text`` also the old text and ``_kept``, the words left, joined by blanks.

    Removed is each word of a window of ``window`` words that also starts in a document with a smaller doc_id.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    docs = docs.drop("_places", "_edges", "_n_words", "_n_removed", "_kept_sha256", "_spans", "_kept")
    buckets = common.bucket_count(docs, "text", BUCKET_BYTES)
    ours = docs.select("doc_id", "text")
    arguments = {"window": window, "gram": gram, "buckets": buckets}

    def resolved(sender, rows: DataFrame, resolver) -> DataFrame:
        return rows.mapInArrow(partial(sender, **arguments), _MAIL).groupBy("bucket").applyInArrow(resolver, _PLACE)

    places = common.written(_per_document(resolved(_paths, ours, _resolve_paths)), "places")

    def of_kind(kind: int) -> DataFrame:
        return places.withColumn("_places", F.filter("_places", lambda p: p["kind"] == kind))

    # Both joins are outer ones, so that the documents are shuffled once and read twice.
    branching = docs.join(of_kind(BRANCH), "doc_id", "left").select("doc_id", "text", "_places")
    edges = _per_document(resolved(_edges, branching, _resolve_edges)).withColumnRenamed("_places", "_edges")
    listed = docs.join(of_kind(PATH), "doc_id", "left").join(edges, "doc_id", "left")
    more = "_n_words long, _n_removed long, _kept_sha256 string, _spans array<struct<start:int,end:int>>"
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*fields, *T.StructType.fromDDL(more + (", _kept string" if keep_text else "")).fields])
    return listed.mapInArrow(partial(_remove, window=window, gram=gram, keep_text=keep_text), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = substring_dedup(docs)
    return done.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256")
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first_doc FROM p GROUP BY win HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM p JOIN f USING (win) WHERE first_doc < doc_id),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
