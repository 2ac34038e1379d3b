"""Suffix-array dedup: bytes covered by a string of 400 bytes that starts anywhere else too.

Sorting all suffixes of a corpus is not needed to find long repeats. Every 400-byte string holds an *anchor*, its
320-byte gram with the least hash, which its bytes alone decide; so equal strings meet at equal anchors.

1. Anchors send a hash of their *surroundings* (all bytes of all strings that hold them) to buckets. Equal surroundings are
   repeats as a whole; those that meet in one task are settled there, and one of them goes on for all.
2. Surroundings that are alone, at an anchor that has others, may be repeated in part. They fetch the bytes on both
   sides of the gram (joined by document) and go to two buckets: by anchor and the 40 bytes before it, for strings
   that reach further left, and by anchor and the 40 bytes behind it, for those that reach further right.
3. A bucket sorts the suffixes that start at the possible starts, 41 a member, deep-shallow: multikey quicksort on
   characters of 8 bytes to a shallow depth, then a blind trie for each group that is still equal. Neighbours that
   agree to the full length are repeats.
4. The spans are joined with the documents, verified by the hash of the surroundings there, and removed.

Hashes are taken at 128 bits in all (64 of the gram and 64 of what is around it).

Defined results: a null text has no bytes; a row without doc_id is kept whole and is no occurrence; rows that share a
doc_id are occurrences of their own, so that a repeated row loses what is long enough in both; ``_kept`` may cut a
character in two, so it is binary; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm import common

LENGTH = 400
GRAM = 320
BUCKET_BYTES = 16 << 20
#: Bytes up to which suffixes are sorted by multikey quicksort.
SHALLOW = 16

_MAIL = {"a": np.uint64, "c": np.uint64, "doc": np.int64, "pos": np.int64, "many": np.uint8}
_PLACE = "doc_id long, start long, size long, pos long, proof long, kind int"
_NAMES = ["doc_id", "start", "size", "pos", "proof", "kind"]
SPAN, BRANCH = 0, 1


class _Bytes:
    """The bytes of a run of documents, their grams and anchors."""

    def __init__(self, texts: pa.Array, length: int, gram: int):
        self.data, self.starts = common.joined(texts)
        self.length, self.gram, self.reach = length, gram, length - gram
        self.raw = self.data.tobytes()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        n = len(self.data)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        i = np.arange(n - self.gram + 1)
        grams = common.rolling(common.byte_values(self.data), i, i + self.gram)
        i = i[: n - self.length + 1]
        end = np.repeat(self.starts[1:] - 1, np.diff(self.starts))[: len(i)]
        pos, _ = common.chosen(grams, i + self.length <= end, self.reach + 1)
        return pos, grams[pos]

    def around(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, begin and end of the surroundings of each anchor."""
        doc = np.searchsorted(self.starts, pos, "right") - 1
        return doc, np.maximum(pos - self.reach, self.starts[doc]), np.minimum(pos + self.length, self.starts[doc + 1] - 1)

    def hashes(self, pos: np.ndarray) -> np.ndarray:
        _, begin, end = self.around(pos)
        raw, digest = self.raw, xxhash.xxh3_64_intdigest
        return np.fromiter((digest(raw[a:b], s) for a, b, s in zip(begin.tolist(), end.tolist(), (pos - begin).tolist())), np.uint64, len(pos))


def _places(doc, start, size, pos, proof, kind) -> pa.RecordBatch:
    n = len(doc)
    columns = [np.broadcast_to(np.asarray(x, np.int64), n) for x in (doc, start, size, pos)]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), pa.array(np.asarray(proof).view(np.int64)), pa.array(np.full(n, kind, np.int32))], _NAMES
    )


def _classes(a, c, *rest):
    """Rows sorted by (a, c); the number of the class of each, and the first row of each class."""
    order = np.lexsort((c, a))
    a, c, rest = a[order], c[order], [x[order] for x in rest]
    new = common.run_starts(a, c)
    return a, c, rest, np.cumsum(new) - 1, np.flatnonzero(new)


def _sender(length: int, gram: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One message per different surroundings; all of those that are repeated here, spread by document, are settled."""
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids, parts = np.asarray(batch.column("doc_id").cast(pa.int64())), []
            for lo, hi in common.steps(batch, "text"):
                b = _Bytes(batch.column("text")[lo:hi], length, gram)
                pos, a = b.anchors()
                if len(pos):
                    doc, begin, end = b.around(pos)
                    parts.append((a, b.hashes(pos), ids[lo + doc], pos - b.starts[doc], begin - b.starts[doc], end - begin))
            if not parts:
                continue
            a, c, (doc, pos, start, size), of, first = _classes(*(np.concatenate(x) for x in zip(*parts)))
            many = np.bincount(of) > 1
            mail = common.dealt(a[first], buckets, {
                "a": a[first], "c": c[first], "doc": doc[first], "pos": pos[first], "many": many.astype(np.uint8),
                "start": start[first], "size": size[first],
            })
            yield mail.append_column("settled", pa.array(np.full(len(mail), False)))
            known = many[of]
            mail = common.dealt(common.mix(doc[known].view(np.uint64)), buckets, {
                "a": a[known], "c": c[known], "doc": doc[known], "pos": pos[known], "many": np.ones(int(known.sum()), np.uint8),
                "start": start[known], "size": size[known],
            })
            yield mail.append_column("settled", pa.array(np.full(len(mail), True)))

    return send


_SENT = "bucket long, a binary, c binary, doc binary, pos binary, many binary, start binary, size binary, settled boolean"
_VALUES = {**_MAIL, "start": np.int64, "size": np.int64}


def _resolve(mail: pa.Table) -> pa.Table:
    known = mail.column("settled")
    _, c, doc, pos, _, start, size = common.gathered(mail.filter(known), _VALUES)
    settled = _places(doc, start, size, pos, c, SPAN)
    a, c, (doc, pos, many, start, size), of, first = _classes(*common.gathered(mail.filter(pc.invert(known)), _VALUES))
    if not len(a):
        return pa.Table.from_batches([settled])
    repeated = (np.bincount(of) > 1) | (np.bincount(of, many) > 0)
    found = repeated[of] & (many == 0)
    anchor = np.cumsum(common.run_starts(a)) - 1
    several = np.bincount(anchor[first]) > 1
    lead = np.zeros(len(a), bool)
    lead[first] = True
    branch = several[anchor] & lead
    return pa.Table.from_batches([
        settled, _places(doc[found], start[found], size[found], pos[found], c[found], SPAN),
        _places(doc[branch], start[branch], size[branch], pos[branch], c[branch], BRANCH),
    ])


def _listed(places, kind: int, *fields: str) -> list[np.ndarray]:
    if not places.is_valid:
        return [np.zeros(0, np.int64) for _ in fields]
    own = np.asarray(places.values.field("kind")) == kind
    return [np.asarray(places.values.field(f))[own] for f in fields]


_SIDES = "bucket long, key binary, more binary, side binary, doc binary, pos binary, proof binary, text binary"
_SIDE_VALUES = {"key": np.uint64, "more": np.uint64, "side": np.uint8, "doc": np.int64, "pos": np.int64, "proof": np.uint64}


def _fetcher(length: int, gram: int, buckets: int):
    reach = length - gram
    half = reach // 2

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each listed anchor the bytes around its gram, to the bucket of what is before it and of what is behind it."""
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("_places")), 0))
            ids, parts, texts = np.asarray(batch.column("doc_id").cast(pa.int64())), [], []
            for lo, hi in common.steps(batch, "text"):
                b = _Bytes(batch.column("text")[lo:hi], length, gram)
                pos = [b.starts[r] + np.unique(_listed(batch.column("_places")[lo + r], BRANCH, "pos")[0]) for r in range(hi - lo)]
                pos = np.concatenate([p[p + gram < b.starts[r + 1]] for r, p in enumerate(pos)])
                proof = b.hashes(pos)
                doc, begin, end = b.around(pos)
                for p, x, y, d, h in zip(pos.tolist(), begin.tolist(), end.tolist(), doc.tolist(), proof.tolist()):
                    left = b.raw[x:p].rjust(reach, b"\xff")
                    right = b.raw[p + gram : y].ljust(reach, b"\xff")
                    core = xxhash.xxh3_128_intdigest(b.raw[p : p + gram])
                    for side, text in ((0, left + right[:half]), (1, left[reach - half :] + right)):
                        key = xxhash.xxh3_128_intdigest(text[half : half + half], core & (1 << 64) - 1) ^ core
                        parts.append((key >> 64, key & (1 << 64) - 1, side, int(ids[lo + d]), p - int(b.starts[d]), h))
                        texts.append(text)
            if parts:
                key, more, side, doc, pos, proof = (np.array(x, t) for x, t in zip(zip(*parts), _SIDE_VALUES.values()))
                text = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
                text = np.ascontiguousarray(text).view(f"V{text.shape[1]}").ravel()
                yield common.dealt(key, buckets, {"key": key, "more": more, "side": side, "doc": doc, "pos": pos, "proof": proof, "text": text})

    return fetch


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """The strings, all of one length, in sorted order: a list of the numbers of equal ones for each different string.

    Inner nodes hold the depth at which their strings part, and a child per byte there. A string is led down by these
    bytes alone to some leaf, and compared as a whole once; that tells where it parts.
    """
    if not strings:
        return []
    width = 8 * len(strings[0])
    numbers = [int.from_bytes(s) for s in strings]
    root: list | dict = [0]  # a leaf is a list of numbers, a node a dict of bytes, with its depth at -1
    for n, s in enumerate(strings):
        if n == 0:
            continue
        node = root
        while type(node) is dict:
            node = node.get(s[node[-1]]) or next(v for k, v in node.items() if k >= 0)
        apart = numbers[node[0]] ^ numbers[n]
        if not apart:
            node.append(n)
            continue
        depth, other = (width - apart.bit_length()) // 8, strings[node[0]]
        above, node = None, root
        while type(node) is dict and node[-1] < depth:
            above, node = node, node[s[node[-1]]]
        if type(node) is dict and node[-1] == depth:
            node[s[depth]] = [n]
            continue
        made = {-1: depth, other[depth]: node, s[depth]: [n]}
        if above is None:
            root = made
        else:
            above[s[above[-1]]] = made
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            out.append(node)
        else:
            stack.extend(node[k] for k in sorted((k for k in node if k >= 0), reverse=True))
    return out


def deep_shallow(groups: np.ndarray, strings: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Which rows equal another row of their group: suffixes sorted to the depth of ``strings`` (rows of bytes).

    Multikey quicksort on characters of 8 bytes up to ``shallow`` bytes leaves out what is alone; blind tries order the rest.
    """
    n, width = strings.shape
    words = np.ascontiguousarray(strings[:, :shallow]).view(">u8")
    left, keys = np.arange(n), groups
    for k in range(words.shape[1]):
        order = np.lexsort((words[left, k], keys[left]))
        left = left[order]
        new = common.run_starts(keys[left], words[left, k])
        keys = np.zeros(n, np.int64)
        keys[left] = np.cumsum(new)
        left = left[np.bincount(keys[left])[keys[left]] > 1]
    same = np.zeros(n, bool)
    rest = np.ascontiguousarray(strings[:, shallow:])
    raw, depth = rest.tobytes(), width - shallow
    starts = np.flatnonzero(common.run_starts(keys[left]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(left)]):
        rows = left[a:b].tolist()
        for leaf in blind_trie([raw[r * depth : (r + 1) * depth] for r in rows]):
            if len(leaf) > 1:
                same[[rows[i] for i in leaf]] = True
    return same


def _sorter(length: int, gram: int):
    reach = length - gram
    half = reach // 2

    def sort(mail: pa.Table) -> pa.Table:
        key, more, side, doc, pos, proof = common.gathered(mail, _SIDE_VALUES)
        text = np.frombuffer(b"".join(mail.column("text").to_pylist()), np.uint8).reshape(len(key), -1)
        order = np.lexsort((more, key, side))
        key, more, side, doc, pos, proof, text = (x[order] for x in (key, more, side, doc, pos, proof, text))
        group = np.cumsum(common.run_starts(side, key, more))
        met = np.bincount(group)[group] > 1
        group, side, doc, pos, proof, text = (x[met] for x in (group, side, doc, pos, proof, text))
        first, last = np.full(len(group), reach + 1), np.full(len(group), -1)
        real = text != 255
        for t in range(half + 1):
            inside = np.flatnonzero(real[:, t : t + reach].all(axis=1))
            rows = inside[deep_shallow(group[inside], text[inside, t : t + reach])]
            first[rows] = np.minimum(first[rows], t)
            last[rows] = np.maximum(last[rows], t)
        hit = last >= 0
        # A suffix at t starts so far before the gram; side 0 holds all bytes on the left, side 1 half of them.
        ahead = np.where(side == 0, reach, half)
        start, end = pos - ahead + first, pos - ahead + last + length
        return pa.Table.from_batches([_places(doc[hit], start[hit], (end - start)[hit], pos[hit], proof[hit], SPAN)])

    return sort


def _remover(length: int, gram: int, keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lo, hi in common.steps(batch, "text"):
                b = _Bytes(batch.column("text")[lo:hi], length, gram)
                for r in range(hi - lo):
                    a, e = int(b.starts[r]), int(b.starts[r + 1]) - 1
                    change = np.zeros(e - a + 1, np.int32)
                    for column in ("_places", "_edges"):
                        start, size, pos, proof = _listed(batch.column(column)[lo + r], SPAN, "start", "size", "pos", "proof")
                        ok = pos + gram <= e - a
                        start, size, pos, proof = start[ok], size[ok], pos[ok], proof[ok]
                        ok = b.hashes(a + pos) == proof.view(np.uint64)
                        np.add.at(change, start[ok], 1)
                        np.add.at(change, (start + size)[ok], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    text = b.data[a:e][~gone].tobytes()
                    spans = [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())]
                    made.append((e - a, int(gone.sum()), len(spans), hashlib.sha256(text).hexdigest(), spans, text if keep_text else None))
            names = [n for n in batch.schema.names if n not in ("_places", "_edges", "text")]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)][: 6 if keep_text else 5]
            more = ["_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_spans", "_kept"][: len(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + columns, names + more)

    return remove


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) without its text, with ``_n_bytes``, ``_n_removed``, ``_n_spans``,
    ``_kept_sha256`` and ``_spans``, the maximal removed runs of bytes; with ``keep_text`` also ``_kept``, the bytes left.

    Removed is each byte of a string of ``length`` bytes that also starts anywhere else.
    """
    if not 0 < gram < length or (length - gram) % 16:
        raise ValueError("length must exceed gram by a multiple of 16")
    docs = docs.drop("_places", "_edges", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_spans", "_kept")
    buckets = common.bucket_count(docs, "text", BUCKET_BYTES)
    ours = docs.select("doc_id", "text")

    def per_document(places: DataFrame) -> DataFrame:
        return places.groupBy("doc_id").agg(F.collect_list(F.struct(*_NAMES[1:])).alias("_places"))

    sent = ours.mapInArrow(_sender(length, gram, buckets), _SENT)
    places = common.written(per_document(sent.groupBy("bucket").applyInArrow(_resolve, _PLACE)), "places")

    def of_kind(kind: int) -> DataFrame:
        return places.withColumn("_places", F.filter("_places", lambda p: p["kind"] == kind))

    # Both joins are outer ones, so that the documents are shuffled once and read twice.
    branching = docs.join(of_kind(BRANCH), "doc_id", "left").select("doc_id", "text", "_places")
    sides = branching.mapInArrow(_fetcher(length, gram, buckets), _SIDES)
    edges = per_document(sides.groupBy("bucket").applyInArrow(_sorter(length, gram), _PLACE)).withColumnRenamed("_places", "_edges")
    listed = docs.join(of_kind(SPAN), "doc_id", "left").join(edges, "doc_id", "left")
    more = "_n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string, _spans array<struct<start:long,end:long>>"
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], *T.StructType.fromDDL(more + (", _kept binary" if keep_text else "")).fields])
    return listed.mapInArrow(_remover(length, gram, keep_text), schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
