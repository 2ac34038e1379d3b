"""Ranked lexical search by pipelined term partitioning.

The index is cut in two ways: by documents into shards of bounded size, and by terms among owners, of which the first
holds the rarest. Items travel in bundles. For each shard a bundle goes from owner to owner; at each it meets that
owner's postings by a cogroup on (bundle, shard), adds their integer contributions to its sparse accumulators, and takes
these along. So the accumulators grow late: the terms that touch most documents come in the last stage, which picks the
best of its shard at once instead of passing them on. A last ranking per item sees these few.

A term is known by 64 bits of hash. Postings are made of terms that pass a bitmap of the items' terms, which has 2 MB
however many there are; what passes by chance meets no item at its owner. Nothing else is broadcast but what Spark finds
small. A frequent term has a piece of postings per shard, so none is held whole; counts (N, L, df) cover all documents.

Defined results: a null or blank text has no terms; such items return nothing and such documents are not counted; each
row of either table counts by itself, so rows that share an id are ranked one by one; a null doc_id can be found and comes
last among equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscope.llm import common

K = 10
#: Text and documents of a shard, items of a bundle.
SHARD_BYTES, SHARD_DOCS, BUNDLE = 2 << 20, 4096, 256
#: Bits of a term's hash that the bitmap takes.
BITMAP = 24
#: An owner's terms are in less than one of so many documents; the last owner has the others.
OWNERS = (512, 64, 8)
_LAST = len(OWNERS)

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _first, _end in ((48, 58), (65, 91), (97, 123)):
    _INSIDE[_first:_end] = True


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of some texts, and how many each text has."""
    data, text_starts = common.joined(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    edges = np.flatnonzero(np.diff(_INSIDE[data].astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    return common.rolling(common.byte_values(data), starts, ends), np.diff(np.searchsorted(starts, text_starts))


_INDEX = "shard long, ids array<long>, lengths array<long>, terms binary, sizes binary, docs binary, tfs binary, n_docs long, n_terms long"


def _index(batches: Iterator[pa.RecordBatch], bitmap: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """One row per shard: its documents, and the postings of terms that pass the bitmap, by term and document."""
    bits, made = np.frombuffer(bitmap, np.uint8), TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi in common.steps(batch, "text", SHARD_BYTES):
            for at in range(lo, hi, most):
                part = batch.slice(at, min(hi, at + most) - at)
                terms, lengths = _terms(part.column("text"))
                doc = np.repeat(np.arange(len(lengths)), lengths)
                place = terms >> np.uint64(64 - BITMAP)
                known = bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                terms, doc = terms[known], doc[known]
                order = np.argsort(terms, kind="stable")
                terms, doc = terms[order], doc[order]
                first = np.flatnonzero(common.run_starts(terms, doc))
                tfs = np.diff(np.append(first, len(terms)))
                terms, doc = terms[first], doc[first]
                heads = np.flatnonzero(common.run_starts(terms))
                sizes = np.diff(np.append(heads, len(terms)))
                yield pa.RecordBatch.from_pylist([{
                    "shard": made, "ids": part.column("doc_id").cast(pa.int64()).to_pylist(), "lengths": lengths.tolist(),
                    "terms": terms[heads].tobytes(), "sizes": sizes.astype(np.int32).tobytes(), "docs": doc.astype(np.int32).tobytes(),
                    "tfs": tfs.astype(np.int32).tobytes(), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
                }], _INDEX_SCHEMA)
                made += 1


_LONGS = pa.list_(pa.int64())
_INDEX_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("ids", _LONGS), ("lengths", _LONGS), *[(c, pa.binary()) for c in ("terms", "sizes", "docs", "tfs")],
    ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times) for each different term of each item."""
    for batch in batches:
        for lo, hi in common.steps(batch, "text"):
            terms, lengths = _terms(batch.column("text")[lo:hi])
            item = np.repeat(np.asarray(batch.column("item")[lo:hi]), lengths)
            order = np.lexsort((terms, item))
            terms, item = terms[order], item[order]
            first = np.flatnonzero(common.run_starts(item, terms))
            times = np.diff(np.append(first, len(terms)))
            yield pa.RecordBatch.from_arrays([pa.array(item[first], pa.int64()), pa.array(terms[first].view(np.int64)), pa.array(times, pa.int64())], ["item", "term", "times"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("terms").to_pylist()])
        sizes = np.concatenate([np.frombuffer(x, np.int32) for x in batch.column("sizes").to_pylist()])
        found, back = np.unique(terms, return_inverse=True)
        df = np.bincount(back, sizes, len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df)], ["term", "df"])


def _bitmap(asked: DataFrame) -> bytes:
    """A bit for the leading bits of each term; pieces of 4 kB come to the driver, 2 MB in all at most."""
    place = F.shiftrightunsigned("term", 64 - BITMAP)
    pieces = asked.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    ).collect()
    bits = bytearray(1 << BITMAP - 3)
    for piece, own in pieces:
        bits[(piece - 1) * len(own) : piece * len(own)] = own
    return bytes(bits)


_POSTINGS = "bundle long, shard long, ids array<long>, lengths array<long>, slots binary, weights binary, first binary, size binary, docs binary, tfs binary"


def _own_postings(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Of shards, the postings of a bundle's terms at an owner: per (item, term) its weight and its range of postings."""
    for batch in batches:
        for row in batch.to_pylist():
            terms, sizes = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["sizes"], np.int32)
            asked = row["query"] or []
            wanted = np.array([q["term"] for q in asked], np.int64).view(np.uint64)
            at = np.searchsorted(terms, wanted)
            here = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(0, np.int64)
            if not len(here) and not last:
                continue
            used, back = np.unique(at[here], return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            take = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in used]) if len(used) else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(sizes[used])]).astype(np.int32)
            out = {
                "bundle": row["bundle"], "shard": row["shard"], "ids": row["ids"] if last else None, "lengths": row["lengths"],
                "slots": np.array([asked[i]["slot"] for i in here], np.int32), "weights": np.array([asked[i]["weight"] for i in here], np.int64),
                "first": first[back], "size": sizes[used][back].astype(np.int32),
                "docs": np.frombuffer(row["docs"], np.int32)[take], "tfs": np.frombuffer(row["tfs"], np.int32)[take],
            }
            yield pa.RecordBatch.from_pylist([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in out.items()}], _POSTINGS_SCHEMA)


_POSTINGS_SCHEMA = pa.schema([
    ("bundle", pa.int64()), ("shard", pa.int64()), ("ids", _LONGS), ("lengths", _LONGS),
    *[(c, pa.binary()) for c in ("slots", "weights", "first", "size", "docs", "tfs")],
])
_CARRIED_COLUMNS = "bundle long, shard long, places binary, scores binary"
_CARRIED = pa.schema([("bundle", pa.int64()), ("shard", pa.int64()), ("places", pa.binary()), ("scores", pa.binary())])


def _added(carried: pa.Table, postings: pa.Table, n: int, total: int, shape: tuple[int, int]) -> np.ndarray:
    """The scores (of items times documents of the shard, ``shape``) with what the postings add."""
    scores, width = np.zeros(shape[0] * shape[1], np.int64), shape[1]
    for row in carried.to_pylist():
        scores[np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["scores"], np.int64)
    for row in postings.to_pylist():
        slots, weights, first, size, docs, tfs = (np.frombuffer(row[c], t) for c, t in (
            ("slots", np.int32), ("weights", np.int64), ("first", np.int32), ("size", np.int32), ("docs", np.int32), ("tfs", np.int32),
        ))
        m = 100 - 75 + 75 * np.array(row["lengths"], np.int64) * n // max(total, 1)
        tf = tfs.astype(np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        for slot, weight, a, b in zip(slots.tolist(), weights.tolist(), first.tolist(), (first + size).tolist()):
            scores[slot * width + docs[a:b]] += weight * part[a:b]
    return scores


def _stage(carried: pa.Table, postings: pa.Table, **whole) -> pa.Table:
    """A bundle at an owner: its accumulators with this owner's contributions."""
    scores = _added(carried, postings, **whole)
    some = carried if carried.num_rows else postings
    places = np.flatnonzero(scores)
    row = {"bundle": some.column("bundle")[0].as_py(), "shard": some.column("shard")[0].as_py(),
           "places": places.astype(np.int32).tobytes(), "scores": scores[places].tobytes()}
    return pa.Table.from_pylist([row], _CARRIED)


_BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _last_stage(carried: pa.Table, postings: pa.Table, k: int, **whole) -> pa.Table:
    """A bundle at the last owner: the best documents of the shard for each of its items."""
    scores = _added(carried, postings, **whole).reshape(whole["shape"])
    row = postings.select(["bundle", "ids"]).to_pylist()[0]
    bare = np.array([i is None for i in row["ids"]], bool)
    ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
    out = {"item": [], "doc_id": [], "score": []}
    for slot in np.flatnonzero(scores.any(axis=1)).tolist():
        own = scores[slot, : len(ids)]
        docs = np.flatnonzero(own)
        if len(docs) > k:
            docs = docs[own[docs] >= np.partition(own[docs], -k)[-k]]
        docs = docs[np.lexsort((ids[docs], bare[docs], -own[docs]))[:k]]
        out["item"] += [row["bundle"] * len(scores) + slot] * len(docs)
        out["doc_id"] += [row["ids"][d] for d in docs]
        out["score"] += own[docs].tolist()
    return pa.table(out, _BEST)


def search(docs: DataFrame, items: DataFrame, k: int = K, bundle: int = BUNDLE, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    ``bundle`` items travel together, ``shard_docs`` documents at most make a shard: the scores of a task are one array of their product.
    """
    asking = common.written(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    asked = common.written(asking.select("item", "text").mapInArrow(_asked, "item long, term long, times long"), "asked")
    index = common.written(docs.select("doc_id", "text").mapInArrow(partial(_index, bitmap=_bitmap(asked), most=shard_docs), _INDEX), "index")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select("terms", "sizes").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    owner = F.lit(_LAST)
    for at, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") * share < n, at).otherwise(owner)
    terms = asked.join(held, "term").select(
        F.call_function("div", F.col("item"), F.lit(bundle)).alias("bundle"), owner.alias("owner"),
        F.struct((F.col("item") % bundle).cast("int").alias("slot"), "term", (weight * F.col("times")).alias("weight")).alias("q"),
    )
    queries = common.written(terms.groupBy("bundle", "owner").agg(F.collect_list("q").alias("query")), "queries")
    bundles = [r["bundle"] for r in queries.select("bundle").distinct().collect()]
    if not bundles:
        return asking.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    shards = index.withColumn("bundle", F.explode(F.array(*[F.lit(b).cast("long") for b in bundles])))
    at, whole = ["bundle", "shard"], {"n": n, "total": total, "shape": (bundle, shard_docs)}
    carried = None
    for stage in range(_LAST + 1):
        last = stage == _LAST
        own = queries.where(F.col("owner") == stage).select("bundle", "query")
        met = shards.join(own, "bundle", "left" if last else "inner")
        postings = met.select("bundle", "shard", "ids", "lengths", "terms", "sizes", "docs", "tfs", "query").mapInArrow(partial(_own_postings, last=last), _POSTINGS)
        if carried is None:
            carried = asking.sparkSession.createDataFrame([], _CARRIED_COLUMNS)
        pair = carried.groupBy(*at).cogroup(postings.groupBy(*at))
        if last:
            best = pair.applyInArrow(partial(_last_stage, k=k, **whole), "item long, doc_id long, score long")
        else:
            carried = pair.applyInArrow(partial(_stage, **whole), _CARRIED_COLUMNS)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asking.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
asked AS (SELECT row_number() OVER () AS r, item_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
words AS (SELECT r, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
wanted AS (SELECT r, id, term, count(*) AS times FROM (SELECT r, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked) GROUP BY ALL),
tfs AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
lengths AS (SELECT r, any_value(id) AS id, count(*) AS n FROM words GROUP BY r),
whole AS (SELECT count(*) AS c, sum(n)::BIGINT AS l FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * c + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, c),
norms AS (SELECT r, lengths.id, 100 - 75 + (75 * n * c) // l AS m FROM lengths, whole),
scores AS (
  SELECT q.r, q.id AS item_id, norms.id AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted q JOIN weights USING (term) JOIN tfs USING (term) JOIN norms ON norms.r = tfs.r GROUP BY q.r, q.id, tfs.r, norms.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
