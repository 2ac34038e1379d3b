"""SimHash near-dedup by anchor points of a covering code.

Anchors are the words of the Hamming code of length 63, whose covering radius is 1, on bits 0 to 62 of a fingerprint;
bit 63 is left free. Two fingerprints that differ in 2 bits or fewer have a point between them, 1 bit from each at
most, and that point lies within the covering radius of an anchor. So a fingerprint goes to every anchor within 2 bits
(the radius and half the threshold, from either side): 32 anchors, or 1 if it is an anchor itself. An anchor sees
fingerprints within 2 bits of it only, at most 2 * (1 + 63 + 63 * 62 / 2) different ones, whatever the data: groups
are bounded. They are compared on all 64 bits there, and each cluster gives a star of links instead of all its pairs.

Copies count once: fingerprints are made distinct before they go to anchors.

Defined results: a null, blank or empty text has fingerprint 0 and links like any other; rows that share a doc_id
each give a row; a null doc_id is no component_id unless no other document is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.llm import common
from logscope.llm.components import components

SHINGLE = 3
SEED = 42
#: Differing bits of linked fingerprints; the anchors' construction is for 2.
THRESHOLD = 2


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for lo, hi in common.steps(batch, "text"):
            data, text_starts = common.joined(batch.column("text")[lo:hi])
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            starts, ends = common.words(data)
            plain, at = common.plain(data, starts, ends)
            first = np.searchsorted(starts, text_starts)
            n_words = np.diff(first)
            n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
            begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            end = np.minimum(begin + shingle, np.repeat(first[1:], n))
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(plain[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())), np.uint64, len(begin))
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            prints, some = np.zeros(hi - lo, np.uint64), np.flatnonzero(n)
            if len(some):
                ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0, dtype=np.int64)
                prints[some] = np.packbits(2 * ones > n[some][:, None], axis=1).view(">u8").ravel()
            found.append(prints)
        prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the SimHash of the lower-cased word shingles of each text, as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def _bit(place: Column) -> Column:
    """The bit at a place from 1 to 63; none at place 0."""
    return F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)).otherwise(F.lit(0).cast("long"))


def _syndrome(low: Column) -> Column:
    """The place of the bit by which bits 0 to 62 miss a code word; 0 if they are one."""
    syndrome = F.lit(0)
    for k in range(6):
        mask = sum(1 << (place - 1) for place in range(1, 64) if place >> k & 1)
        syndrome = syndrome + F.bit_count(low.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
    return syndrome


def anchors(fp: Column) -> Column:
    """All anchors within 2 bits of bits 0 to 62 of a fingerprint."""
    low = fp.bitwiseAND(F.lit((1 << 63) - 1))
    syndrome = _syndrome(low)
    pairs = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(syndrome))
    return F.when(syndrome == 0, F.array(low)).otherwise(
        F.transform(pairs, lambda i: low.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(syndrome))))
    )


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """A star of links for each cluster of the fingerprints of an anchor."""
    for batch in batches:
        lists = batch.column("prints")
        values, at = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
        size = np.diff(at)
        two = at[:-1][size == 2]
        near = np.bitwise_count(values[two] ^ values[two + 1]) <= threshold
        a, b = [values[two[near]]], [values[two[near] + 1]]
        for start, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            left = np.sort(values[start : start + n])
            while len(left) > 1:
                root, front, left = left[0], left[:1], left[1:]
                while len(front) and len(left):
                    reached = np.zeros(len(left), bool)
                    for f in front:
                        reached |= np.bitwise_count(left ^ f) <= threshold
                    front, left = left[reached], left[~reached]
                    a.append(front)
                    b.append(np.full(len(front), root))
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` that differ in ``threshold`` bits or fewer."""
    if threshold not in (1, 2):
        raise ValueError("anchors within 2 bits cover a threshold of 1 or 2")
    at = prints.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    groups = at.groupBy("anchor").agg(F.collect_list("fp").alias("prints")).where("size(prints) > 1").select("prints")
    return groups.mapInArrow(partial(_compare, threshold=threshold), "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text, ...); component_id is the least doc_id that links reach."""
    marked = common.written(fingerprints(docs, shingle), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp"), threshold))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# -- similarity of shingle sets -----------------------------------------------------------

#: Words of a shingle, least Jaccard similarity of linked documents.
WIDE, SIMILAR = 5, 0.8
#: Fingerprints of a document, and shingles that each is made of.
BLOCKS, SAMPLE = 10, 5
#: Rows of a group that all others are compared with, at most, before its groups are cut finer.
ROOTS = 8
#: Hashes that one step of the sampling orders.
_ORDERED = 1 << 22
_SETS = "doc_id long, row long, h1 long, h2 long, prints array<long>, shingles array<int>"


def _sampled(hashes: np.ndarray, blocks: int, sample: int) -> np.ndarray:
    """Per block the SimHash of the shingles that come first in the order of the block."""
    some = np.broadcast_to(hashes, (blocks, len(hashes)))
    if len(hashes) > sample:
        seeds = common.mix(np.arange(1, blocks + 1, dtype=np.uint64))
        together = max(1, min(blocks, _ORDERED // len(hashes)))  # blocks in one step
        first = [
            np.argpartition(common.mix(hashes ^ seeds[k : k + together, None]), sample, axis=1)[:, :sample] for k in range(0, blocks, together)
        ]
        some = hashes[np.concatenate(first)]
    ones = np.unpackbits(np.ascontiguousarray(some, ">u8").view(np.uint8).reshape(blocks, -1, 8), axis=2).sum(axis=1)
    return np.packbits(2 * ones > some.shape[1], axis=1).view(">i8").ravel().astype(np.int64)


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int, blocks: int, sample: int) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo, hi in common.steps(batch, "text"):
            data, text_starts = common.joined(batch.column("text")[lo:hi])
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            starts, ends = common.words(data)
            plain, at = common.plain(data, starts, ends)
            values = common.byte_values(np.frombuffer(plain, np.uint8))
            first = np.searchsorted(starts, text_starts)
            n_words = np.diff(first)
            n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
            begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            end = np.minimum(begin + shingle, np.repeat(first[1:], n))
            hashes = common.rolling(values, at[begin], at[end] - 1)
            rows, prints, sets = [], [], []
            for doc, own in zip(batch.column("doc_id")[lo:hi].cast(pa.int64()).to_pylist(), np.split(hashes, np.cumsum(n)[:-1])):
                own = np.unique(own)
                sums = [int(np.bitwise_xor.reduce(common.mix(own ^ np.uint64(k)), initial=np.uint64(len(own))).astype(np.int64)) for k in (1, 2)]
                rows.append((doc, made, *sums))
                prints.append(_sampled(own, blocks, sample) if len(own) else np.zeros(0, np.int64))
                short = (own >> np.uint64(32)).astype(np.uint32)
                sets.append(short[common.run_starts(short)].view(np.int32))
                made += 1
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32), np.concatenate(parts)) for parts in (prints, sets)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["doc_id", "row", "h1", "h2", "prints", "shingles"])


def similar_links(sets: DataFrame, similarity: float, blocks: int) -> DataFrame:
    """(a, b): links of rows (row, prints, shingles) that share a fingerprint and whose sets are as similar as asked.

    A fingerprint goes to its anchor, the code word within the covering radius, where those equal to it are its candidates.
    Per anchor and fingerprint the least rows are compared with all others there; what is similar to one of them leaves, the
    others go on with twice as many to be compared with. So a group of any size around one text takes one comparison a
    row. What is left after ``ROOTS`` such rows are strangers that share a passage, mostly: their groups are
    cut by the fingerprint of a further block, and again, until nothing is left or all blocks are equal; only
    those go on to the end. So comparisons grow with the rows, not with their pairs.
    """
    low = F.col("print").bitwiseAND(F.lit((1 << 63) - 1))
    key = ["block", "anchor", "print", "deeper"]
    placed = sets.select("row", "prints", F.posexplode("prints").alias("block", "print")).withColumns(
        {"anchor": low.bitwiseXOR(_bit(_syndrome(low))), "deeper": F.lit(0).cast("long")}
    )
    groups = placed.groupBy("block", "print").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    left = common.written(placed.join(groups, ["block", "print"]).select("row", "prints", *key), "candidates")
    wanted = common.written(sets.select("row", "shingles").join(left.select("row").distinct(), "row", "left_semi"), "shingles")
    found, roots, level = [], 1, 0
    while True:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("row"))
        chosen = left.select("row", *key).withColumn("rank", rank).where(F.col("rank") <= roots).select(*key, F.col("row").alias("root"))
        chosen = common.written(chosen, "roots")
        pairs = common.written(left.join(chosen, key).where("root < row").select("root", "row", *key), "pairs")
        if pairs.isEmpty():
            break
        each = pairs.select("root", "row").distinct().join(wanted.withColumnRenamed("shingles", "a"), "row").join(
            wanted.select(F.col("row").alias("root"), F.col("shingles").alias("b")), "root"
        )
        both = F.size(F.array_intersect("a", "b"))
        alike = both >= similarity * (F.size("a") + F.size("b") - both)
        linked = common.written(each.where(alike).select("root", "row"), "alike")
        found.append(linked)
        done = pairs.join(linked, ["root", "row"], "left_semi").select("row", *key).unionByName(chosen.withColumnRenamed("root", "row"))
        left = left.join(done.distinct(), ["row", *key], "left_anti")
        roots *= 2
        if roots > ROOTS and level < blocks - 1:
            level, roots = level + 1, 1
            further = F.get("prints", (F.col("block") + level) % blocks)
            left = left.withColumn("deeper", F.xxhash64("deeper", further))
        left = common.written(left, "left")
    if not found:
        return wanted.select(F.col("row").alias("a"), F.col("row").alias("b")).where("a < b")
    return reduce(DataFrame.unionByName, found).select(F.col("row").alias("a"), F.col("root").alias("b")).distinct()


def similar_documents(
    docs: DataFrame, shingle: int = WIDE, similarity: float = SIMILAR, blocks: int = BLOCKS, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, component_id) per row of ``docs`` (doc_id, text, ...): links join texts whose shingle sets have this Jaccard similarity.

    A SimHash of all shingles differs in some ten bits at a similarity of 0.8, more than anchors can cover. So a
    document gets a fingerprint per block, each of the ``sample`` shingles that come first in an order of the block; two documents of
    similarity J share all of those with a chance of about J^sample per block, and some block with 0.98 at 0.8 (a greater J, more).
    Candidates are compared by their whole sets, of 32-bit hashes. Equal sets are one row throughout.

    Shingles are of lower-cased words; a text with fewer words is one shingle, and blank texts equal one another. Null doc_ids as
    in ``simhash_dedup``.
    """
    made = docs.select("doc_id", "text").mapInArrow(partial(_shingle_sets, shingle=shingle, blocks=blocks, sample=sample), _SETS)
    sets = common.written(made, "sets")
    same = ["h1", "h2"]
    heads = common.written(sets.groupBy(*same).agg(F.min("row").alias("row"), F.min("doc_id").alias("first")), "heads")
    members = common.written(sets.select("doc_id", *same), "members")
    roots = components(similar_links(sets.join(heads.select("row"), "row", "left_semi"), similarity, blocks))
    common.freed(sets)  # the shingles are most of what is written here; the stages that follow need the disk
    rooted = heads.join(roots, F.col("row") == F.col("node"), "left").select(*same, "first", F.coalesce("root", "row").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return members.join(rooted.join(least, "root").select(*same, "component_id"), same).select("doc_id", "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
