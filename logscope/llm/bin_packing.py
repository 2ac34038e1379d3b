"""Best-fit packing with conflicts: token sequences of documents into bins of one context length.

A document longer than a bin is cut into whole bins and a rest. Pieces are dealt at random, but reproducibly, to shards
of about ``SHARD`` pieces. A shard packs its pieces from the longest to the shortest: its bins are kept in the order of
their residual room, each with a bitmap of the sources and one of the duplicate clusters that it holds; from the
tightest level that has room, successors are tried until a bin holds neither the piece's source nor its cluster. Only
if there is none, a new bin is opened. The number of shards follows the input, so that a task's memory does not.

A cluster is what has the same words; a bin never holds two documents of a source, nor two of a cluster.

Defined results: a text without words (null or blank too) takes no room: one row with n_words 0 and no bin; a null
source conflicts with null sources only; repeated rows are packed one by one, like copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import common

CAPACITY = 2048
SHARD = 4096

_PLACED = "doc_id long, piece int, copy int, n_words int, shard long, bin int, slot int, bin_words int"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece; pieces come in packing order, sources and clusters as bitmaps of one bit."""
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has r words of room
    room: list[int] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters):
        found, above = -1, filled >> size
        level = size
        while above and found < 0:
            skip = (above & -above).bit_length() - 1
            level, above = level + skip, above >> skip
            for b in levels[level]:
                if not held_sources[b] & source and not held_clusters[b] & cluster:
                    found = b
                    break
            else:
                level, above = level + 1, above >> 1
        if found < 0:
            found = len(room)
            room.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
        else:
            levels[level].remove(found)
            if not levels[level]:
                filled ^= 1 << level
        room[found] -= size
        held_sources[found] |= source
        held_clusters[found] |= cluster
        if room[found]:
            if not levels[room[found]]:
                filled |= 1 << room[found]
            levels[room[found]].append(found)
        placed.append(found)
    return placed


def _bits(values: pa.ChunkedArray) -> list[int]:
    """A bit per different value; values that occur once need none."""
    _, at, n = np.unique(np.asarray(values.combine_chunks()), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    return [1 << int(rank[i]) if n[i] > 1 else 0 for i in at]


def _pack(pieces: pa.Table, capacity: int) -> pa.Table:
    order = [("n_words", "descending"), ("deal", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending"), ("cluster", "ascending"), ("origin", "ascending")]
    pieces = pieces.sort_by(order)
    sizes = pieces.column("n_words").to_pylist()
    bins = np.array(best_fit(sizes, _bits(pieces.column("origin")), _bits(pieces.column("cluster")), capacity), np.int64)
    by_bin = np.argsort(bins, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(bins))])
    slot = np.empty(len(bins), np.int64)
    slot[by_bin] = np.arange(len(bins)) - first[bins[by_bin]]
    words = np.bincount(bins, sizes).astype(np.int64)[bins]
    kept = [pieces.column(n) for n in ("doc_id", "piece", "copy", "n_words", "shard")]
    return pa.table([*kept, *(pa.array(x, pa.int32()) for x in (bins, slot, words))], ["doc_id", "piece", "copy", "n_words", "shard", "bin", "slot", "bin_words"])


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, copy, piece, word_start, n_words, shard, bin, slot, bin_words) of each piece of ``docs`` (doc_id, text, source, ...).

    ``copy`` counts equal rows; a bin is named by shard and bin, holds its pieces in the order of ``slot``, and
    ``bin_words`` words of ``capacity``.
    """
    words = F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    sized = docs.select("doc_id", F.xxhash64("source").alias("origin"), words.alias("words")).select(
        "doc_id", "origin", F.xxhash64("words").alias("cluster"),
        F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).alias("total"),
    )
    same = common.written(sized.groupBy("doc_id", "origin", "cluster", "total").agg(F.count("*").cast("int").alias("copies")), "sizes")
    copied = same.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    pieces = copied.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / capacity).cast("int") - 1)))).select(
        "doc_id", "copy", "piece", "origin", "cluster",
        F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("n_words"),
        F.xxhash64("doc_id", "copy", "piece").alias("deal"),
    )
    n = pieces.where("n_words > 0").count()
    shards = n // shard + 1
    dealt = pieces.withColumn("shard", F.pmod("deal", F.lit(shards)))

    def packed(group: pa.Table) -> pa.Table:
        return _pack(group, capacity)

    placed = dealt.where("n_words > 0").groupBy("shard").applyInArrow(packed, _PLACED)
    empty = dealt.where("n_words = 0").select(
        "doc_id", "piece", "copy", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("shard", "long"), ("bin", "int"), ("slot", "int"), ("bin_words", "int"))]
    )
    return placed.unionByName(empty).select(
        "doc_id", "copy", "piece", (F.col("piece") * capacity).alias("word_start"), "n_words", "shard", "bin", "slot", "bin_words"
    )


def op3_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
