"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into 4 segments of 16. Round r looks up, for every query that is not settled, all values
that differ in exactly r bits from its segments. After round r every code within distance 4 (r + 1) - 1 has been met,
since a code further than r in every segment is further than that; a query is settled when its k-th verified
distance is no greater. So radii grow only as far as a query's own neighbourhood asks. From the round on in which k have
been met, only codes that are no further than the k-th so far are taken up.

Equal codes count once: the index has one row per different code with its k + 1 least ids, which are all that a top-k
can need, and equal queries are searched once. A hot vector is therefore one row. A code that several segments find is
kept by the segment that found it first, by a rule on the two codes alone, so nothing has to be made distinct.

Defined results: a null or empty vector has no code, is not found and as a query finds nothing; the sign bits of the
first 64 dimensions count, missing or null ones as 0; ties go to the lesser id; a row is no neighbour of itself, but
rows that share an id are one; fewer than k others give fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscope.llm import common

BITS, SEGMENT = 64, 16
SEGMENTS = BITS // SEGMENT
K = 10
#: Queries are the ids that this divides.
EVERY = 100


def code(vector: Column) -> Column:
    """The sign bits of a vector's first 64 dimensions as a long; null for a null or empty vector."""
    bits = F.concat_ws("", F.transform(F.slice(vector, 1, BITS), lambda x: F.when(x > 0, "1").otherwise("0")))
    halves = [F.conv(F.substring(F.rpad(bits, BITS, "0"), at, 32), 2, 10).cast("long") for at in (1, 33)]
    return F.when(F.size(vector) > 0, F.shiftleft(halves[0], 32).bitwiseOR(halves[1]))


def _segment(c: Column, s: int) -> Column:
    return F.shiftrightunsigned(c, SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int")


def _found_first(a: Column, b: Column, s: int, radius: int) -> Column:
    """Whether segment ``s`` is the first, by its distance and then its number, among all segments of two codes."""
    ok = F.lit(True)
    for other in range(SEGMENTS):
        if other != s:
            apart = F.bit_count(_segment(a, other).bitwiseXOR(_segment(b, other)))
            ok = ok & (apart > radius if other < s else apart >= radius)
    return ok


def _masks(radius: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit((1 << SEGMENT) - 1)), lambda m: F.bit_count(m) == radius)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Of the codes met, the k + 1 nearest to each query code; no other can hold one of its k + 1 nearest rows."""
    order = Window.partitionBy("query").orderBy("distance", "least", "code")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the ``k`` nearest ``rows`` (id, code) of each of ``queries`` (id, code)."""
    known = rows.where("code IS NOT NULL AND id IS NOT NULL").select("id", "code").distinct()
    order = Window.partitionBy("code").orderBy("id")
    few = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    index = common.written(few.groupBy("code").agg(F.min("id").alias("least"), F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = common.written(queries.where("code IS NOT NULL AND id IS NOT NULL").select("id", F.col("code").alias("query")).distinct(), "queries")
    keyed = index.select("code", "least", F.inline(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)])))
    active = asked.select("query", F.lit(BITS).alias("bound")).distinct()
    best = None
    settled = []
    for radius in range(SEGMENT + 1):
        probes = active.select("query", "bound", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(F.col("query"), s).alias("own")) for s in range(SEGMENTS)])).alias("p"))
        probes = probes.select("query", "bound", "p.segment", "p.own", F.explode(_masks(radius)).alias("mask")).select(
            "query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value")
        )
        first = F.lit(False)
        for s in range(SEGMENTS):
            first = first | ((F.col("segment") == s) & _found_first(F.col("query"), F.col("code"), s, radius))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # The planner does not know how many probes the masks make of a query: neither side is to be broadcast.
        met = probes.hint("merge").join(keyed, ["segment", "value"]).where(first & (distance <= F.col("bound"))).select(
            "query", "code", "least", distance.alias("distance")
        )
        if best is not None:
            met = met.unionByName(best.join(active, "query", "left_semi"))
        best = common.written(_nearest(met, k), "nearest")
        # Ids per code are k + 1 at most, so k + 1 rows are reached by summing their number in the order of distance.
        reach = best.join(index.select("code", F.size("ids").alias("n")), "code").withColumn(
            "so_far", F.sum("n").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0))
        ).where(F.col("so_far") >= k + 1).groupBy("query").agg(F.min("distance").alias("kth"))
        known = common.written(active.join(reach, "query", "left").select("query", F.coalesce("kth", "bound").alias("bound")), "active")
        covered = SEGMENTS * (radius + 1) - 1
        settled.append(best.join(known.where(F.col("bound") <= covered), "query", "left_semi"))
        active = known.where(F.col("bound") > covered)
        if active.isEmpty():
            break
    else:
        settled.append(best.join(active, "query", "left_semi"))
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    members = found.join(index.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id"))).where(F.col("place") <= k + 1)
    mine = asked.join(few, "query").where("id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), "rank", "neighbour_id", F.col("distance").cast("int").alias("distance")
    )


def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where(F.col("id") % EVERY == 0))


SQL = """
WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, neighbour_id, distance, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= 10
"""
