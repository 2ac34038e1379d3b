"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the rows of the result, divided by the rows it has. Each document draws its
number of copies from the Poisson distribution with that mean, by inverting the distribution function at a uniform
number hashed from the seed and its doc_id. Copies are dealt to partitions by a hash and sorted by it there, which
shuffles the whole corpus; the same seed gives the same result on any cluster.

Without weights, a source weighs as the power ``temper`` of its rows. Rates are one row per source, in a table whose
true size decides whether it is broadcast; the documents are never shuffled by source.

Defined results: a null source is a source like any other; a source without a weight gets no copies; weights of sources
that have no rows count for nothing; rows that share a doc_id draw the same number; texts are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm import common

SEED = 20
TEMPER = 0.5


def _distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... until nothing is left of 52 bits; in logarithms, so that no rate is too great."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    chances = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all")),
        lambda a, k: F.struct(
            (a["log"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log"),
            (a["sum"] + F.exp(a["log"] + F.ln(rate) - F.ln(k.cast("double")))).alias("sum"),
            F.concat(a["all"], F.array(a["sum"] + F.exp(a["log"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("all"),
        ),
    )
    return chances["all"]


def rates(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, temper: float = TEMPER) -> DataFrame:
    """(source, rate, distribution): copies of a document of each source to be expected, for ``rows`` rows in all."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(temper)))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("_source")))
    total = weighed.agg(F.sum("weight").alias("_weights"), F.sum("n").alias("_n"))
    wanted = F.col("_n") if rows is None else F.lit(rows)
    return weighed.crossJoin(F.broadcast(total)).select(
        "source", (F.col("weight") / F.col("_weights") * wanted / F.col("n")).alias("rate")
    ).where("rate > 0").withColumn("distribution", _distribution(F.col("rate")))


def _hashed(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, temper: float = TEMPER, seed: int = SEED
) -> DataFrame:
    """Copies of the rows of ``docs`` (doc_id, source, ...) with ``_copy`` (1, 2, ...) and ``_shuffle_key``, in shuffled order."""
    table = common.written(rates(docs, weights, rows, temper).select(F.col("source").alias("_source"), "distribution"), "rates")
    uniform = F.conv(F.substring(_hashed(seed, "doc_id"), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = F.size(F.filter("distribution", lambda c: c <= uniform))
    drawn = docs.join(table, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies).drop("_source", "distribution")
    exploded = drawn.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    keyed = exploded.withColumn("_shuffle_key", _hashed(seed, "doc_id", "_copy"))
    return keyed.repartition("_shuffle_key").sortWithinPartitions("_shuffle_key", "doc_id")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.withColumnsRenamed({"_copy": "copy", "_shuffle_key": "shuffle_key"})


SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, power(n, 0.5) / sum(power(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM c),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM r),
p AS (SELECT source, k, exp(-rate + coalesce(sum(CASE WHEN k > 0 THEN ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k), 0)) AS p FROM k),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM p),
u AS (SELECT *, ('0x' || substr(md5('20:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents)
SELECT doc_id, text, lang, source, n_chars, (k + 1)::INTEGER AS copy, md5('20:' || doc_id || ':' || (k + 1)) AS shuffle_key
FROM u JOIN f USING (source) WHERE below <= u
"""
