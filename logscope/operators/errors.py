"""Frequent errors: whole lines, cleaned messages, charts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.messages import error_message
from logscope.functions.patterns import COMMENT
from logscope.functions.staged import computed
from logscope.functions.text import bar, collapse_blanks, sanitize_text
from logscope.operators.filters import has_error
from logscope.sources.files import BROADCAST_BLOCKS, split_bound


#: Characters of a line that are counted beside its hash, to rank equally frequent lines.
LEAD = 24


def top_errors(df: DataFrame, n: int = 5, by_file: bool = False) -> DataFrame:
    """The ``n`` most frequent lines with "error": ``occurrences, message, display``.

    Lines are counted as they are; ``display`` collapses blanks afterwards. Ties go
    to the greater line. With ``by_file``, ``n`` per file.

    Error lines are mostly different, so counting them would shuffle their whole text. Counted
    are 128 bits of hash with the first characters instead; the lines are fetched by a second
    scan, for the hashes above the n-th place, and for all lines that share count and first
    characters with it: those the full text ranks. Two fetched lines with the same hash
    raise an error, as their counts were one.
    """
    keys = ["file"] if by_file else []
    line = F.col("line")
    rows = computed(
        df.where(has_error(line)).select(*keys, "line"),
        h1=F.xxhash64(F.lit(1), line), h2=F.xxhash64(F.lit(2), line), lead=F.left(line, F.lit(LEAD)),
    )
    counted = rows.groupBy(*keys, "h1", "h2", "lead").agg(F.count("*").alias("expected"))
    order = [F.desc("expected"), F.desc("lead")]
    top = top_per_group(counted, keys, order, n) if by_file else counted.orderBy(*order).limit(n)
    place = F.struct("expected", "lead")
    top = top.withColumn("edge", F.min(place).over(Window.partitionBy(*keys)))
    above = place > F.col("edge")
    wanted = top.select(*keys, "lead", "expected", F.when(above, F.col("h1")).alias("k1"), F.when(above, F.col("h2")).alias("k2")).distinct()
    wanted = _handed_round(df, wanted, n, by_file).alias("w")
    same = F.col("r.lead") == F.col("w.lead")
    for key in keys:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"w.{key}"))
    same = same & (F.col("w.k1").isNull() | ((F.col("w.k1") == F.col("r.h1")) & (F.col("w.k2") == F.col("r.h2"))))
    fetched = (
        rows.alias("r").join(wanted, same)
        .groupBy(*[f"r.{key}" for key in keys], "r.line", "r.h1", "r.h2", "w.expected", F.col("w.k1").isNotNull().alias("above"))
        .agg(F.count("*").alias("occurrences")).withColumnRenamed("line", "message")
    )
    alike = F.count("*").over(Window.partitionBy(*keys, "h1", "h2", "above"))
    checked = F.when(alike > 1, F.raise_error(F.lit("two error lines have the same hash"))).otherwise(F.col("occurrences")).cast("bigint")
    fetched = fetched.withColumn("occurrences", checked).where("above or occurrences = expected").select(*keys, "occurrences", "message")
    order = [F.desc("occurrences"), F.desc("message")]
    top = top_per_group(fetched, keys, order, n) if by_file else fetched.orderBy(*order).limit(n)
    return top.select(*keys, "occurrences", "message", collapse_blanks(F.col("message")).alias("display"))


def _handed_round(df: DataFrame, wanted: DataFrame, n: int, by_file: bool) -> DataFrame:
    """``wanted``, which has ``n`` rows and one more (per file), marked for broadcast if these are few."""
    rows = (n + 1) * (split_bound(df) if by_file else 1)
    return F.broadcast(wanted) if rows <= BROADCAST_BLOCKS else wanted


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group. Each task hands on its first ``n`` of a group, up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; raise that for a greater ``n``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n).drop("rank")


def unique_errors(df: DataFrame, threshold: int = 1) -> DataFrame:
    """Cleaned error messages with at least ``threshold`` occurrences, the most frequent first; comments left out.

    Equally frequent ones are in descending binary order.
    """
    return _unique_errors(df, threshold).orderBy(F.desc("occurrences"), F.desc("message"))


def messages_by_file(df: DataFrame) -> DataFrame:
    """``file, message, occurrences`` of the cleaned error messages."""
    return _unique_errors(df, 1, "file")


def _unique_errors(df: DataFrame, threshold: int, *by: str) -> DataFrame:
    line = F.col("line")
    return (
        df.where(has_error(line) & ~line.rlike(COMMENT))
        .groupBy(*by, error_message(line).alias("message")).agg(F.count("*").alias("occurrences"))
        # one condition on both columns stays above the aggregation; a filter on the
        # message alone would be pushed below it and clean every line twice
        .where(F.when(F.col("message") != "", F.col("occurrences")) >= threshold)
        .select(*by, "occurrences", "message")
    )


def error_chart(df: DataFrame, threshold: int = 1) -> DataFrame:
    """Unique errors in their order with a bar each; messages sanitised and cut to 50 characters."""
    largest = _unique_errors(df, threshold).agg(F.max("occurrences")).scalar()
    return unique_errors(df, threshold).select(
        "occurrences",
        F.substring(sanitize_text(F.col("message")), 1, 50).alias("message"),
        bar(F.col("occurrences"), largest).alias("bar"),
    )
