"""Multi-line records: a stack trace head with the ``at`` lines that follow it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.staged import computed
from logscope.operators.formats import REGISTRY
from logscope.operators.ranking import BLOCK, position, with_block

CONTINUATION = r"^\tat .+"


def stacktrace_lines(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file, head_no, line_no, line``: head and continuation lines, with the line number of their record's head.

    ``df`` holds all lines of its files. A line belongs to the last head above it
    unless some line between is neither head nor continuation. Heads and breaks are
    marks, ``2 * line_no`` and one more for heads, so the greatest mark so far decides.
    Within a block of lines (a split, for lines as read) the marks come from the kept
    lines alone (a break shows as a gap in their places), and only these are shuffled.
    A table of one row per block has the last mark of earlier blocks, and what turns
    places into line numbers: two scans in all.
    """
    line, at = F.col("line"), F.col("at")
    numbered = "line_no" in df.columns
    blocked = with_block(df, block).select("file", "block", position(df).alias("at"), "line")
    blocked = computed(blocked, is_head=line.rlike(REGISTRY["java_stacktrace"].regex))
    kept = F.col("is_head") | line.rlike(CONTINUATION)
    blocks = blocked.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("at").alias("first"),
        F.max(F.when(F.col("is_head"), at * 2 + 1).when(~kept, at * 2)).alias("mark"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.lit(0) if numbered else F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1
    carried = blocks.withColumn("shift", shift).select(
        "file", "block", "first", "shift", F.max(F.col("mark") + 2 * F.col("shift")).over(earlier).alias("mark_before")
    )
    in_block = Window.partitionBy("file", "block").orderBy("at")
    above = F.coalesce(F.lag("at").over(in_block), F.col("first") - 1)
    marked = blocked.where(kept).join(carried, ["file", "block"]).withColumn("above", above).withColumn(
        "mark", F.when(F.col("is_head"), at * 2 + 1).when(F.col("above") != at - 1, (at - 1) * 2)
    )
    so_far = F.max("mark").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("mark", F.coalesce(so_far + 2 * F.col("shift"), "mark_before"))
        .where("mark % 2 = 1")
        .selectExpr("file", "mark div 2 as head_no", "at + shift as line_no", "line")
    )


def stacktrace_records(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per record: exception, message, the ``at`` lines as text.

    A record is one value, however long; ``stacktrace_lines`` has the same lines one
    by one, for records that no row should hold.
    """
    records = stacktrace_lines(df, block).groupBy("file", "head_no").agg(
        F.count("*").alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"),
    )
    regex = REGISTRY["java_stacktrace"].regex
    head = F.col("lines")[0]["line"]
    return records.select(
        "file", "head_no", "n_lines",
        F.regexp_extract(head, regex, 1).alias("exception"),
        F.regexp_extract(head, regex, 2).alias("message"),
        F.array_join(F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x["line"]), "\n").alias("stacktrace"),
    )
