"""Positions in file order after filters: limit, sample, pages.

Position is semantic here, but a global sort would pass everything through one task.
Rows are counted per block of line numbers instead; the block table (one row per
block) gets running totals, and only blocks that hold wanted positions are ranked,
each on its own. Rows of the other blocks are never shuffled. Lines as read, without
numbers, are counted per split instead.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.sources.files import bounded

BLOCK = 1_000_000
PAGE_SIZE = 40


def position(df: DataFrame) -> Column:
    """What orders the lines of a block."""
    return F.col("line_no" if "line_no" in df.columns else "seq")


def with_block(df: DataFrame, block: int) -> DataFrame:
    """Blocks of line numbers; lines without numbers keep the split they were read in."""
    if "line_no" not in df.columns:
        return df
    return df.withColumn("block", F.call_function("div", F.col("line_no"), F.lit(block)))


def _order(df: DataFrame) -> list[str]:
    return ["line_no"] if "line_no" in df.columns else ["block", "seq"]


def block_table(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file, block, n, before, total``: rows of the block, rows ahead of it, rows in all."""
    blocks = with_block(df, block).groupBy("file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = running(blocks.groupBy("file").agg(F.sum("n").alias("n"))).select("file", F.col("before").alias("file_before"), "total")
    return (
        blocks.withColumn("in_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(files, "file")
        .select("file", "block", "n", (F.col("in_file") + F.col("file_before")).alias("before"), "total")
    )


def running(files: DataFrame) -> DataFrame:
    """``file, n, before, total`` of a table of one row per file (names and counts only)."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))


def rank_in_blocks(df: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """``position`` of rows in the blocks given, each block on its own."""
    in_block = Window.partitionBy("file", "block").orderBy(_order(df)[-1])
    return (
        with_block(df, block).join(blocks, ["file", "block"])
        .withColumn("position", F.col("before") + F.row_number().over(in_block))
    )


def positions(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``df`` with the 1-based ``position`` of every row in (file, line) order."""
    return rank_in_blocks(df, block_table(df, block), block).select("position", *df.columns)


def position_range(df: DataFrame, first: int, last: int, block: int = BLOCK) -> DataFrame:
    """Rows at positions ``first`` to ``last``."""
    blocks = block_table(df, block).where((F.col("before") < last) & (F.col("before") + F.col("n") >= first))
    ranked = rank_in_blocks(df, bounded(df, blocks), block)
    return ranked.where(F.col("position").between(first, last)).select("position", *df.columns)


def at_positions(df: DataFrame, wanted: list[int], block: int = BLOCK) -> DataFrame:
    """Rows at these positions, some hundred at most."""
    listed = F.array(*[F.lit(p).cast("bigint") for p in wanted])
    holds = F.exists(listed, lambda p: (p > F.col("before")) & (p <= F.col("before") + F.col("n")))
    ranked = rank_in_blocks(df, F.broadcast(block_table(df, block).where(holds)), block)  # a block per position at most
    return ranked.where(F.col("position").isin(wanted)).select("position", *df.columns)


def limit_lines(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows, sorted by file and line."""
    if n < 0:
        raise ValueError("a limit cannot be negative")
    return df.orderBy("file", *_order(df)).limit(n)


def sample_step(total: Column) -> Column:
    """Distance of sampled rows: about 20, 30 or 50 rows out of ``total``."""
    size = F.when(total > 1000, 50).when(total > 100, 30).otherwise(20)
    return F.greatest(F.lit(1), F.floor(total / size))


def systematic_sample(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every ``step``-th row in (file, line) order, the step depending on the row count."""
    step = F.col("step")
    blocks = (
        block_table(df, block)
        .withColumn("step", sample_step(F.col("total")))
        .where(F.floor((F.col("before") + F.col("n")) / step) > F.floor(F.col("before") / step))
    )
    # fewer than twice the sample size of positions, so at most 100 blocks
    ranked = rank_in_blocks(df, F.broadcast(blocks), block)
    return ranked.where(F.col("position") % step == 0).select("position", *df.columns)


def page(df: DataFrame, number: int, size: int = PAGE_SIZE, block: int = BLOCK) -> DataFrame:
    """Rows of one page, with their position in the view; a number beyond the last page gives the last one."""
    wanted = max(number, 1)
    blocks = block_table(df, block).withColumn("page", F.least(F.lit(wanted), F.greatest(F.lit(1), F.ceil(F.col("total") / size))))
    first = (F.col("page") - 1) * size + 1
    blocks = blocks.where((F.col("before") < first + size - 1) & (F.col("before") + F.col("n") >= first))
    ranked = rank_in_blocks(df, bounded(df, blocks), block)
    return ranked.where(F.col("position").between(first, first + size - 1)).select("position", *df.columns)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``entries, pages``; an empty view has one page."""
    n = F.count("*")
    return df.agg(n.alias("entries"), F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint").alias("pages"))


