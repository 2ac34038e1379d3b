"""Log lines from text files, with their place in the file.

``read_lines`` is one scan without a shuffle. It yields

    file STRING, block BIGINT, seq BIGINT, line STRING

where ``(block, seq)`` orders the lines of a file: ``block`` is the byte at which the
split starts, ``seq`` grows within the split. Operators that only need an order use
these two; operators that need line numbers call ``number_lines``.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# One row of a table of splits takes about 250 bytes, so a broadcast stays near 100 MB.
# Larger stores should read larger splits (spark.sql.files.maxPartitionBytes);
# beyond the bound the table is joined by a shuffle on (file, block) instead.
BROADCAST_BLOCKS = 400_000


def read_lines(spark: SparkSession, paths: str | list[str], files: list[str] | None = None) -> DataFrame:
    """Lines of text files (only ``\\n`` ends a line), of these ``files`` alone if given. Missing paths raise."""
    read = spark.read.option("lineSep", "\n").text(paths)
    if files is not None:
        # a condition on the path alone leaves the other files out of the plan
        read = read.where(F.col("_metadata.file_path").isin(files))
    return (
        read
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("line"),
        )
    )


def split_shifts(lines: DataFrame) -> DataFrame:
    """``file, block, first, shift`` of each split: its first ``seq``, and what to add to a ``seq`` for the line number.

    The lines of one split are consecutive in ``seq``, so a line number is the number
    of lines in earlier splits plus the distance from the first ``seq`` of the split.
    """
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        "file", "block", "first", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")
    )


def number_lines(lines: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``file, line_no, line`` with 1-based line numbers, from ``read_lines`` output.

    This needs one counting scan; its result has a row per split.
    """
    shifts = bounded(lines, split_shifts(lines).drop("first"), broadcast_blocks)
    return lines.join(shifts, ["file", "block"]).select(
        "file", (F.col("seq") + F.col("shift")).alias("line_no"), "line"
    )


def bounded(lines: DataFrame, per_block: DataFrame, limit: int = BROADCAST_BLOCKS) -> DataFrame:
    """``per_block``, which has a row per split of ``lines`` at most, marked for broadcast if splits are few enough."""
    return F.broadcast(per_block) if split_bound(lines) <= limit else per_block


def split_bound(lines: DataFrame) -> int:
    """A bound of the number of splits, from what the file listing knows: no job, and no paths in Python.

    A file has at most one split that does not fill a partition of its own.
    """
    plan = lines._jdf.queryExecution().optimizedPlan()
    size = lines.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return int(str(plan.stats().sizeInBytes())) // size + len(lines._jdf.inputFiles())


def file_listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, size, modified`` of the files, without their content."""
    place = F.col("_metadata")
    return spark.read.format("binaryFile").load(paths).select(
        place["file_path"].alias("file"), place["file_size"].alias("size"), place["file_modification_time"].alias("modified")
    )
