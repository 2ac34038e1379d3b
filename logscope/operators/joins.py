"""Join of lines with a table of one row per file."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.operators.ranking import BLOCK, with_block
from logscope.sources.files import BROADCAST_BLOCKS, split_bound


def join_per_file(df: DataFrame, per_file: DataFrame, limit: int = BROADCAST_BLOCKS, block: int = BLOCK) -> DataFrame:
    """Left join on ``file``.

    One file may hold much of the data, so lines are never shuffled by file. The
    per-file side is broadcast if the scan cannot have more files than ``limit``;
    beyond that it is spread to the blocks of its files, and lines meet it by
    (file, block), which a split or a million lines bounds.
    """
    if split_bound(df) <= limit:
        return df.join(F.broadcast(per_file), "file", "left")
    blocked = with_block(df, block)
    per_block = blocked.select("file", "block").distinct().join(per_file, "file")
    return blocked.join(per_block, ["file", "block"], "left").select(*df.columns, *[c for c in per_file.columns if c != "file"])
