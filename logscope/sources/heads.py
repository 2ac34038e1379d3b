"""The first lines of text files, without reading the files.

Spark cuts large files into splits and reads every split it plans, so a condition on line numbers would still scan the
store. A limit right above a scan of one split does stop its reader, a buffer or two after the last line wanted. So each
file above ``PACKED`` bytes is a scan of its own with a limit; smaller files are rows of whole texts, many to a task, whose first lines
are cut off. Which files are of which kind is decided by the file listing.

A scan per file costs the driver some milliseconds. Beyond ``SCANS`` large files a pass over all of them is the faster way for
a cluster that such a store has; ``read_heads`` then gives None, and the heads come from the lines.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this size share tasks.
PACKED = 1 << 20
#: Files above that size, each a scan of its own, at most.
SCANS = 512
#: A split size that no file reaches.
_WHOLE = 1 << 50


def whole_files(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` that reads a file as one split; files are split as the session that opened them says."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE)
    own.conf.set("spark.sql.files.openCostInBytes", _WHOLE)
    return own


def large_files(spark: SparkSession, paths: str | list[str], packed: int = PACKED, most: int = SCANS) -> list[str]:
    """Files above a size, one more than ``most`` at most; their listing alone, no content."""
    listed = spark.read.format("binaryFile").load(paths).where(F.col("length") > packed)
    return [r["path"] for r in listed.select("path").limit(most + 1).collect()]


def literal(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_heads(spark: SparkSession, paths: str | list[str], n: int, packed: int = PACKED, scans: int = SCANS) -> DataFrame | None:
    """``file, line_no, line``: the first ``n`` lines of each text file; None for too many large files. Missing paths raise."""
    large = large_files(spark, paths, packed, scans)
    if len(large) > scans:
        return None
    file = F.col("_metadata.file_path").alias("file")
    pieces = F.split("value", "\n", n + 1)
    ended = F.col("value").endswith("\n") & (F.size(pieces) <= n)
    lines = F.slice(pieces, F.lit(1), F.when(ended, F.size(pieces) - 1).otherwise(n))
    small = spark.read.text(paths, wholetext=True).where((F.col("_metadata.file_size") <= packed) & (F.col("value") != ""))
    small = small.select(file, F.posexplode(lines).alias("at", "line")).select("file", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")
    own = whole_files(spark)
    number = (F.monotonically_increasing_id() + 1).alias("line_no")
    return reduce(DataFrame.unionByName, (
        own.read.option("lineSep", "\n").text(literal(path)).select(file, number, F.col("value").alias("line")).limit(n) for path in large
    ), small)
