"""Counts over event time of input that never ends.

A line's timestamps fall into windows of the histogram's interval. A watermark follows the greatest timestamp seen: a window is
finished, and appended to the output once, when the watermark has passed its end; rows that come for it later are
dropped, and counted in the progress of the query. The state holds the open windows of each file and form, whatever the
number of lines. Which form of timestamp a file goes by may show late, so all forms are counted, and ``histogram`` decides it
from the finished windows, as the histogram of files at rest does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logscope.functions.patterns import DETECT_TIMESTAMPS
from logscope.functions.timestamps import to_ts
from logscope.operators.histogram import GRAINS
from logscope.operators.occurrences import occurrences

#: Length of the windows that are counted; months are added up from days.
WINDOWS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "month": "1 day"}


def windowed_counts(lines: DataFrame, interval: str = "hour", year: int | None = None, delay: str = "1 hour") -> DataFrame:
    """``file, form, start, count`` of a stream of lines (``file, line``), for output mode append.

    ``delay`` is how much later than the greatest timestamp a row may come. Timestamps that cannot be read are in no window.
    An unknown interval means hours.
    """
    found = occurrences(lines, DETECT_TIMESTAMPS, "file").where("file is not null and form is not null")
    times = found.select("file", "form", F.explode("found").alias("text")).select("file", "form", to_ts(F.col("text"), year).alias("at"))
    window = F.window("at", WINDOWS.get(interval, WINDOWS["hour"]))
    counts = times.withWatermark("at", delay).groupBy("file", "form", window.alias("window")).agg(F.count("*").alias("count"))
    return counts.select("file", "form", F.col("window.start").alias("start"), "count")


def write_windows(counts: DataFrame, path: str, checkpoint: str, until_empty: bool = True) -> StreamingQuery:
    """Append finished windows under ``path``; ``checkpoint`` holds the open ones, for a restart to go on with."""
    writer = counts.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if until_empty else writer).start(path)


def histogram(spark: SparkSession, path: str, interval: str = "hour") -> DataFrame:
    """``file, bucket, count`` of the finished windows under ``path``, in the order of files and buckets."""
    counts = spark.read.schema("file string, form int, start timestamp, count bigint").parquet(path)
    form = counts.groupBy("file").agg(F.min("form").alias("form"))
    bucket = F.date_format("start", GRAINS.get(interval, GRAINS["hour"])).alias("bucket")
    return counts.join(form, ["file", "form"]).groupBy("file", bucket).agg(F.sum("count").alias("count")).orderBy("file", "bucket")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped so far because their window was finished."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
