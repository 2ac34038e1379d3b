"""Piped input: log files as they arrive, as CSV rows and running counts.

Everything per line is the same code as for files at rest. What depends on the whole
input (line numbers, samples, pages, the form that a file goes by) is not available
on a stream.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logscope.operators.summary import summary_counts
from logscope.sources.csv import csv_options


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of the text files in a folder, and of those that come later."""
    return spark.readStream.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
    )


def write_rows(rows: DataFrame, path: str, checkpoint: str, until_empty: bool = True) -> StreamingQuery:
    """Append CSV rows under ``path``; ``checkpoint`` lets a restart go on where it stopped.

    ``until_empty`` ends with the input that is there, like a pipe at its end.
    """
    writer = csv_options(rows.select("timestamp", "severity", "message").writeStream).format("csv")
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    if until_empty:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def running_counts(lines: DataFrame) -> DataFrame:
    """Line, error, warning and info counts per file so far; for output modes complete and update."""
    return summary_counts(lines, "file")
