"""Log lines from text held in columns or strings, and from tables of lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_text(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of the text column, ``line_no`` from 1 within each text.

    The empty piece after a final newline is no line, as when the text is a file.
    """
    pieces = F.split(F.col(text), "\n")
    pieces = F.when(F.col(text).endswith("\n"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return (
        df.where(F.col(text) != "")
        .select(*keep, F.posexplode(pieces).alias("pos", "line"))
        .select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    )


def lines_from_text(spark: SparkSession, text: str, name: str = "<text>") -> DataFrame:
    """Lines of an in-memory string, for text that the driver already holds."""
    df = spark.createDataFrame([(name, text)], "file string, text string")
    return split_text(df, "text", "file")


def lines_from_table(
    df: DataFrame, line: str | Column, line_no: str | Column, file: str | Column = "<table>"
) -> DataFrame:
    """Lines kept in a table that has its own dense 1-based position column."""
    name = F.lit(file) if isinstance(file, str) and file not in df.columns else file
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        column(name).alias("file"), column(line_no).cast("bigint").alias("line_no"), column(line).alias("line")
    )
