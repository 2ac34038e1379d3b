"""Lines as rows: CSV rows of the three writers, and log entries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.messages import csv_message, with_message
from logscope.functions.severity import severity
from logscope.functions.text import is_content
from logscope.functions.timestamps import extract_ts

# profile: definitions of timestamp, severity, message
ROW_PROFILES = {
    "csv": ("csv", "csv", "csv"),
    "separator": ("detected", "detected", "separator"),
    "view": ("view", "contextual", "contextual"),
}


def _places(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "line"]


def csv_rows(df: DataFrame, profile: str = "csv", year: int | None = None) -> DataFrame:
    """Content lines as ``timestamp, severity, message``; a missing timestamp is empty.

    ``csv`` is the main export and keeps every content line. ``separator`` and
    ``view`` leave out lines whose message is empty or starts with ``#``.
    """
    of_ts, of_severity, of_message = ROW_PROFILES[profile]
    line = F.col("line")
    staged = df.where(is_content(line)).withColumn("ts", extract_ts(line, of_ts, year))
    if profile == "csv":
        rows = staged.withColumn("message", csv_message(line, F.col("ts")))
    else:
        rows = with_message(staged, of_message, year)
        rows = rows.where((F.col("message") != "") & ~F.col("message").startswith("#"))
    return rows.select(
        *_places(df),
        F.coalesce("ts", F.lit("")).alias("timestamp"),
        severity(line, of_severity).alias("severity"),
        "message",
    )


def log_entries(df: DataFrame) -> DataFrame:
    """Lines that are not blank as ``raw, severity, timestamp, message``; no message is derived."""
    line = F.col("line")
    return df.where(F.trim(line) != "").select(
        *_places(df),
        line.alias("raw"),
        severity(line, "api").alias("severity"),
        extract_ts(line, "api").alias("timestamp"),
        F.lit(None).cast("string").alias("message"),
    )
