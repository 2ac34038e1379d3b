"""Reports over a file: JSON summary, long table, JSON report, text report parts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.text import csv_field, sanitize_text
from logscope.operators.errors import error_chart, top_errors
from logscope.operators.histogram import time_histogram
from logscope.operators.summary import date_range, file_statistics, summarize

REPORT_ERRORS = 10
CHART_THRESHOLD = 5


def summary_json(df: DataFrame) -> DataFrame:
    """``file, json``: counts and time range of each file as one JSON object."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return file_statistics(df).select(
        "file",
        F.to_json(F.struct(
            "file",
            F.struct("total_lines", "error_count", "warning_count", "info_count").alias("stats"),
            F.struct(text("time_start").alias("first"), text("time_end").alias("last")).alias("time_range"),
        )).alias("json"),
    )


def _statistics(df: DataFrame, year: int | None) -> DataFrame:
    return date_range(df, year, counts=True)


def report_long(df: DataFrame, year: int | None = None) -> DataFrame:
    """``file, report_type, key, value``: 4 counts, 2 times, up to 10 errors per file."""
    facts = _statistics(df, year).selectExpr(
        "file",
        """stack(6,
            'statistics', 'total_lines', cast(total_lines as string),
            'statistics', 'error_count', cast(error_count as string),
            'statistics', 'warning_count', cast(warning_count as string),
            'statistics', 'info_count', cast(info_count as string),
            'time_range', 'first', coalesce(time_start, ''),
            'time_range', 'last', coalesce(time_end, '')) as (report_type, key, value)""",
    )
    errors = top_errors(df, REPORT_ERRORS, by_file=True).select(
        "file", F.lit("top_errors").alias("report_type"), F.col("occurrences").cast("string").alias("key"),
        F.col("message").alias("value"),
    )
    return facts.unionByName(errors)


def report_json(df: DataFrame, year: int | None = None) -> DataFrame:
    """``file, json``: counts, time range and up to 10 errors of each file."""
    errors = top_errors(df, REPORT_ERRORS, by_file=True).groupBy("file").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(F.col("occurrences").alias("count"), "message"))))
        .alias("top_errors")
    )
    none = F.array().cast("array<struct<count:bigint,message:string>>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _statistics(df, year).join(errors, "file", "left").select(
        "file",
        F.to_json(F.struct(
            "file",
            F.struct("total_lines", "error_count", "warning_count", "info_count").alias("statistics"),
            F.struct(text("time_start").alias("first"), text("time_end").alias("last")).alias("time_range"),
            F.coalesce("top_errors", none).alias("top_errors"),
        )).alias("json"),
    )


def report_text(df: DataFrame, year: int | None = None) -> dict[str, DataFrame]:
    """The three parts of the text report, as frames."""
    return {
        "summary": summarize(df),
        "error_chart": error_chart(df, CHART_THRESHOLD),
        "time_distribution": time_histogram(df, "hour", year),
    }


def escaped_report(report: DataFrame) -> DataFrame:
    """The long report with values as they stand inside a quoted CSV field."""
    return report.withColumn("value", csv_field(F.col("value")))


def sanitized(df: DataFrame) -> DataFrame:
    """Lines safe to show: no control characters, quotes escaped; comment lines as they are."""
    line = F.col("line")
    return df.withColumn("line", F.when(line.rlike(r"^\s*#"), line).otherwise(sanitize_text(line)))
