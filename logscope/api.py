"""One call from options to results."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from logscope.frame import LogFrame, read, read_text
from logscope.operators.ranking import limit_lines, systematic_sample
from logscope.operators.rows import csv_rows, log_entries
from logscope.options import LogOptions


@dataclass(frozen=True)
class LogResult:
    """Lazy frames: the summary of all lines, the selected lines as entries and as CSV rows, counts over time of
    the view and those of its error peaks, and the page of the view that was asked for."""

    summary: DataFrame
    logs: DataFrame
    csv: DataFrame | None
    histogram: DataFrame
    anomalies: DataFrame
    page: DataFrame | None
    view: LogFrame = field(repr=False)


def analyze(spark: SparkSession, paths: str | list[str], options: LogOptions = LogOptions()) -> LogResult:
    return analyze_frame(read(spark, paths), options)


def analyze_string(spark: SparkSession, data: str, options: LogOptions = LogOptions()) -> LogResult:
    return analyze_frame(read_text(spark, data), options)


def analyze_frame(frame: LogFrame, options: LogOptions = LogOptions()) -> LogResult:
    view = frame
    if options.start or options.end:
        view = view.between(options.start, options.end, options.window, year=options.year)
    if options.errors_only:
        view = view.errors_only()
    if options.text:
        view = view.text(options.text, options.regex, options.dialect)
    limit = options.limit
    if limit is None and not options.csv:
        limit = options.shown_lines
    if options.sample:
        lines = systematic_sample(view.view).drop("position")
    elif limit is not None:
        lines = limit_lines(view.view, limit)
    else:
        lines = view.view
    return LogResult(
        summary=frame.summary(options.top_errors),
        logs=log_entries(lines),
        csv=csv_rows(lines, year=options.year) if options.csv else None,
        histogram=view.time_histogram(options.interval, options.year),
        anomalies=view.error_anomalies(options.interval, options.error_threshold, options.year),
        page=None if options.page is None else view.page(options.page, options.page_size),
        view=view,
    )
