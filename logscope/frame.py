"""A log view: lines plus an ordered set of named filters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.operators import errors, export, filters, formats, histogram, ranking, records, report, rows, summary
from logscope.sources.csv import write_csv
from logscope.sources.files import number_lines, read_lines
from logscope.sources.heads import read_heads
from logscope.sources.memory import lines_from_text


# Fixed value: how an export's metadata name this filter.
ERRORS_LABEL = "Errors only"


@dataclass(frozen=True)
class Filter:
    label: str
    test: filters.Predicate | Column


@dataclass(frozen=True)
class LogFrame:
    """Immutable. At most one filter of each kind; a new one replaces the old.

    Lines of text files get numbers only when an operation needs them.
    """

    lines: DataFrame
    source: str = "<table>"
    filters: dict[str, Filter] = field(default_factory=dict)
    #: What the lines were read from, if from files.
    paths: str | list[str] | None = None

    # -- filters ---------------------------------------------------------------------

    def with_filter(self, kind: str, label: str, test: filters.Predicate | Column) -> "LogFrame":
        return replace(self, filters={**self.filters, kind: Filter(label, test)})

    def without(self, kind: str) -> "LogFrame":
        return replace(self, filters={k: f for k, f in self.filters.items() if k != kind})

    def clear(self) -> "LogFrame":
        return replace(self, filters={})

    def errors_only(self, broad: bool = False) -> "LogFrame":
        test = filters.has_broad_error if broad else filters.has_error
        return self.with_filter("errors", ERRORS_LABEL, test(F.col("line")))

    def toggle_errors(self) -> "LogFrame":
        return self.without("errors") if "errors" in self.filters else self.errors_only(broad=True)

    def text(self, text: str, regex: bool = False, dialect: str = "basic") -> "LogFrame":
        return self.with_filter("text", f'Text: "{text}"', filters.text_filter(F.col("line"), text, regex, dialect))

    def severity(self, pattern: str, dialect: str = "basic") -> "LogFrame":
        return self.with_filter("severity", f'Severity: "{pattern}"', filters.matches(F.col("line"), pattern, dialect))

    def between(
        self, start: str | None = None, end: str | None = None, window: str = "lexical",
        ts_profile: str = "rich", year: int | None = None,
    ) -> "LogFrame":
        line = F.col("line")
        keep = (
            filters.in_lexical_window(line, start, end) if window == "lexical"
            else filters.in_time_window(line, start, end, ts_profile, year, drop_comments=ts_profile == "range")
        )
        return self.with_filter("range", f"Time range: {start or 'earliest'} to {end or 'latest'}", keep)

    def from_time(self, start: str, year: int | None = None) -> "LogFrame":
        keep = filters.in_time_window(F.col("line"), start, year=year)
        return self.with_filter("from", f"From time: {start}", keep)

    @property
    def labels(self) -> list[str]:
        return [f.label for f in self.filters.values()]

    @property
    def tests(self) -> list:
        return [f.test for f in self.filters.values()]

    def _keep(self, df: DataFrame) -> DataFrame:
        for f in self.filters.values():
            df = filters.where(df, f.test)
        return df

    @property
    def view(self) -> DataFrame:
        return self._keep(self.lines)

    @property
    def numbered(self) -> DataFrame:
        """The view with ``line_no``; numbers are those of the whole file."""
        df = self.lines
        return self._keep(df if "line_no" in df.columns else number_lines(df))

    def counts(self) -> DataFrame:
        return filters.filter_counts(self.lines, *self.tests)

    # -- positions -------------------------------------------------------------------

    def limit(self, n: int) -> DataFrame:
        return ranking.limit_lines(self.view, n)

    def sample(self) -> DataFrame:
        return ranking.systematic_sample(self.view)

    def page(self, number: int, size: int = ranking.PAGE_SIZE) -> DataFrame:
        return ranking.page(self.view, number, size)

    def page_count(self, size: int = ranking.PAGE_SIZE) -> DataFrame:
        return ranking.page_count(self.view, size)

    def page_summary(self, number: int, size: int = ranking.PAGE_SIZE) -> DataFrame:
        return summary.severity_distribution(self.page(number, size), "display")

    def search(self, text: str, start: int, direction: str = "forward") -> DataFrame:
        return filters.search(self.numbered, text, start, direction)

    # -- results: of the view, except for the summary, the reports, the detected format and
    # -- stack traces, which are of all lines

    def summary(self, top: int = 5, filtered: bool = False) -> DataFrame:
        return summary.summarize(self.view if filtered else self.lines, top)

    def csv_rows(self, profile: str = "csv", year: int | None = None) -> DataFrame:
        return rows.csv_rows(self.view, profile, year)

    def entries(self) -> DataFrame:
        return rows.log_entries(self.view)

    def top_errors(self, n: int = 5) -> DataFrame:
        return errors.top_errors(self.view, n)

    def unique_errors(self, threshold: int = 1) -> DataFrame:
        return errors.unique_errors(self.view, threshold)

    def time_histogram(self, interval: str = "hour", year: int | None = None) -> DataFrame:
        return histogram.time_histogram(self.view, interval, year)

    def heads(self, n: int = formats.SAMPLE_LINES) -> DataFrame:
        """The first ``n`` lines of each file; of files, only their beginning is read."""
        heads = None if self.paths is None else read_heads(self.lines.sparkSession, self.paths, n)
        return formats.head_lines(self.lines, n) if heads is None else heads

    def detect_format(self, registry: formats.FormatRegistry = formats.REGISTRY) -> DataFrame:
        return formats.detect_format(self.lines, registry, self.heads())

    def detect_patterns(self) -> DataFrame:
        return formats.detect_patterns(self.lines, self.heads())

    def parse_detected(self) -> DataFrame:
        """Timestamp, severity and message of the view, by the patterns found at the head of each file."""
        return formats.parse_detected(self.view, self.heads())

    def parse(self, name: str) -> DataFrame:
        return formats.parse_format(self.view, name)

    def stacktraces(self) -> DataFrame:
        """Records of all lines: filters would tear them, so filter the records instead."""
        return records.stacktrace_records(self.lines)

    def stacktrace_lines(self) -> DataFrame:
        """The lines of those records one by one, with the line number of their head."""
        return records.stacktrace_lines(self.lines)

    def error_anomalies(self, interval: str = "hour", threshold: int = 100, year: int | None = None) -> DataFrame:
        return histogram.error_anomalies(self.view, interval, threshold, year)

    def error_baseline(self, interval: str = "hour", window: int = 24, factor: float = 3.0, year: int | None = None) -> DataFrame:
        return histogram.error_baseline(self.view, interval, window, factor, year)

    def w3c_rows(self) -> DataFrame:
        """Rows of all lines, as headers apply to what follows them."""
        return formats.w3c_rows(self.lines)

    def report(self, kind: str = "text", year: int | None = None):
        """``csv`` and ``json`` give a frame, ``text`` the frames of its three parts."""
        make = {"csv": report.report_long, "json": report.report_json, "text": report.report_text}
        return make[kind](self.lines, year)

    # -- sinks -----------------------------------------------------------------------

    def to_csv(self, path: str, profile: str = "csv", year: int | None = None) -> None:
        write_csv(self.csv_rows(profile, year), path)

    def export(self, path: str, scope: str = "filtered", year: int | None = None) -> None:
        export.export_view(self.lines, path, self.tests, self.labels, self.source, scope, year)

    def export_metadata(self, scope: str = "filtered") -> DataFrame:
        return export.export_metadata(self.lines, self.tests, self.labels, self.source, scope)


def read(spark: SparkSession, paths: str | list[str]) -> LogFrame:
    source = paths if isinstance(paths, str) else ", ".join(paths)
    return LogFrame(read_lines(spark, paths), source, paths=paths)


def read_text(spark: SparkSession, text: str, name: str = "<text>") -> LogFrame:
    return LogFrame(lines_from_text(spark, text, name), name)
