"""The registered queries: every operator over whole tables."""

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.frame import LogFrame, read
from logscope.functions import sql
from logscope.functions.messages import error_message, with_message
from logscope.functions.severity import severity
from logscope.functions.timestamps import compare_ts, extract_ts, in_range, normalize_ts, to_epoch
from logscope.index import FileIndex
from logscope.operators import errors, filters, formats, histogram, json_schema, ranking, records, report, rows, summary
from logscope.plans import dataset as D
from logscope.sources.csv import read_csv, write_csv
from logscope.sources.memory import split_text
from logscope.sources.scratch import scratch_path
from logscope.streaming import traces, windows
from logscope.streaming.piped import write_rows

YEAR = 2024
WINDOW = ("2024-01-05", "2024-01-07")

QUERIES = {}


def query(name):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def over_lines(name, make):
    """A query over the mixed log."""
    QUERIES[name] = lambda spark, sf_dir: make(D.log_lines(spark, sf_dir))


def per_line(name, **columns):
    over_lines(name, lambda df: df.select("line_no", *[make(F.col("line")).alias(c) for c, make in columns.items()]))


# -- aggregates ---------------------------------------------------------------------

over_lines("summary_counts", summary.summary_counts)
over_lines("file_statistics", summary.file_statistics)
over_lines("time_range", summary.time_range)
over_lines("time_range_iso", summary.iso_time_range)
over_lines("date_range_norm", lambda df: summary.date_range(df, YEAR))
over_lines("top_errors_5", lambda df: errors.top_errors(df, 5))
over_lines("top_errors_10", lambda df: errors.top_errors(df, 10))
over_lines("unique_errors", errors.unique_errors)
over_lines("unique_errors_threshold", lambda df: errors.unique_errors(df, 100))
over_lines("error_chart", errors.error_chart)
for grain in histogram.GRAINS:
    over_lines(f"hist_{grain}", lambda df, grain=grain: histogram.time_histogram(df, grain, YEAR))
over_lines("hist_peak", lambda df: histogram.peak(histogram.time_histogram(df, "hour", YEAR)))
over_lines("hist_chart", lambda df: histogram.time_chart(histogram.time_histogram(df, "day", YEAR)))
over_lines("hour_error_anomalies", lambda df: histogram.error_anomalies(df, "hour", 3, YEAR))
over_lines("error_baseline", lambda df: histogram.error_baseline(df, "hour", 12, 2.5, YEAR))
over_lines("error_baseline_daily", lambda df: histogram.error_baseline(df.where("line_no % 5 = 1 OR line_no < 40"), "day", 5, 2.0, YEAR))
over_lines("count_by_severity", lambda df: summary.count_severity(df, "warn"))
over_lines("severity_distribution", lambda df: summary.severity_distribution(df, "csv"))


@query("summary")
def summary_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file and frequent error, the summary's counts and range beside it."""
    record = summary.summarize(D.log_lines(spark, sf_dir, D.QUIET_FILE))
    return record.select("*", F.posexplode_outer("top_errors").alias("rank", "error")).select(
        "file", "total_lines", "error_count", "warning_count", "info_count", "time_start", "time_end",
        F.col("rank").cast("bigint").alias("rank"), "error.occurrences", "error.message",
    )


@query("rollup_by_file")
def rollup_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.rollup_by_file(D.log_lines(spark, sf_dir, D.FOUR_FILES))


@query("top_errors_by_file")
def top_errors_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.top_errors(D.log_lines(spark, sf_dir, D.FOUR_FILES), 3, by_file=True)


@query("hist_day_by_file")
def hist_day_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.time_histogram(D.log_lines(spark, sf_dir, D.FOUR_FILES), "day", YEAR)


# -- per line -----------------------------------------------------------------------

for profile in ("csv", "lexical", "rich", "range", "detected", "view", "api"):
    per_line(f"ts_{profile}", ts=lambda line, p=profile: extract_ts(line, p, YEAR))
for profile in ("csv", "api", "display", "contextual", "detected"):
    per_line(f"severity_{profile}", severity=lambda line, p=profile: severity(line, p))
for profile in ("csv", "detected", "separator", "contextual"):
    over_lines(f"msg_{profile}", lambda df, p=profile: with_message(df, p, YEAR).select("line_no", "message"))
per_line("error_message_norm", message=lambda line: F.nullif(error_message(line), F.lit("")))


def per_time(name, profile, column, make):
    """Like ``per_line``, of the extracted timestamp."""
    over_lines(name, lambda df: df.withColumn("ts", extract_ts(F.col("line"), profile, YEAR))
               .select("line_no", make(F.col("ts")).alias(column)))


per_time("ts_normalized", "detected", "ts", lambda ts: normalize_ts(ts, year=YEAR))
per_time("ts_normalized_syslog", "csv", "ts", lambda ts: normalize_ts(ts, "syslog"))
per_time("ts_normalized_format", "rich", "month", lambda ts: normalize_ts(ts, "yyyy-MM"))
per_time("ts_epoch", "rich", "epoch", lambda ts: to_epoch(ts, YEAR))
per_time("ts_compare", "rich", "order", lambda ts: compare_ts(ts, F.lit("2024-01-15 12:00:00"), YEAR).cast("bigint"))
per_time("ts_in_range", "rich", "inside", lambda ts: in_range(ts, "2024-01-05", "2024-01-07 23:59:59", YEAR))


@query("sql_functions")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main CSV columns by a query in SQL."""
    sql.register(spark, YEAR)
    D.log_lines(spark, sf_dir).createOrReplaceTempView("logscope_lines")
    return spark.sql("SELECT line_no, ts_csv(line) AS ts, severity_csv(line) AS severity, msg_csv(line) AS message FROM logscope_lines")


@query("sql_formats")
def sql_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a format by a query in SQL."""
    sql.register(spark, YEAR)
    D.format_lines(spark, sf_dir, "apache_combined").createOrReplaceTempView("logscope_access")
    return spark.sql("SELECT line_no, x.* FROM (SELECT line_no, fields_apache_combined(line) AS x FROM logscope_access)")


@query("sanitize_text")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = D.derived_lines(spark, sf_dir, D.DIRTY_LINES, "dirty_lines")
    return report.sanitized(dirty).select("line_no", "line")


# -- filters ------------------------------------------------------------------------


def kept(name, keep):
    over_lines(name, lambda df: filters.where(df, keep(F.col("line"))).select("line_no", "line"))


kept("filter_errors", filters.has_error)
kept("filter_errors_broad", filters.has_broad_error)
kept("filter_severity_regex", lambda line: filters.matches(line, r"warn\|debug"))
kept("filter_text", lambda line: filters.text_filter(line, "User login: user1"))
kept("filter_regex", lambda line: filters.text_filter(line, r"backend-[0-3]: time", regex=True))
kept("filter_regex_bare", lambda line: filters.text_filter(line, "warn|debug", regex=True))
kept("filter_regex_repeat", lambda line: filters.text_filter(line, r"^20[0-9]\+-.*back\(end\)-\?[35]:", regex=True))
kept("filter_regex_java", lambda line: filters.text_filter(line, "warn|backend-[12]+:", regex=True, dialect="java"))
kept("filter_time_lexical", lambda line: filters.in_lexical_window(line, *WINDOW))
kept("filter_time_epoch", lambda line: filters.in_time_window(line, *WINDOW, year=YEAR))
kept("filter_time_range", lambda line: filters.in_time_window(line, "01/05/2024", "01/07/2024", "range", YEAR, drop_comments=True))
kept("filter_from", lambda line: filters.in_time_window(line, "2024-01-20T06:00:00Z", year=YEAR))
kept("skip_comments", rows.is_content)
over_lines("filter_counts", lambda df: filters.filter_counts(
    df, filters.has_error(F.col("line")), filters.in_time_window(F.col("line"), *WINDOW, year=YEAR)))
over_lines("search_next", lambda df: filters.search(df, "backend-3", 4000))
over_lines("search_prev", lambda df: filters.search(df, "backend-3", 4000, "backward"))


@query("filter_stacked")
def filter_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = LogFrame(D.log_lines(spark, sf_dir)).text("user1").between(*WINDOW, window="instant", year=YEAR)
    view = view.text("backend-1").errors_only()  # the second text replaces the first
    return view.view.select("line_no", "line")


# -- positions ----------------------------------------------------------------------

over_lines("limit_20", lambda df: ranking.limit_lines(df.where(filters.has_error(F.col("line"))), 20).select("line_no", "line"))
over_lines("sample_systematic", lambda df: ranking.systematic_sample(df.where(filters.has_error(F.col("line")))).drop("file"))
over_lines("page_3", lambda df: ranking.page(df.where(filters.has_error(F.col("line"))), 3).drop("file"))
over_lines("page_count", ranking.page_count)
over_lines("page_summary", lambda df: summary.severity_distribution(ranking.page(df, 3), "display"))


@query("positions_by_file")
def positions_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.log_lines(spark, sf_dir, D.FOUR_FILES)
    return ranking.positions(lines.where(filters.has_error(F.col("line")))).select("position", "file", "line_no")


# -- formats ------------------------------------------------------------------------


def parse_query(name):
    def run(spark, sf_dir):
        parsed = formats.parse_format(D.format_lines(spark, sf_dir, name), name)
        return parsed.drop("file", "line")
    QUERIES[f"parse_{name}"] = run


for name in D.FORMAT_LINES:
    parse_query(name)


@query("parse_custom")
def parse_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.parse_detected(D.log_lines(spark, sf_dir)).select("line_no", "timestamp", "severity", "message")


@query("json_fields")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.json_fields(D.derived_lines(spark, sf_dir, D.JSON_LINES, "json_lines")).drop("file", "line")


@query("json_schema")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_schema.json_schema(D.derived_lines(spark, sf_dir, D.JSON_SHAPES, "json_shapes"))


@query("json_columns")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.derived_lines(spark, sf_dir, D.JSON_SHAPES, "json_shapes")
    found = json_schema.json_columns(lines, json_schema.json_schema(lines))
    return found.select("line_no", "a", F.col("`b.c`").alias("c"), "f")


@query("syslog_priority")
def syslog_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = formats.parse_format(D.format_lines(spark, sf_dir, "syslog"), "syslog")
    return parsed.select("line_no", *[c.cast("bigint").alias(n) for n, c in zip(
        ("facility", "level"), formats.syslog_priority(F.col("priority")))])


@query("cloudtrail_records")
def cloudtrail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formats.cloudtrail_records(D.format_lines(spark, sf_dir, "aws_cloudtrail"))
    return found.select("line_no", "eventName", "awsRegion", "errorCode")


@query("w3c_rows")
def w3c_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formats.w3c_rows(D.derived_lines(spark, sf_dir, D.W3C_LINES, "w3c_lines"))
    names = {"day": "date", "clock": "time", "method": "cs-method", "status": "sc-status"}
    return found.select("line_no", *[F.col("row")[f].alias(c) for c, f in names.items()])


@query("detect_patterns")
def detect_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.detect_patterns(D.log_lines(spark, sf_dir))


@query("detect_format")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.detect_format(D.format_lines(spark, sf_dir, *D.FORMAT_LINES))


@query("stacktrace_records")
def stacktrace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stacktrace_records(D.derived_lines(spark, sf_dir, D.TRACE_LINES, "trace_lines")).drop("file")


# -- rows, reports, sinks -----------------------------------------------------------

over_lines("csv_rows", lambda df: rows.csv_rows(df, year=YEAR).drop("file"))
over_lines("csv_rows_separator", lambda df: rows.csv_rows(df, "separator").drop("file"))
over_lines("csv_rows_view", lambda df: rows.csv_rows(df, "view").drop("file"))
over_lines("log_entries", lambda df: rows.log_entries(df).drop("file"))
over_lines("summary_json", report.summary_json)
over_lines("report_json", lambda df: report.report_json(df, YEAR))
over_lines("report_long", lambda df: report.escaped_report(report.report_long(df, YEAR)))


@query("split_text_lines")
def split_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")


@query("csv_roundtrip")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(rows.csv_rows(D.log_lines(spark, sf_dir), year=YEAR), path)
    return read_csv(spark, path)


@query("stream_csv_rows")
def stream_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    csv = rows.csv_rows(D.log_line_stream(spark, sf_dir), year=YEAR)
    write_rows(csv, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return read_csv(spark, f"{path}/rows").drop("csv_parse_error")


@query("stream_hist_hour")
def stream_hist_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour of a stream: the windows that are finished when it ends."""
    path = scratch_path(spark, "windows")
    counts = windows.windowed_counts(D.log_line_stream(spark, sf_dir), "hour", YEAR, delay="90 minutes")
    windows.write_windows(counts, f"{path}/counts", f"{path}/checkpoint").awaitTermination()
    return windows.histogram(spark, f"{path}/counts", "hour")


@query("stream_stacktraces")
def stream_stacktraces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a log that comes in four batches, cut anywhere: those that close, and those still open at the end."""
    path = scratch_path(spark, "traces")
    lines = D.derived_lines(spark, sf_dir, D.TRACE_LINES, "trace_lines")
    stream = D.in_batches(lines, f"{path}/lines", 4)
    records = traces.stream_stacktraces(stream)
    records.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/records").awaitTermination()
    closed = spark.read.schema(records.schema).parquet(f"{path}/records")
    return closed.unionByName(traces.open_records(spark, f"{path}/checkpoint")).drop("file")


@query("export_metadata")
def export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = LogFrame(D.log_lines(spark, sf_dir)).errors_only().text("backend-1")
    return replace(view, source="app.log").export_metadata().select(
        "source", "export_type", "total_entries", "filtered_entries", F.array_join("filters", "; ").alias("filters")
    )


# -- registry, sources and reports by name -------------------------------------------


@query("registered_format")
def registered_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format of the user's own, known to a registry of its own: found and parsed."""
    registry = formats.FormatRegistry()
    registry.register("app", "day clock level rest", r"^([0-9]{4}-[0-9-]+) ([0-9:]+) ([A-Z]+) (.*)$", 0)
    lines = D.format_lines(spark, sf_dir, "simple")
    found = formats.detect_format(lines, registry).select("file", "format")
    return formats.parse_format(lines, "app", registry).join(F.broadcast(found), "file").select("line_no", "format", "day", "clock", "level", "rest")


@query("parse_simple_log")
def parse_simple_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.parse_format(D.format_lines(spark, sf_dir, "simple"), "simple_log").select("line_no", "entry")


@query("csv_fields")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with quotes as values of a long report."""
    dirty = D.derived_lines(spark, sf_dir, D.DIRTY_LINES, "dirty_lines")
    return report.escaped_report(dirty.select("line_no", F.col("line").alias("value")))


@query("csv_malformed")
def csv_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV text with records of too many fields, read back."""
    text = D.derived_lines(spark, sf_dir, D.CSV_TEXT, "csv_text").withColumn("part", F.col("line_no") % D.PARTS)
    return read_csv(spark, D.written_log(spark, text, "csv-text")).drop("part")


over_lines("report_text_summary", lambda df: report.report_text(df, YEAR)["summary"].drop("top_errors"))
over_lines("report_text_errors", lambda df: report.report_text(df, YEAR)["error_chart"])
over_lines("report_text_times", lambda df: report.report_text(df, YEAR)["time_distribution"])


@query("stacktrace_lines")
def stacktrace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stacktrace_lines(D.derived_lines(spark, sf_dir, D.TRACE_LINES, "trace_lines")).drop("file")


# -- very long lines ------------------------------------------------------------------


def over_long_lines(name, make):
    QUERIES[name] = lambda spark, sf_dir: make(D.derived_lines(spark, sf_dir, D.LONG_LINES, "long_lines"))


def fingerprint(column):
    return [F.length(column).cast("bigint").alias("length"), F.md5(column).alias("md5")]


over_long_lines("long_lines_csv", lambda df: rows.csv_rows(df, year=YEAR).select("line_no", "timestamp", *fingerprint("message")))
over_long_lines("long_lines_view", lambda df: rows.csv_rows(df, "view").select("line_no", "timestamp", *fingerprint("message")))
over_long_lines("long_lines_traces", lambda df: records.stacktrace_records(df).select("head_no", "n_lines", "message", *fingerprint("exception")))
over_long_lines("long_lines_detect", formats.detect_format)


# -- text files -----------------------------------------------------------------------


def over_files(name, make, lines=lambda spark, sf_dir: D.log_lines(spark, sf_dir, D.FOUR_FILES)):
    """A query over text files: the lines, written as one file per ``line_no % PARTS``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        written = lines(spark, sf_dir).withColumn("part", F.col("line_no") % D.PARTS)
        return D.with_part(make(read(spark, D.written_log(spark, written, name))))
    QUERIES[name] = run


over_files("file_lines_numbered", lambda log: log.numbered)
over_files("file_search", lambda log: log.numbered.groupBy("file").agg(
    F.min(F.when(filters.has_text(F.col("line"), "backend-3") & (F.col("line_no") >= 100), F.col("line_no"))).alias("line_no")))
over_files("file_page", lambda log: log.errors_only().page(3).select("file", "position", "line"))
over_files("file_last_page", lambda log: log.errors_only().page(10**6).select("file", "position", "line"))
over_files("file_sample", lambda log: log.errors_only().sample().select("file", "position", "line"))
over_files("file_limit", lambda log: log.errors_only().limit(25).select("file", "line"))
over_files("file_statistics_of_files", lambda log: summary.file_statistics(log.lines))
over_files("file_date_range", lambda log: summary.date_range(log.lines, YEAR))
over_files("file_time_range_iso", lambda log: summary.iso_time_range(log.lines))
over_files("file_report_long", lambda log: report.report_long(log.lines, YEAR).where("report_type <> 'top_errors'"))
over_files("file_report_whole", lambda log: report.report_long(log.lines, YEAR))
over_files("file_detect_patterns", lambda log: formats.detect_patterns(log.lines))
over_files("file_parse_custom", lambda log: formats.parse_detected(log.numbered).select("file", "line_no", "timestamp", "severity", "message"))
over_files("file_detect_heads", lambda log: log.detect_patterns())
over_files("file_heads", lambda log: log.heads(7))
over_files("file_parse_heads", lambda log: log.parse_detected().select("file", "timestamp", "severity", "message"))
over_files("file_top_errors", lambda log: errors.top_errors(log.lines, 4, by_file=True).select("file", "occurrences", "message"))


def indexed(log):
    """An index of the log's files, of whose tables the first question makes the rows."""
    spark = log.lines.sparkSession
    return FileIndex(spark, log.paths, scratch_path(spark, "index"))


over_files("file_index_page", lambda log: indexed(log).page(log.errors_only(), 3).select("file", "position", "line"))
over_files("file_index_sample", lambda log: indexed(log).sample(log.errors_only()).select("file", "position", "line"))
over_files("file_index_window", lambda log: indexed(log).between(log, *WINDOW, year=YEAR).view.select("file", "line"))
over_files("file_index_statistics", lambda log: indexed(log).statistics())
over_files("file_index_times", lambda log: indexed(log).times(year=YEAR).select("file", "lines", "untimed", "first", "last"))
over_files("file_stacktraces", lambda log: log.stacktraces(),
           lambda spark, sf_dir: D.derived_lines(spark, sf_dir, D.TRACE_FILES, "trace_files"))
over_files("file_w3c_rows", lambda log: log.w3c_rows().select("file", *[
    F.col("row")[f].alias(c) for c, f in {"day": "date", "clock": "time", "method": "cs-method", "status": "sc-status"}.items()]),
    lambda spark, sf_dir: D.derived_lines(spark, sf_dir, D.W3C_FILES, "w3c_files"))


over_files("file_w3c_many_headers", lambda log: log.w3c_rows().select("file", *[
    F.col("row")[f].alias(c) for c, f in {"day": "date", "clock": "time", "method": "cs-method", "status": "sc-status"}.items()]),
    lambda spark, sf_dir: D.derived_lines(spark, sf_dir, D.W3C_SHORT, "w3c_short"))


@query("file_index_errors")
def file_index_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a folder that grows between two questions."""
    lines = D.log_lines(spark, sf_dir).withColumn("part", F.col("line_no") % D.PARTS)
    path = D.written_log(spark, lines.where("part < 2"), "growing")
    index = FileIndex(spark, path, scratch_path(spark, "index"))
    index.unique_errors().count()
    D.add_to_log(lines.where("part >= 2"), path)
    return index.unique_errors(2)


@query("file_detect_format")
def file_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each format: what their first lines say."""
    lines = D.format_lines(spark, sf_dir, *D.FORMAT_LINES)
    part = F.array_position(F.array(*[F.lit(f"{n}.log") for n in D.FORMAT_LINES]), F.col("file"))
    return D.with_part(read(spark, D.written_log(spark, lines.withColumn("part", part), "formats")).detect_format())


@query("file_export_view")
def file_export_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered view of text files, exported: its rows with the counts of its metadata."""
    written = D.log_lines(spark, sf_dir, D.FOUR_FILES).withColumn("part", F.col("line_no") % D.PARTS)
    path = scratch_path(spark, "export")
    log = read(spark, D.written_log(spark, written, "export-log")).errors_only().text("backend-1")
    log.export(path, year=YEAR)
    metadata = spark.read.json(f"{path}/metadata").select("total_entries", "filtered_entries", F.array_join("filters", "; ").alias("filters"))
    return read_csv(spark, f"{path}/data").drop("csv_parse_error").join(F.broadcast(metadata))


# -- rarer forms ----------------------------------------------------------------------


def over_varied(name, make):
    QUERIES[f"varied_{name}"] = lambda spark, sf_dir: make(D.derived_lines(spark, sf_dir, D.VARIED_LINES, "varied_lines"))


for profile in ("csv", "lexical", "rich", "range", "detected", "view", "api"):
    over_varied(f"ts_{profile}", lambda df, p=profile: df.select("line_no", extract_ts(F.col("line"), p, YEAR).alias("ts")))
over_varied("epoch", lambda df: df.withColumn("ts", extract_ts(F.col("line"), "rich", YEAR)).select("line_no", to_epoch(F.col("ts"), YEAR).alias("epoch")))
over_varied("errors", lambda df: filters.where(df, filters.has_error(F.col("line"))).select("line_no"))
over_varied("errors_broad", lambda df: filters.where(df, filters.has_broad_error(F.col("line"))).select("line_no"))
over_varied("unique_errors", lambda df: errors.unique_errors(df, 4))
over_varied("severity_csv", lambda df: df.select("line_no", severity(F.col("line"), "csv").alias("severity")))
over_varied("severity_api", lambda df: df.select("line_no", severity(F.col("line"), "api").alias("severity")))
over_varied("window", lambda df: filters.where(df, filters.in_time_window(F.col("line"), *WINDOW, year=YEAR)).select("line_no"))
over_varied("range_window", lambda df: filters.where(df, filters.in_time_window(F.col("line"), *WINDOW, "range", YEAR)).select("line_no"))
