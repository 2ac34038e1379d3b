"""Log lines derived from the ``events`` table, the same text in Spark and in DuckDB.

Each view is one SQL text; only the few expressions that differ between the two
dialects are filled in. ``line_no`` is the dense position of a line.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.sources.heads import literal, whole_files
from logscope.sources.scratch import scratch_path

SPARK = {
    "day": "date_format(ts,'yyyy-MM-dd')",
    "clock": "date_format(ts,'HH:mm:ss')",
    "millis": "date_format(ts,'SSS')",
    "month": "date_format(ts,'MMM')",
    "us_day": "date_format(ts,'MM/dd/yyyy')",
    "dom": "date_format(ts,'dd')",
    "year": "date_format(ts,'yyyy')",
    "text": "string",
    "four": "lateral view explode(sequence(0,3)) s as j",
    "tab": "char(9)",
}
DUCKDB = {
    "day": "strftime(ts,'%Y-%m-%d')",
    "clock": "strftime(ts,'%H:%M:%S')",
    "millis": "strftime(ts,'%g')",
    "month": "strftime(ts,'%b')",
    "us_day": "strftime(ts,'%m/%d/%Y')",
    "dom": "strftime(ts,'%d')",
    "year": "strftime(ts,'%Y')",
    "text": "varchar",
    "four": "cross join (select unnest([0,1,2,3]) as j) s",
    "tab": "chr(9)",
}

# Mixed log: four timestamp forms, lines without one, comments, blank lines.
MIXED = """
base AS (SELECT event_id, event_type, user_id, {day} AS d, {clock} AS t, {month} AS mon, {us_day} AS us,
  cast(day(ts) AS {text}) AS dom, CASE event_type
  WHEN 'error'    THEN 'ERROR Failed to connect to backend-'||cast(user_id % 7 AS {text})||': timeout'
  WHEN 'purchase' THEN 'WARNING Slow query took '||cast(user_id AS {text})||' ms'
  WHEN 'click'    THEN 'INFO User login: user'||cast(user_id AS {text})
  WHEN 'view'     THEN 'DEBUG cache probe '||props
  ELSE 'request completed for user'||cast(user_id AS {text}) END AS body FROM events),
log_lines AS (SELECT {file} AS file, cast(event_id+1 AS bigint) AS line_no, CASE
  WHEN event_id % 100 = 19 THEN ''
  WHEN event_id % 100 = 9  THEN '# rotated, last error count '||cast(event_id AS {text})
  WHEN event_id % 10 < 4 THEN d||' '||t||' '||body
  WHEN event_id % 10 < 6 THEN d||'T'||t||'Z '||body
  WHEN event_id % 10 = 6 THEN mon||' '||lpad(dom,2,' ')||' '||t||' host1 app[77]: '||body
  WHEN event_id % 10 = 7 THEN us||' '||t||' '||body
  ELSE body END AS line FROM base)"""

ONE_FILE = "'app.log'"
# All lines with "error" are in the first of two files.
QUIET_FILE = "CASE WHEN event_type = 'error' OR event_id % 100 = 9 THEN 'app-0.log' ELSE 'app-'||cast(user_id % 2 AS {text})||'.log' END"
FOUR_FILES = "'app-'||cast(user_id % 4 AS {text})||'.log'"

# One file per named format; every 50th line is of no format.
EVENTS = """
ev AS (SELECT event_id, cast(event_id+1 AS bigint) AS line_no, cast(user_id AS {text}) AS u, event_type AS e,
  {day} AS d, {clock} AS t, {millis} AS ms, {dom}||'/'||{month}||'/'||{year}||':'||{clock}||' +0000' AS clf,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS lvl,
  regexp_extract(props,'[0-9]+',0) AS k, event_id % 50 <> 7 AS good FROM events)"""

# name: (line, {field: value}) as SQL over EVENTS
FORMAT_LINES = {
    "spring_boot": (
        "d||' '||t||'.'||ms||' [main] '||lvl||' com.example.App - '||e||' by user'||u",
        {"timestamp": "d||' '||t||'.'||ms", "thread": "'[main]'", "severity": "lvl", "logger": "'com.example.App'",
         "message": "e||' by user'||u"}),
    "winston": (
        "d||'T'||t||'.'||ms||'Z '||lvl||' '||e||' by user'||u",
        {"timestamp": "d||'T'||t||'.'||ms||'Z'", "severity": "lvl", "message": "e||' by user'||u"}),
    "django": (
        "d||' '||t||','||ms||' '||lvl||' django.request: '||e||': /api/'||k",
        {"timestamp": "d||' '||t||','||ms", "severity": "lvl", "module": "'django.request'",
         "message": "e||': /api/'||k"}),
    "apache_common": (
        "'192.0.2.'||k||' - user'||u||' ['||clf||'] \"GET /'||e||' HTTP/1.1\" 200 '||k",
        {"host": "'192.0.2.'||k", "ident": "'-'", "authuser": "'user'||u", "timestamp": "clf",
         "request": "'GET /'||e||' HTTP/1.1'", "status": "'200'", "bytes": "k"}),
    "apache_combined": (
        "'192.0.2.'||k||' - user'||u||' ['||clf||'] \"GET /'||e||' HTTP/1.1\" 404 - \"https://example.com/'||u||'\" \"Mozilla/5.0\"'",
        {"host": "'192.0.2.'||k", "ident": "'-'", "authuser": "'user'||u", "timestamp": "clf",
         "request": "'GET /'||e||' HTTP/1.1'", "status": "'404'", "bytes": "'-'",
         "referer": "'https://example.com/'||u", "user_agent": "'Mozilla/5.0'"}),
    "nginx_access": (
        "'192.0.2.'||k||' - user'||u||' ['||clf||'] \"POST /'||e||' HTTP/1.1\" 201 '||u||' \"-\" \"curl/8.0\"'",
        {"remote_addr": "'192.0.2.'||k", "remote_user": "'user'||u", "timestamp": "clf",
         "request": "'POST /'||e||' HTTP/1.1'", "status": "'201'", "body_bytes_sent": "u",
         "http_referer": "'-'", "http_user_agent": "'curl/8.0'"}),
    "json": (
        "'{\"timestamp\":\"'||d||'T'||t||'Z\",\"level\":\"'||lvl||'\",\"message\":\"'||e||' by user'||u||'\"}'",
        {"json_data": "'{\"timestamp\":\"'||d||'T'||t||'Z\",\"level\":\"'||lvl||'\",\"message\":\"'||e||' by user'||u||'\"}'"}),
    "simple": (
        "d||' '||t||' '||lvl||' '||e||' by user'||u",
        {"timestamp": "d||' '||t", "severity": "lvl", "message": "e||' by user'||u"}),
    "syslog": (
        "'<'||k||'>1 '||d||'T'||t||'Z host1 app '||u||' ID47 - '||e||' by user'||u",
        {"priority": "k", "version": "'1'", "timestamp": "d||'T'||t||'Z'", "hostname": "'host1'", "app_name": "'app'",
         "proc_id": "u", "msg_id": "'ID47'", "structured_data": "'-'", "message": "e||' by user'||u"}),
    "postgresql": (
        "d||' '||t||'.'||ms||' UTC ['||u||'] user=app,db=prod, ERROR: relation \"'||e||'\" does not exist'",
        {"timestamp": "d||' '||t||'.'||ms||' UTC'", "pid": "u", "user": "'app'", "database": "'prod'",
         "severity": "'ERROR'", "message": "'relation \"'||e||'\" does not exist'"}),
    "mysql_error": (
        "d||'T'||t||'.'||ms||'Z '||u||' ['||lvl||'] [MY-010119] [Server] '||e",
        {"timestamp": "d||'T'||t||'.'||ms||'Z'", "thread_id": "u", "severity": "lvl", "subsystem": "'MY-010119'",
         "message": "'[Server] '||e"}),
    "aws_cloudtrail": (
        "'{\"Records\":[{\"eventName\":\"'||e||'\",\"awsRegion\":\"r'||k||'\"},{\"eventName\":\"Again\",\"errorCode\":\"'||lvl||'\"}]}'",
        {"json_data": "'{\"Records\":[{\"eventName\":\"'||e||'\",\"awsRegion\":\"r'||k||'\"},{\"eventName\":\"Again\",\"errorCode\":\"'||lvl||'\"}]}'"}),
    "kubernetes": (
        "d||'T'||t||'.'||ms||'Z '||lvl||' kubelet: '||e||' of pod-'||u",
        {"timestamp": "d||'T'||t||'.'||ms||'Z'", "severity": "lvl", "component": "'kubelet'",
         "message": "e||' of pod-'||u"}),
    "java_stacktrace": (
        "'java.lang.IllegalStateException: '||e||' by user'||u",
        {"exception": "'java.lang.IllegalStateException'", "message": "e||' by user'||u"}),
    "w3c_iis": (
        "CASE WHEN event_id % 50 = 0 THEN '#Fields: date time cs-method cs-uri-stem sc-bytes' ELSE d||' '||t||' GET /'||e||' '||k END",
        {"fields": "CASE WHEN event_id % 50 = 0 THEN 'date time cs-method cs-uri-stem sc-bytes' ELSE '' END",
         "data": "CASE WHEN event_id % 50 = 0 THEN '' ELSE d||' '||t||' GET /'||e||' '||k END"}),
}
OTHER_LINE = "'-- no format '||u"


def format_lines_sql(*names: str) -> str:
    """A file per named format, all from one scan."""
    lines = ", ".join(
        f"struct('{n}.log' AS file, CASE WHEN good THEN {FORMAT_LINES[n][0]} ELSE {OTHER_LINE} END AS line)" for n in names
    )
    return f"SELECT x.file, line_no, x.line FROM ev LATERAL VIEW inline(array({lines})) x AS file, line"


# JSON lines: level or severity, missing message, malformed text.
JSON_LINES = """
json_lines AS (SELECT 'json.log' AS file, line_no, CASE
  WHEN event_id % 20 = 3 THEN '{{"timestamp":"'||d||'","level":'
  WHEN event_id % 20 = 5 THEN '{{"timestamp":"'||d||'T'||t||'Z","severity":"'||lvl||'"}}'
  ELSE '{{"timestamp":"'||d||'T'||t||'Z","level":"'||lvl||'","message":"'||e||' by user'||u||'"}}' END AS line FROM ev)"""

# JSON of six shapes: nested, of mixed types, empty, malformed, plain text, an array at the top.
JSON_SHAPES = """
json_shapes AS (SELECT 'shapes.log' AS file, line_no, event_id % 7 AS shape, CASE event_id % 7
  WHEN 0 THEN '{{"a":'||u||',"b":{{"c":"'||lvl||'","d":[1,2.5,"z"]}}}}' WHEN 1 THEN '{{"a":"'||e||'","b":null}}'
  WHEN 2 THEN '{{"a":true,"list":[],"o":{{}},"f":'||u||'.5}}' WHEN 3 THEN '{{"a":' WHEN 4 THEN d||' plain '||e
  WHEN 5 THEN '[1,{{"k":"'||u||'"}}]' ELSE ' ' END AS line FROM ev)"""

# W3C log whose header changes and repeats.
W3C_LINES = """
w3c_lines AS (SELECT 'iis.log' AS file, line_no, CASE
  WHEN event_id % 1000 = 0 THEN '#Fields: date time cs-method sc-status'
  WHEN event_id % 1000 = 500 THEN '#Fields: date time sc-status cs-method'
  WHEN event_id % 1000 < 500 THEN d||' '||t||' '||lvl||' '||k
  ELSE d||' '||t||' '||k||' '||lvl END AS line FROM ev)"""

# Four lines per event: stack traces, plain lines, stray "at" lines.
TRACE_LINES = """
trace_lines AS (SELECT 'trace.log' AS file, cast(event_id*4+j+1 AS bigint) AS line_no, CASE
  WHEN event_type = 'error' AND j = 0 THEN 'java.io.IOException: user'||cast(user_id AS {text})||' lost'
  WHEN event_type = 'error' AND j <= user_id % 3 + 1 THEN {tab}||'at com.example.Call.step'||cast(j AS {text})||'(Call.java:'||cast(user_id AS {text})||')'
  WHEN event_type = 'view' AND j = 2 THEN {tab}||'at stray.Line.x(Line.java:1)'
  ELSE 'plain line of '||event_type END AS line FROM events {four})"""

# Control characters, quotes and a comment.
DIRTY_LINES = """
dirty_lines AS (SELECT 'dirty.log' AS file, line_no, CASE WHEN event_id % 10 = 1 THEN '# "kept" as is'
  ELSE lvl||{bell}||' said "'||e||'"'||{tab}||u END AS line FROM ev)"""
SPARK["bell"], DUCKDB["bell"] = "char(7)", "chr(7)"

# Every 400th line of each kind is very long; the others are short ones of the same kinds.
LONG = 50_000
LONG_LINES = f"""
long_lines AS (SELECT 'long.log' AS file, line_no, event_id % 5 AS kind, n, d||' '||t AS ts, CASE event_id % 5
  WHEN 0 THEN d||' '||t||' '||repeat('a.', n) WHEN 1 THEN d||' '||t||' '||repeat('x', n)
  WHEN 2 THEN d||' '||t||repeat(' ', n)||'end' WHEN 3 THEN d||' '||t||' '||repeat(':', n)||' tail x'
  ELSE repeat('a.', n)||'LostException: boom' END AS line
  FROM (SELECT *, CASE WHEN event_id % 400 < 5 THEN {LONG} ELSE 3 END AS n FROM ev))"""


def mixed(dialect: dict[str, str], file: str = ONE_FILE) -> str:
    return MIXED.format(**dialect, file=file.format(**dialect))


def _from_events(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    return _lines_of(spark.read.parquet(f"{sf_dir}/events.parquet"), ctes, select)


def _lines_of(events: DataFrame, ctes: str, select: str) -> DataFrame:
    events.createOrReplaceTempView("logscope_events")
    lines = events.sparkSession.sql(f"WITH {ctes} {select}".replace("FROM events", "FROM logscope_events"))
    # The text of a line is made once, as if it were read: without the generator the
    # optimizer would put the whole CASE in for every mention of the line, and drop
    # joins on a file name that is a constant here.
    return lines.select("line_no", F.inline(F.array(F.struct("file", "line")))).select("file", "line_no", "line")


def log_line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed log as a stream over the table's file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _lines_of(events, mixed(SPARK), "SELECT * FROM log_lines")


def in_batches(lines: DataFrame, path: str, n: int) -> DataFrame:
    """The lines as a stream of ``n`` batches in their order, each a folder written after the one before."""
    last = lines.agg(F.max("line_no")).first()[0] or 0
    for i in range(n):
        part = lines.where((F.col("line_no") > last * i // n) & (F.col("line_no") <= last * (i + 1) // n))
        part.coalesce(1).write.mode("append").parquet(path)
    return lines.sparkSession.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path)


def log_lines(spark: SparkSession, sf_dir: str, file: str = ONE_FILE) -> DataFrame:
    return _from_events(spark, sf_dir, mixed(SPARK, file), "SELECT * FROM log_lines")


# Rarer forms of time, errors by other words, quotes, and an error that a threshold cuts.
# What each kind must give is stated in the SQL from these columns, without any pattern.
VARIED_LINES = """
varied AS (SELECT event_id, cast(event_id+1 AS bigint) AS line_no, event_id % 12 AS kind, {day} AS d, {clock} AS t, {us_day} AS us,
  {month}||' '||lpad(cast(day(ts) AS {text}),2,' ')||' '||{clock} AS md, cast(1704067200 + event_id AS {text}) AS sec FROM events),
varied_lines AS (SELECT 'varied.log' AS file, line_no, CASE kind
  WHEN 0 THEN sec||' INFO tick' WHEN 1 THEN sec||'123 WARNING tock' WHEN 2 THEN d||' | '||t||' INFO piped' WHEN 3 THEN d||' INFO dated'
  WHEN 4 THEN us||' INFO dated' WHEN 5 THEN 'Mon '||md||' 2024 ERROR "quoted" failure' WHEN 6 THEN d||'T'||t||'.123+02:00 FATAL core dumped'
  WHEN 7 THEN d||' '||t||' INFO seen at 2024-02-02 02:02:02' WHEN 8 THEN 'exception in worker' WHEN 10 THEN d||' '||t||' ERROR said "no"'
  WHEN 9 THEN d||' '||t||' ERROR '||CASE WHEN event_id < 40 THEN 'rare' ELSE 'common' END||' thing' ELSE 'plain' END AS line FROM varied)"""

PARTS = 4

# CSV records, some with a field too many, behind a header for each file.
CSV_TEXT = """
csv_text AS (SELECT 'rows.csv' AS file, line_no, 'timestamp,severity,message' AS line FROM ev WHERE event_id < 4 UNION ALL
  SELECT 'rows.csv' AS file, line_no + 4 AS line_no, CASE WHEN event_id % 10 = 4 THEN '"'||d||'","'||lvl||'","'||e||'","more"'
  ELSE '"'||d||'","'||lvl||'","said ""'||e||'"", twice"' END AS line FROM ev)"""

# Traces and headers dealt to files by ``line_no % PARTS``.
TRACE_FILES = TRACE_LINES.replace("trace_lines AS", "trace_files AS").replace("event_id*4+j+1", "(event_id*4+j)*4+event_id%4")
W3C_FILES = """
w3c_files AS (SELECT 'iis.log' AS file, line_no, CASE
  WHEN event_id % 1000 < 4 THEN '#Fields: date time cs-method sc-status'
  WHEN event_id % 1000 BETWEEN 500 AND 503 THEN '#Fields: date time sc-status cs-method'
  WHEN event_id % 1000 < 500 THEN d||' '||t||' '||lvl||' '||k
  ELSE d||' '||t||' '||k||' '||lvl END AS line FROM ev)"""

# A header every few lines, so that a split has one, several or none, and lines before any.
W3C_SHORT = """
w3c_short AS (SELECT 'iis.log' AS file, line_no, CASE
  WHEN event_id < 8 THEN d||' '||t||' before any header'
  WHEN event_id % 40 BETWEEN 8 AND 11 THEN '#Fields: date time cs-method sc-status'
  WHEN event_id % 40 BETWEEN 28 AND 31 THEN '#Fields: date time sc-status cs-method'
  WHEN event_id % 40 BETWEEN 12 AND 27 THEN d||' '||t||' '||lvl||' '||k
  ELSE d||' '||t||' '||k||' '||lvl END AS line FROM ev)"""


def written_log(spark: SparkSession, lines: DataFrame, label: str) -> str:
    """The lines (``file, line_no, line, part``) as text files, one per ``part``, in a folder of the shared scratch folder."""
    path = scratch_path(spark, label)
    add_to_log(lines, path)
    return path


#: Bytes of text that a task sorts, on average.
PIECE_BYTES = 32 << 20


def add_to_log(lines: DataFrame, path: str) -> None:
    """More files of a written log.

    A file has one writer, but no task sorts a file. Ranges of lines are sorted, each by its own task, and kept as pieces;
    the writer reads the pieces of its file one after the other and holds none.
    """
    spark = lines.sparkSession
    rows = lines.select("part", "line_no", F.col("line").alias("value"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 1)).first()[0]
    if size is None:
        return rows.select("part", "value").write.mode("append").partitionBy("part").text(path)
    pieces = scratch_path(spark, "pieces")
    ranges = rows.repartitionByRange(size // PIECE_BYTES + 1, "part", "line_no").withColumn("piece", F.spark_partition_id())
    ranges.sortWithinPartitions("part", "piece", "line_no").drop("line_no").write.partitionBy("part", "piece").parquet(pieces)
    files: dict[int, list[str]] = {}
    for r in spark.read.format("binaryFile").load(pieces).select("part", "piece", "path").orderBy("part", "piece").collect():
        files.setdefault(r["part"], []).append(literal(r["path"]))
    whole = whole_files(spark)

    def write(part: int) -> None:
        read = [whole.read.schema("value string").parquet(piece) for piece in files[part]]
        reduce(DataFrame.union, read).coalesce(1).write.mode("append").text(f"{path}/part={part}")

    with ThreadPoolExecutor(min(len(files), spark.sparkContext.defaultParallelism)) as pool:
        list(pool.map(inheritable_thread_target(spark)(write), files))


def with_part(read: DataFrame) -> DataFrame:
    """Results on written logs, with the number of their file instead of its path."""
    return read.withColumn("part", F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint")).drop("file")


def derived(dialect: dict[str, str], cte: str) -> str:
    return f"{EVENTS.format(**dialect)}, {cte.format(**dialect)}"


def derived_lines(spark: SparkSession, sf_dir: str, cte: str, name: str) -> DataFrame:
    return _from_events(spark, sf_dir, derived(SPARK, cte), f"SELECT * FROM {name}")


def format_lines(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return _from_events(spark, sf_dir, EVENTS.format(**SPARK), format_lines_sql(*names))
