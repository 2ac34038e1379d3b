"""DuckDB SQL with the results that the registered queries have to give.

The SQL states each result in its own way where it can: fields of generated lines come
from the values the lines were built of, positions from plain window functions.
"""

from logscope.functions import patterns as P
from logscope.plans import dataset as D

YEAR = "2024"
ORACLES = {}


def over_lines(name: str, sql: str, file: str = D.ONE_FILE) -> None:
    joint = ", " if sql.startswith("WITH ") else " "
    ORACLES[name] = f"WITH {D.mixed(D.DUCKDB, file)}{joint}{sql.removeprefix('WITH ')}"


def over_derived(name: str, cte: str, sql: str) -> None:
    joint = ", " if sql.startswith("WITH ") else " "
    ORACLES[name] = f"WITH {D.derived(D.DUCKDB, cte)}{joint}{sql.removeprefix('WITH ')}"


def over_formats(name: str, sql: str) -> None:
    ORACLES[name] = f"WITH {D.EVENTS.format(**D.DUCKDB)} {sql}"


def m(pattern: str, text: str = "line") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 0), '')"


def anyof(words, text: str = "lower(line)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def classes(table, default: str, text: str = "lower(line)") -> str:
    return "CASE " + " ".join(f"WHEN {anyof(w, text)} THEN '{c}'" for c, w in table) + f" ELSE '{default}' END"


WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ERROR = "contains(lower(line), 'error')"
COUNTS = """count(*) AS total_lines, count(*) FILTER (WHERE line ILIKE '%error%') AS error_count,
 count(*) FILTER (WHERE line ILIKE '%warn%') AS warning_count, count(*) FILTER (WHERE line ILIKE '%info%') AS info_count"""


def remove_first(text: str, part: str) -> str:
    return (f"CASE WHEN length({part}) > 0 AND instr({text}, {part}) > 0 THEN substr({text}, 1, instr({text}, {part}) - 1)"
            f" || substr({text}, instr({text}, {part}) + length({part})) ELSE {text} END")


# -- timestamps -----------------------------------------------------------------------

ISO_T, ISO_S = f"replace({m(P.ISO_T)}, 'T', ' ')", m(P.ISO_SPACE)
MONTH = m(P.SYSLOG_MONTH_YEAR)
EPOCH = m(P.EPOCH_WORD)
TS = {
    "csv": f"coalesce({ISO_T}, {ISO_S}, {m(P.SYSLOG)}||' {YEAR}', {m(P.US)})",
    "lexical": f"coalesce({ISO_T}, {ISO_S})",
    "view": f"coalesce({ISO_T}, {ISO_S}, {m(P.SYSLOG_PADDED)}, {m(P.US)})",
    "api": m(P.ISO_T_OR_SPACE),
    "detected": "coalesce(" + ", ".join(m(p) for p in P.DETECT_TIMESTAMPS) + ")",
    "rich": f"""coalesce({ISO_T}, replace({m(P.ISO_OPTIONAL_SEPARATOR)}, 'T', ' '),
      CASE WHEN regexp_matches({MONTH}, '[0-9]{{4}}$') THEN {MONTH} ELSE {MONTH}||' {YEAR}' END, {m(P.US_BLANKS)},
      strftime(to_timestamp(CASE WHEN length({EPOCH}) = 13 THEN cast({EPOCH} AS bigint) // 1000 ELSE cast({EPOCH} AS bigint) END) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'))""",
    "range": f"""coalesce({ISO_S}, {ISO_T}, replace({m(P.ISO_PIPE)}, ' | ', ' '), {m(P.ISO_DATE)}||' 12:00:00', {m(P.US)},
      {m(P.US_DATE)}||' 12:00:00', {m(P.SYSLOG_MONTH)}||' {YEAR}')""",
}
for profile, sql in TS.items():
    over_lines(f"ts_{profile}", f"SELECT line_no, {sql} AS ts FROM log_lines")


def instant(ts: str) -> str:
    """TIMESTAMP of a written time."""
    words = f"regexp_replace({ts}, ' +', ' ', 'g')"
    return (f"CASE WHEN regexp_matches({ts}, '^[0-9]{{4}}-') THEN try_cast({ts} AS timestamp)"
            f" WHEN regexp_matches({ts}, '^[0-9]{{2}}/') THEN try_strptime({ts}, '%m/%d/%Y %H:%M:%S')"
            f" ELSE try_strptime({words}, '%b %d %H:%M:%S %Y') END")


def shown(ts: str, fmt: str = "%Y-%m-%d %H:%M:%S") -> str:
    return f"coalesce(strftime({instant(ts)}, '{fmt}'), {ts})"


TIMES = "WITH times AS (SELECT line_no, {} AS ts FROM log_lines) SELECT line_no, {} FROM times"
over_lines("ts_normalized", TIMES.format(TS["detected"], f"CASE WHEN ts LIKE '____-__-__ %' THEN ts ELSE {shown('ts')} END AS ts"))
over_lines("ts_normalized_syslog", TIMES.format(TS["csv"], f"{shown('ts')} AS ts"))
over_lines("ts_normalized_format", TIMES.format(TS["rich"], f"{shown('ts', '%Y-%m')} AS month"))
over_lines("ts_epoch", TIMES.format(TS["rich"], f"cast(floor(epoch({instant('ts')})) AS bigint) AS epoch"))
over_lines("ts_compare", TIMES.format(TS["rich"], f"""cast(CASE WHEN {instant('ts')} = timestamp '2024-01-15 12:00:00' THEN 0
 WHEN {instant('ts')} > timestamp '2024-01-15 12:00:00' THEN 1 WHEN {instant('ts')} < timestamp '2024-01-15 12:00:00' THEN 2 END AS bigint) AS "order" """))
over_lines("ts_in_range", TIMES.format(TS["rich"], f"{instant('ts')} BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-07 23:59:59' AS inside"))

# -- severities -----------------------------------------------------------------------

LEVEL = "coalesce(" + ", ".join(m(f"(?i){p}") for p in P.DETECT_SEVERITIES) + ")"
SEVERITY = {
    "csv": classes([(c, [x for w in words for x in (w, w.upper())]) for c, words in P.CSV_SEVERITY_WORDS], "UNKNOWN", "line"),
    "api": classes(P.API_SEVERITY_WORDS, "UNKNOWN"),
    "display": classes(P.DISPLAY_SEVERITY_WORDS, "NONE"),
    "contextual": "CASE " + " ".join(
        f"WHEN regexp_matches(lower(line), '\\b(?:{w})\\b') THEN '{c}'" for c, w in P.CONTEXT_SEVERITY_WORDS) + " ELSE 'UNKNOWN' END",
    "detected": f"coalesce({LEVEL}, {classes(P.FALLBACK_SEVERITY_WORDS, 'UNKNOWN')})",
}
for profile, sql in SEVERITY.items():
    over_lines(f"severity_{profile}", f"SELECT line_no, {sql} AS severity FROM log_lines")
over_lines("severity_distribution", f"SELECT {SEVERITY['csv']} AS severity, count(*) AS count FROM log_lines GROUP BY 1")

# -- messages -------------------------------------------------------------------------

CSV_PARTS = f"""WITH parts AS (SELECT line_no, line, {TS['csv']} AS ts, {SEVERITY['csv']} AS severity FROM log_lines),
 cut AS (SELECT *, CASE WHEN instr(line, ts) > 0 THEN substr(line, instr(line, ts) + length(ts)) ELSE line END AS rest FROM parts),
 short AS (SELECT *, ltrim(regexp_replace(rest, '^.*?(?:\\s*[A-Za-z]+:\\s+|\\s+[A-Za-z]+\\s+)', ''), {WS}) AS body FROM cut),
 msgs AS (SELECT line_no, line, ts, severity, CASE WHEN ts IS NULL THEN line ELSE regexp_replace(body, '^[a-zA-Z0-9_-]+\\s+', '') END AS message FROM short) """
DETECTED_PARTS = f"""WITH parts AS (SELECT line_no, line, {TS['detected']} AS ts, {LEVEL} AS level, {SEVERITY['detected']} AS severity FROM log_lines),
 one AS (SELECT *, {remove_first('line', "coalesce(ts, '')")} AS rest FROM parts),
 msgs AS (SELECT line_no, line, ts, severity, trim({remove_first('rest', "coalesce(level, '')")}, {WS}) AS message FROM one),
 cuts AS (SELECT line_no, line, ts, severity, CASE WHEN contains(message, ':') THEN regexp_replace(message, '^.*:\\s*', '')
  WHEN contains(message, ' - ') THEN regexp_replace(message, '^.*- ', '') ELSE message END AS message FROM msgs) """
_LEADS = (f"(?i)^.*?\\b(?:{P.MESSAGE_LEVELS})[: ] *", "^.*?[a-zA-Z0-9._-]+:[0-9]+: *", "^.*?[a-zA-Z0-9._-]+\\[[0-9]+\\]: *")
CONTEXT_PARTS = f"""WITH parts AS (SELECT line_no, line, {TS['view']} AS shown_ts, {SEVERITY['contextual']} AS severity,
  coalesce({m(P.ISO_T_OR_SPACE + P.ISO_TAIL)}, {m(P.SYSLOG_PADDED)}, {m(P.US)}) AS ts FROM log_lines),
 one AS (SELECT *, {remove_first('line', 'ts')} AS rest FROM parts),
 msgs AS (SELECT line_no, line, coalesce(shown_ts, '') AS timestamp, severity, rtrim(ltrim(CASE WHEN ts IS NULL THEN line """ + " ".join(
    f"WHEN regexp_matches(rest, '{p}') THEN regexp_replace(rest, '{p}', '')" for p in _LEADS) + f" ELSE rest END, ' :'||chr(9)), {WS}) AS message FROM one) "
SHOWN = "CASE WHEN message <> '' AND NOT starts_with(message, '#') THEN message END AS message"
over_lines("msg_csv", CSV_PARTS + "SELECT line_no, message FROM msgs")
over_lines("msg_detected", DETECTED_PARTS + "SELECT line_no, message FROM msgs")
over_lines("msg_separator", DETECTED_PARTS + f"SELECT line_no, {SHOWN} FROM cuts")
over_lines("msg_contextual", CONTEXT_PARTS + "SELECT line_no, message FROM msgs")

ERROR_MESSAGE = "trim(line, {ws})"
for lead in (P.ISO_T_OR_SPACE + P.ISO_TAIL, "[A-Za-z]{3} +[0-9]+ +[0-9]{2}:[0-9]{2}:[0-9]{2} +(?:[0-9]{4})?",
             "[0-9]{2}/[0-9]{2}/[0-9]{4} +[0-9]{2}:[0-9]{2}:[0-9]{2}", ".*ERROR:?\\s*"):
    ERROR_MESSAGE = f"regexp_replace({ERROR_MESSAGE}, '^{lead}', '')"
ERROR_MESSAGE = f"nullif(trim({ERROR_MESSAGE}, {{ws}}), '')".replace("{ws}", WS)
over_lines("error_message_norm", f"SELECT line_no, {ERROR_MESSAGE} AS message FROM log_lines")
over_lines("sql_functions", CSV_PARTS + "SELECT line_no, ts, severity, message FROM msgs")
over_derived("sanitize_text", D.DIRTY_LINES, """SELECT line_no, CASE WHEN line LIKE '#%' THEN line
 ELSE replace(replace(line, chr(7), ''), '"', chr(92)||'"') END AS line FROM dirty_lines""")

# -- aggregates -----------------------------------------------------------------------

over_lines("summary_counts", f"SELECT {COUNTS} FROM log_lines")
over_lines("count_by_severity", "SELECT count(*) AS count FROM log_lines WHERE line ILIKE '%warn%'")
over_lines("rollup_by_file", f"SELECT file, {COUNTS} FROM log_lines GROUP BY ROLLUP (file)", D.FOUR_FILES)


def range_of(patterns, first: str = "{}", prefix: str = "") -> str:
    """First and last match in file order of the first pattern that the file has."""
    hits = " UNION ALL ".join(
        f"SELECT file, {i} AS form, line_no, unnest(regexp_extract_all(line, '{p}')) AS ts, generate_subscripts(regexp_extract_all(line, '{p}'), 1) AS nth FROM log_lines"
        for i, p in enumerate(patterns))
    return f"""hits AS ({hits}),
 best AS (SELECT file, min(form) AS form FROM hits GROUP BY file),
 ends AS (SELECT file, arg_min(ts, line_no * 1000 + nth) AS a, arg_max(ts, line_no * 1000 + nth) AS b FROM hits JOIN best USING (file, form) GROUP BY file)"""


RANGE = range_of(P.RANGE_TIMESTAMPS)
RANGE_COLUMNS = "replace(a, 'T', ' ') AS time_start, replace(b, 'T', ' ') AS time_end"
over_lines("time_range", f"WITH {RANGE} SELECT file, {RANGE_COLUMNS} FROM (SELECT DISTINCT file FROM log_lines) LEFT JOIN ends USING (file)")
STATISTICS = f"counted AS (SELECT file, {COUNTS} FROM log_lines GROUP BY file)"
over_lines("file_statistics", f"WITH {RANGE}, {STATISTICS} SELECT file, total_lines, error_count, warning_count, info_count, {RANGE_COLUMNS} FROM counted LEFT JOIN ends USING (file)")
over_lines("time_range_iso", f"WITH {range_of([P.ISO_T_OR_SPACE])} SELECT file, coalesce(a, 'Unknown') AS time_start, coalesce(b, 'Unknown') AS time_end FROM (SELECT DISTINCT file FROM log_lines) LEFT JOIN ends USING (file)")


def normal(ts: str) -> str:
    return f"CASE WHEN {ts} LIKE '____-__-__ %' THEN {ts} ELSE {shown(ts)} END"


DATES = range_of(P.DETECT_TIMESTAMPS)
DATE_COLUMNS = f"{normal('a')} AS time_start, {normal('b')} AS time_end"
over_lines("date_range_norm", f"WITH {DATES} SELECT file, {DATE_COLUMNS} FROM (SELECT DISTINCT file FROM log_lines) LEFT JOIN ends USING (file)")

COUNTED = f"counted_errors AS (SELECT line AS message, count(*) AS occurrences FROM log_lines WHERE {ERROR} GROUP BY line)"
DISPLAY = "trim(regexp_replace(message, '[ \\t]+', ' ', 'g')) AS display"
for n in (5, 10):
    over_lines(f"top_errors_{n}", f"WITH {COUNTED} SELECT occurrences, message, {DISPLAY} FROM counted_errors ORDER BY occurrences DESC, message DESC LIMIT {n}")
RANKED_ERRORS = f"""ranked AS (SELECT file, line AS message, count(*) AS occurrences,
 row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, line DESC) AS r FROM log_lines WHERE {ERROR} GROUP BY file, line)"""
over_lines("top_errors_by_file", f"WITH {RANKED_ERRORS} SELECT file, occurrences, message, {DISPLAY} FROM ranked WHERE r <= 3", D.FOUR_FILES)
over_lines("summary", f"""WITH {RANGE}, {STATISTICS}, {RANKED_ERRORS}
 SELECT c.file, total_lines, error_count, warning_count, info_count, {RANGE_COLUMNS}, r - 1 AS rank, occurrences, message
 FROM counted c LEFT JOIN ends USING (file) LEFT JOIN ranked USING (file) WHERE r <= 5 OR r IS NULL""", D.QUIET_FILE)

UNIQUE = f"""uniques AS (SELECT {ERROR_MESSAGE} AS message, count(*) AS occurrences FROM log_lines
 WHERE {ERROR} AND NOT regexp_matches(line, '^\\s*#') GROUP BY 1 HAVING message IS NOT NULL)"""
over_lines("unique_errors", f"WITH {UNIQUE} SELECT occurrences, message FROM uniques")
over_lines("unique_errors_threshold", f"WITH {UNIQUE} SELECT occurrences, message FROM uniques WHERE occurrences >= 100")
over_lines("error_chart", f"""WITH {UNIQUE} SELECT occurrences, left(message, 50) AS message,
 repeat('#', occurrences * 50 // (SELECT max(occurrences) FROM uniques)) AS bar FROM uniques""")

BUCKETS = {"minute": "%Y-%m-%d %H:%M", "hour": "%Y-%m-%d %H", "day": "%Y-%m-%d", "month": "%Y-%m"}


def histogram(fmt: str, where: str = "true") -> str:
    hits = range_of(P.DETECT_TIMESTAMPS).replace("FROM log_lines", f"FROM log_lines WHERE {where}")
    return f"""{hits}, hist AS (SELECT file, {shown('ts', fmt)} AS bucket, count(*) AS count
 FROM hits JOIN best USING (file, form) GROUP BY 1, 2)"""


for grain, fmt in BUCKETS.items():
    over_lines(f"hist_{grain}", f"WITH {histogram(fmt)} SELECT file, bucket, count FROM hist")
over_lines("hist_day_by_file", f"WITH {histogram('%Y-%m-%d')} SELECT file, bucket, count FROM hist", D.FOUR_FILES)
over_lines("hist_peak", f"WITH {histogram('%Y-%m-%d %H')} SELECT file, bucket AS peak_bucket, count AS peak_count FROM hist ORDER BY count DESC, bucket LIMIT 1")
over_lines("hist_chart", f"WITH {histogram('%Y-%m-%d')} SELECT file, bucket, count, repeat('#', count * 50 // (SELECT max(count) FROM hist)) AS bar FROM hist")
over_lines("hour_error_anomalies", f"WITH {histogram('%Y-%m-%d %H', ERROR)} SELECT file, bucket, count FROM hist WHERE count >= 3")



def baseline(grain: str, window: int, factor: float, where: str = "true") -> str:
    """Counts of errors per bucket without gaps, against the median and median deviation of those before."""
    hits = range_of(P.DETECT_TIMESTAMPS).replace("SELECT file, 0 AS form, line_no,", f"SELECT file, 0 AS form, {ERROR} AS wrong, line_no,")
    for i in range(1, len(P.DETECT_TIMESTAMPS)):
        hits = hits.replace(f"SELECT file, {i} AS form, line_no,", f"SELECT file, {i} AS form, {ERROR} AS wrong, line_no,")
    hits = hits.replace("FROM log_lines", f"FROM log_lines WHERE {where}")
    fmt = BUCKETS[grain]
    return f"""WITH {hits}, counted AS (SELECT date_trunc('{grain}', {instant('ts')}) AS t, count(*) FILTER (WHERE wrong) AS n
   FROM hits JOIN best USING (file, form) GROUP BY 1),
 series AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 {grain})) AS t FROM counted),
 filled AS (SELECT t, coalesce(n, 0) AS n FROM series LEFT JOIN counted USING (t)),
 framed AS (SELECT t, n, list(n) OVER (ORDER BY t ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS l FROM filled),
 middle AS (SELECT *, list_median(l) AS med FROM framed),
 spread AS (SELECT *, CASE WHEN med IS NOT NULL THEN greatest(1.0, 1.4826 * list_median(list_transform(l, lambda x: abs(x - med)))) END AS dev FROM middle)
 SELECT 'app.log' AS file, strftime(t, '{fmt}') AS bucket, n AS count, med::DOUBLE AS median, dev::DOUBLE AS deviation, n - med > {factor} * dev AS anomaly FROM spread"""


over_lines("error_baseline", baseline("hour", 12, 2.5))
over_lines("error_baseline_daily", baseline("day", 5, 2.0, "(line_no % 5 = 1 OR line_no < 40)"))

# -- filters --------------------------------------------------------------------------

LINES = "SELECT line_no, line FROM log_lines WHERE "
over_lines("filter_errors", LINES + "line ILIKE '%error%'")
over_lines("filter_errors_broad", LINES + "regexp_matches(line, '(?i)error|critical|fatal|exception|fail')")
over_lines("filter_severity_regex", LINES + "line ILIKE '%warn%' OR line ILIKE '%debug%'")
over_lines("filter_text", LINES + "contains(lower(line), 'user login: user1')")
over_lines("filter_regex", LINES + "regexp_matches(line, '(?i)backend-[0-3]: time')")
over_lines("filter_regex_bare", LINES + "contains(lower(line), 'warn|debug')")
over_lines("filter_regex_repeat", LINES + "regexp_matches(line, '(?i)^20[0-9]+-.*backend-?[35]:')")
over_lines("filter_regex_java", LINES + "regexp_matches(line, '(?i)warn|backend-[12]+:')")
over_lines("filter_time_lexical", LINES + f"{TS['lexical']} IS NULL OR ({TS['lexical']} >= '2024-01-05' AND {TS['lexical']} <= '2024-01-07')")
TIMED = "WITH times AS (SELECT line_no, line, {} AS ts FROM log_lines) SELECT line_no, line FROM times WHERE "
DAYS = "BETWEEN timestamp '2024-01-05 00:00:00' AND timestamp '2024-01-07 23:59:59'"
over_lines("filter_time_epoch", TIMED.format(TS["rich"]) + f"ts IS NULL OR {instant('ts')} {DAYS}")
over_lines("filter_time_range", TIMED.format(TS["range"]) + f"line NOT LIKE '#%' AND (ts IS NULL OR {instant('ts')} {DAYS})")
over_lines("filter_from", TIMED.format(TS["rich"]) + f"ts IS NULL OR {instant('ts')} >= timestamp '2024-01-20 06:00:00'")
over_lines("filter_stacked", TIMED.format(TS["rich"]) + f"(ts IS NULL OR {instant('ts')} {DAYS}) AND line ILIKE '%backend-1%' AND line ILIKE '%error%'")
CONTENT = "NOT regexp_matches(line, '^\\s*#') AND trim(line) <> ''"
over_lines("skip_comments", LINES + CONTENT)
over_lines("filter_counts", f"""WITH times AS (SELECT line, {TS['rich']} AS ts FROM log_lines)
 SELECT count(*) FILTER (WHERE {ERROR} AND (ts IS NULL OR {instant('ts')} {DAYS})) AS kept, count(*) AS total FROM times""")
over_lines("search_next", "SELECT min(line_no) AS line_no FROM log_lines WHERE line_no >= 4000 AND line ILIKE '%backend-3%'")
over_lines("search_prev", "SELECT max(line_no) AS line_no FROM log_lines WHERE line_no <= 4000 AND line ILIKE '%backend-3%'")

# -- positions ------------------------------------------------------------------------

RANKED = f"""WITH ranked AS (SELECT file, line_no, line, row_number() OVER (ORDER BY file, line_no) AS position,
 count(*) OVER () AS n FROM log_lines WHERE {ERROR}) """
over_lines("limit_20", f"{LINES}{ERROR} ORDER BY line_no LIMIT 20")
over_lines("sample_systematic", RANKED + """SELECT position, line_no, line FROM ranked
 WHERE position % greatest(1, n // CASE WHEN n > 1000 THEN 50 WHEN n > 100 THEN 30 ELSE 20 END) = 0""")
over_lines("page_3", RANKED + "SELECT position, line_no, line FROM ranked WHERE position BETWEEN 81 AND 120")
over_lines("page_count", "SELECT count(*) AS entries, cast(greatest(1, ceil(count(*) / 40.0)) AS bigint) AS pages FROM log_lines")
over_lines("page_summary", f"SELECT {SEVERITY['display']} AS severity, count(*) AS count FROM log_lines WHERE line_no BETWEEN 81 AND 120 GROUP BY 1")
over_lines("positions_by_file", RANKED + "SELECT position, file, line_no FROM ranked", D.FOUR_FILES)

# -- formats --------------------------------------------------------------------------

for name, (_, fields) in D.FORMAT_LINES.items():
    over_formats(f"parse_{name}", "SELECT line_no, " + ", ".join(
        f"CASE WHEN good THEN {value} END AS \"{f}\"" for f, value in fields.items()) + " FROM ev")
ORACLES["sql_formats"] = ORACLES["parse_apache_combined"]
over_lines("parse_custom", DETECTED_PARTS.replace(TS["detected"], m(P.DETECT_TIMESTAMPS[0])).replace(LEVEL, m(f"(?i){P.DETECT_SEVERITIES[0]}"))
           + "SELECT m.line_no, coalesce(m.ts, '') AS timestamp, coalesce(p.level, '') AS severity, m.message FROM msgs m JOIN parts p USING (line_no)")
over_derived("json_fields", D.JSON_LINES, """SELECT line_no,
 CASE WHEN event_id % 20 = 3 THEN '' ELSE d||'T'||t||'Z' END AS timestamp, CASE WHEN event_id % 20 = 3 THEN '' ELSE lvl END AS severity,
 CASE WHEN event_id % 20 IN (3, 5) THEN '' ELSE e||' by user'||u END AS message FROM ev""")
SHAPES = {0: ("$.a integer", "$.b.c string", "$.b.d[] integer", "$.b.d[] number", "$.b.d[] string"), 1: ("$.a string", "$.b null"),
          2: ("$.a boolean", "$.list array", "$.o object", "$.f number"), 3: ("$ malformed",), 4: ("$ malformed",), 5: ("$[] integer", "$[].k string")}
over_derived("json_schema", D.JSON_SHAPES, "SELECT 'shapes.log' AS file, path, type, count(*) AS count FROM json_shapes JOIN (VALUES " + ", ".join(
    f"({shape}, '{x.split()[0]}', '{x.split()[1]}')" for shape, held in SHAPES.items() for x in held) + ") v(shape, path, type) USING (shape) GROUP BY ALL")
over_derived("json_columns", D.JSON_SHAPES, """SELECT line_no, CASE event_id % 7 WHEN 0 THEN u WHEN 1 THEN e WHEN 2 THEN 'true' END AS a,
 CASE WHEN event_id % 7 = 0 THEN lvl END AS c, CASE WHEN event_id % 7 = 2 THEN cast(u||'.5' AS double) END AS f FROM ev""")
over_formats("syslog_priority", "SELECT line_no, CASE WHEN good THEN cast(k AS bigint) // 8 END AS facility, CASE WHEN good THEN cast(k AS bigint) % 8 END AS level FROM ev")
over_formats("cloudtrail_records", """SELECT line_no, e AS "eventName", 'r'||k AS "awsRegion", NULL AS "errorCode" FROM ev WHERE good
 UNION ALL SELECT line_no, 'Again', NULL, lvl FROM ev WHERE good""")
over_formats("w3c_rows", "SELECT line_no, d AS day, t AS clock, lvl AS method, k AS status FROM ev WHERE event_id % 500 <> 0")
over_lines("detect_patterns", "SELECT 'app.log' AS file, 'custom' AS format, "
           f"'{P.DETECT_TIMESTAMPS[0]}' AS timestamp_pattern, '{P.DETECT_SEVERITIES[0]}' AS severity_pattern FROM log_lines LIMIT 1")
DETECTED_AS = {"nginx_access": "apache_combined"}
ORACLES["detect_format"] = f"WITH {D.EVENTS.format(**D.DUCKDB)} " + " UNION ALL ".join(
    f"SELECT '{n}.log' AS file, '{DETECTED_AS.get(n, n)}' AS format, count(*) AS lines, count(*) FILTER (WHERE good) AS matched FROM ev WHERE line_no <= 20"
    for n in D.FORMAT_LINES)
over_derived("stacktrace_records", D.TRACE_LINES, """SELECT cast(event_id*4+1 AS bigint) AS head_no, cast(user_id % 3 + 2 AS bigint) AS n_lines, 'java.io.IOException' AS exception, 'user'||cast(user_id AS varchar)||' lost' AS message,
 array_to_string([chr(9)||'at com.example.Call.step'||cast(j AS varchar)||'(Call.java:'||cast(user_id AS varchar)||')' FOR j IN range(1, user_id % 3 + 2)], chr(10)) AS stacktrace
 FROM events WHERE event_type = 'error'""")

# -- rows, reports, sinks -------------------------------------------------------------

CSV_ROWS = CSV_PARTS + f"SELECT line_no, coalesce(ts, '') AS timestamp, severity, message FROM msgs WHERE {CONTENT}"
over_lines("csv_rows", CSV_ROWS)
over_lines("csv_roundtrip", CSV_ROWS.replace("SELECT line_no, coalesce", "SELECT NULL AS csv_parse_error, coalesce"))
over_lines("stream_csv_rows", CSV_ROWS.replace("SELECT line_no, coalesce", "SELECT coalesce"))
ENDED = "(SELECT max({at}) - INTERVAL 90 MINUTES FROM hits)".format(at=instant("ts"))
over_lines("stream_hist_hour", f"WITH {histogram('%Y-%m-%d %H')} SELECT file, bucket, count FROM hist WHERE strptime(bucket, '%Y-%m-%d %H') + INTERVAL 1 HOUR <= {ENDED}")
ORACLES["stream_stacktraces"] = ORACLES["stacktrace_records"]
over_lines("csv_rows_separator", DETECTED_PARTS + f"SELECT line_no, coalesce(ts, '') AS timestamp, severity, message FROM cuts WHERE {CONTENT} AND message <> '' AND message NOT LIKE '#%'")
over_lines("csv_rows_view", CONTEXT_PARTS + f"SELECT line_no, timestamp, severity, message FROM msgs WHERE {CONTENT} AND message <> '' AND message NOT LIKE '#%'")
over_lines("log_entries", f"SELECT line_no, line AS raw, {SEVERITY['api']} AS severity, {TS['api']} AS timestamp, NULL AS message FROM log_lines WHERE trim(line) <> ''")


def json_counts(name: str) -> str:
    return f"""'"{name}":{{"total_lines":'||total_lines||',"error_count":'||error_count||',"warning_count":'||warning_count||',"info_count":'||info_count||'}}'"""


over_lines("summary_json", f"""WITH {RANGE}, {STATISTICS} SELECT file, '{{"file":"'||file||'",'||{json_counts('stats')}||
 ',"time_range":{{"first":"'||replace(a, 'T', ' ')||'","last":"'||replace(b, 'T', ' ')||'"}}}}' AS json FROM counted JOIN ends USING (file)""")
over_lines("report_json", f"""WITH {DATES}, {STATISTICS}, {RANKED_ERRORS},
 listed AS (SELECT file, string_agg('{{"count":'||occurrences||',"message":"'||message||'"}}', ',' ORDER BY r) AS list FROM ranked WHERE r <= 10 GROUP BY file)
 SELECT file, '{{"file":"'||file||'",'||{json_counts('statistics')}||',"time_range":{{"first":"'||{normal('a')}||'","last":"'||{normal('b')}||
 '"}},"top_errors":['||list||']}}' AS json FROM counted JOIN ends USING (file) JOIN listed USING (file)""")
over_lines("report_long", f"""WITH {DATES}, {STATISTICS}, {RANKED_ERRORS}
 SELECT file, 'statistics' AS report_type, k AS key, cast(v AS varchar) AS value FROM counted,
  LATERAL (VALUES ('total_lines', total_lines), ('error_count', error_count), ('warning_count', warning_count), ('info_count', info_count)) x(k, v)
 UNION ALL SELECT file, 'time_range', 'first', {normal('a')} FROM ends UNION ALL SELECT file, 'time_range', 'last', {normal('b')} FROM ends
 UNION ALL SELECT file, 'top_errors', cast(occurrences AS varchar), replace(message, '"', '""') FROM ranked WHERE r <= 10""")
ORACLES["split_text_lines"] = """WITH pieces AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
 numbered AS (SELECT doc_id, len(p) AS n, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM pieces)
 SELECT doc_id, cast(line_no AS bigint) AS line_no, line FROM numbered WHERE NOT (line_no = n AND line = '' AND n > 1)"""
over_lines("export_metadata", f"""SELECT 'app.log' AS source, 'filtered' AS export_type, count(*) AS total_entries,
 count(*) FILTER (WHERE {ERROR} AND line ILIKE '%backend-1%') AS filtered_entries, 'Errors only; Text: "backend-1"' AS filters FROM log_lines""")


# -- registry, sources and reports by name ----------------------------------------------

over_formats("registered_format", """SELECT line_no, 'app' AS format, CASE WHEN good THEN d END AS day, CASE WHEN good THEN t END AS clock,
 CASE WHEN good THEN lvl END AS level, CASE WHEN good THEN e||' by user'||u END AS rest FROM ev""")
over_formats("parse_simple_log", f"SELECT line_no, CASE WHEN good THEN {D.FORMAT_LINES['simple'][0]} ELSE {D.OTHER_LINE} END AS entry FROM ev")
over_formats("csv_fields", """SELECT line_no, CASE WHEN event_id % 10 = 1 THEN '# ""kept"" as is'
 ELSE lvl||chr(7)||' said ""'||e||'""'||chr(9)||u END AS value FROM ev""")
over_formats("csv_malformed", """SELECT d AS timestamp, lvl AS severity, CASE WHEN event_id % 10 = 4 THEN e ELSE 'said "'||e||'", twice' END AS message,
 CASE WHEN event_id % 10 = 4 THEN '"'||d||'","'||lvl||'","'||e||'","more"' END AS csv_parse_error FROM ev""")
ORACLES["report_text_summary"] = ORACLES["file_statistics"]
over_lines("report_text_errors", f"""WITH {UNIQUE} SELECT occurrences, left(message, 50) AS message,
 repeat('#', occurrences * 50 // (SELECT max(occurrences) FROM uniques)) AS bar FROM uniques WHERE occurrences >= 5""")
ORACLES["report_text_times"] = ORACLES["hist_hour"]
STEP = "chr(9)||'at com.example.Call.step'||cast(j AS varchar)||'(Call.java:'||cast(user_id AS varchar)||')'"
ORACLES["stacktrace_lines"] = f"""SELECT cast(event_id*4+1 AS bigint) AS head_no, cast(event_id*4+1+j AS bigint) AS line_no,
 CASE WHEN j = 0 THEN 'java.io.IOException: user'||cast(user_id AS varchar)||' lost' ELSE {STEP} END AS line
 FROM events {D.DUCKDB['four']} WHERE event_type = 'error' AND j <= user_id % 3 + 1"""

# -- very long lines ----------------------------------------------------------------------

LONG_MESSAGE = """CASE kind WHEN 0 THEN repeat('a.', n) WHEN 1 THEN repeat('x', n) WHEN 2 THEN 'end' WHEN 3 THEN {} ELSE line END"""
for name, tail in (("csv", "'x'"), ("view", "'tail x'")):
    over_derived(f"long_lines_{name}", D.LONG_LINES, f"""WITH m AS (SELECT line_no, CASE WHEN kind = 4 THEN '' ELSE ts END AS timestamp,
     {LONG_MESSAGE.format(tail)} AS message FROM long_lines) SELECT line_no, timestamp, length(message) AS length, md5(message) AS md5 FROM m""")
over_derived("long_lines_traces", D.LONG_LINES, """SELECT line_no AS head_no, cast(1 AS bigint) AS n_lines, 'boom' AS message,
 cast(2 * n + 13 AS bigint) AS length, md5(repeat('a.', n)||'LostException') AS md5 FROM long_lines WHERE kind = 4""")
ORACLES["long_lines_detect"] = "SELECT 'long.log' AS file, 'java_stacktrace' AS format, 20 AS lines, 4 AS matched FROM events LIMIT 1"

# -- text files ---------------------------------------------------------------------------

IN_PARTS = "cast((event_id + 1) % 4 AS {text})"
PLACED = """placed AS (SELECT cast(file AS bigint) AS part, row_number() OVER (PARTITION BY file ORDER BY line_no) AS n, line_no AS old_no, line FROM log_lines)"""
WRONG = f"""{PLACED}, wrong AS (SELECT part, line, row_number() OVER (ORDER BY part, n) AS position, count(*) OVER () AS total FROM placed WHERE {ERROR})"""


def over_files(name: str, sql: str) -> None:
    over_lines(name, sql, IN_PARTS)


over_files("file_lines_numbered", f"WITH {PLACED} SELECT part, n AS line_no, line FROM placed")
over_files("file_search", f"WITH {PLACED} SELECT part, min(n) FILTER (WHERE line ILIKE '%backend-3%' AND n >= 100) AS line_no FROM placed GROUP BY part")
over_files("file_page", f"WITH {WRONG} SELECT part, position, line FROM wrong WHERE position BETWEEN 81 AND 120")
over_files("file_last_page", f"WITH {WRONG} SELECT part, position, line FROM wrong WHERE (position - 1) // 40 = (total - 1) // 40")
over_files("file_sample", f"""WITH {WRONG} SELECT part, position, line FROM wrong
 WHERE position % greatest(1, total // CASE WHEN total > 1000 THEN 50 WHEN total > 100 THEN 30 ELSE 20 END) = 0""")
over_files("file_limit", f"WITH {WRONG} SELECT part, line FROM wrong WHERE position <= 25")
over_files("file_statistics_of_files", f"""WITH {RANGE}, {STATISTICS} SELECT cast(file AS bigint) AS part, total_lines, error_count, warning_count, info_count,
 {RANGE_COLUMNS} FROM counted LEFT JOIN ends USING (file)""")
over_files("file_date_range", f"WITH {DATES} SELECT cast(file AS bigint) AS part, {DATE_COLUMNS} FROM (SELECT DISTINCT file FROM log_lines) LEFT JOIN ends USING (file)")
over_files("file_time_range_iso", f"""WITH {range_of([P.ISO_T_OR_SPACE])} SELECT cast(file AS bigint) AS part, coalesce(a, 'Unknown') AS time_start,
 coalesce(b, 'Unknown') AS time_end FROM (SELECT DISTINCT file FROM log_lines) LEFT JOIN ends USING (file)""")
over_files("file_report_long", f"""WITH {DATES}, {STATISTICS} SELECT cast(file AS bigint) AS part, 'statistics' AS report_type, k AS key, cast(v AS varchar) AS value FROM counted,
  LATERAL (VALUES ('total_lines', total_lines), ('error_count', error_count), ('warning_count', warning_count), ('info_count', info_count)) x(k, v)
 UNION ALL SELECT cast(file AS bigint), 'time_range', 'first', {normal('a')} FROM ends UNION ALL SELECT cast(file AS bigint), 'time_range', 'last', {normal('b')} FROM ends""")
over_files("file_report_whole", f"""WITH {DATES}, {STATISTICS}, {RANKED_ERRORS}
 SELECT cast(file AS bigint) AS part, 'statistics' AS report_type, k AS key, cast(v AS varchar) AS value FROM counted,
  LATERAL (VALUES ('total_lines', total_lines), ('error_count', error_count), ('warning_count', warning_count), ('info_count', info_count)) x(k, v)
 UNION ALL SELECT cast(file AS bigint), 'time_range', 'first', {normal('a')} FROM ends UNION ALL SELECT cast(file AS bigint), 'time_range', 'last', {normal('b')} FROM ends
 UNION ALL SELECT cast(file AS bigint), 'top_errors', cast(occurrences AS varchar), message FROM ranked WHERE r <= 10""")
over_files("file_detect_patterns", f"""SELECT cast(file AS bigint) AS part, 'custom' AS format, '{P.DETECT_TIMESTAMPS[0]}' AS timestamp_pattern,
 '{P.DETECT_SEVERITIES[0]}' AS severity_pattern FROM log_lines GROUP BY file""")
over_files("file_parse_custom", DETECTED_PARTS.replace(TS["detected"], m(P.DETECT_TIMESTAMPS[0])).replace(LEVEL, m(f"(?i){P.DETECT_SEVERITIES[0]}")).rstrip()
           + f", {PLACED} SELECT part, n AS line_no, coalesce(m.ts, '') AS timestamp, coalesce(p.level, '') AS severity, m.message"
           " FROM msgs m JOIN parts p USING (line_no) JOIN placed ON old_no = m.line_no")
ORACLES["file_index_page"], ORACLES["file_index_sample"] = ORACLES["file_page"], ORACLES["file_sample"]
over_files("file_index_window", f"WITH times AS (SELECT file, line, {TS['rich']} AS ts FROM log_lines) SELECT cast(file AS bigint) AS part, line FROM times WHERE ts IS NULL OR {instant('ts')} {DAYS}")
over_files("file_index_times", f"""WITH times AS (SELECT file, {TS['rich']} AS ts FROM log_lines), seconds AS (SELECT file, cast(floor(epoch({instant('ts')})) AS bigint) AS second FROM times)
 SELECT cast(file AS bigint) AS part, count(*) AS lines, count(*) FILTER (WHERE second IS NULL) AS untimed, min(second) AS first, max(second) AS last FROM seconds GROUP BY file""")
ORACLES["file_index_statistics"] = ORACLES["file_statistics_of_files"]
over_lines("file_index_errors", f"WITH {UNIQUE} SELECT occurrences, message FROM uniques WHERE occurrences >= 2")
ORACLES["file_detect_heads"] = ORACLES["file_detect_patterns"]
over_files("file_heads", f"WITH {PLACED} SELECT part, n AS line_no, line FROM placed WHERE n <= 7")
ORACLES["file_parse_heads"] = ORACLES["file_parse_custom"].replace("SELECT part, n AS line_no, ", "SELECT part, ")
over_files("file_top_errors", f"WITH {RANKED_ERRORS} SELECT cast(file AS bigint) AS part, occurrences, message FROM ranked WHERE r <= 4")
ORACLES["file_detect_format"] = f"WITH {D.EVENTS.format(**D.DUCKDB)} " + " UNION ALL ".join(
    f"SELECT {i} AS part, '{DETECTED_AS.get(n, n)}' AS format, count(*) AS lines, count(*) FILTER (WHERE good) AS matched FROM ev WHERE line_no <= 20"
    for i, n in enumerate(D.FORMAT_LINES, start=1))
ORACLES["file_stacktraces"] = ORACLES["stacktrace_records"].replace(
    "SELECT cast(event_id*4+1 AS bigint) AS head_no,", "SELECT event_id % 4 AS part, cast(event_id // 4 * 4 + 1 AS bigint) AS head_no,")
over_formats("file_w3c_rows", """SELECT line_no % 4 AS part, d AS day, t AS clock, lvl AS method, k AS status FROM ev
 WHERE event_id % 1000 >= 4 AND event_id % 1000 NOT BETWEEN 500 AND 503""")
over_formats("file_w3c_many_headers", """SELECT line_no % 4 AS part, d AS day, t AS clock, lvl AS method, k AS status FROM ev
 WHERE event_id >= 12 AND event_id % 40 NOT BETWEEN 8 AND 11 AND event_id % 40 NOT BETWEEN 28 AND 31""")
over_lines("file_export_view", CONTEXT_PARTS + f"""SELECT timestamp, severity, message, (SELECT count(*) FROM log_lines) AS total_entries,
 (SELECT count(*) FROM log_lines WHERE {ERROR} AND line ILIKE '%backend-1%') AS filtered_entries, 'Errors only; Text: "backend-1"' AS filters
 FROM msgs WHERE {CONTENT} AND {ERROR} AND line ILIKE '%backend-1%' AND message <> '' AND message NOT LIKE '#%'""")

# -- rarer forms: from the kinds of lines alone -------------------------------------------

CLOCKED, AT_SECOND = "d||' '||t", "strftime(timestamp '2024-01-01' + to_seconds(event_id), '%Y-%m-%d %H:%M:%S')"
KINDS = {
    "csv": {5: "md||' 2024'", 6: CLOCKED, 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
    "lexical": {6: CLOCKED, 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
    "rich": {0: AT_SECOND, 1: AT_SECOND, 5: "md||' 2024'", 6: CLOCKED, 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
    "range": {2: CLOCKED, 3: "d||' 12:00:00'", 4: "us||' 12:00:00'", 5: "md||' 2024'", 6: CLOCKED, 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
    "detected": {5: "'Mon '||md||' 2024'", 6: "d||'T'||t||'.123+02:00'", 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
    "view": {5: "md", 6: CLOCKED, 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
    "api": {6: "d||'T'||t", 7: CLOCKED, 9: CLOCKED, 10: CLOCKED},
}


def by_kind(values: dict[int, str], other: str = "NULL") -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def over_varied(name: str, sql: str) -> None:
    over_derived(f"varied_{name}", D.VARIED_LINES, sql)


for profile, kinds in KINDS.items():
    over_varied(f"ts_{profile}", f"SELECT line_no, {by_kind(kinds)} AS ts FROM varied")
ON_CLOCK = "cast(epoch(cast(d||' '||t AS timestamp)) AS bigint)"
over_varied("epoch", f"SELECT line_no, {by_kind({0: '1704067200 + event_id', 1: '1704067200 + event_id', **dict.fromkeys((5, 6, 7, 9, 10), ON_CLOCK)})} AS epoch FROM varied")
over_varied("errors", "SELECT line_no FROM varied WHERE kind IN (5, 9, 10)")
over_varied("errors_broad", "SELECT line_no FROM varied WHERE kind IN (5, 6, 8, 9, 10)")
over_varied("unique_errors", """SELECT message, count(*) AS occurrences FROM (SELECT CASE kind WHEN 5 THEN '"quoted" failure' WHEN 10 THEN 'said "no"'
 ELSE CASE WHEN event_id < 40 THEN 'rare' ELSE 'common' END||' thing' END AS message FROM varied WHERE kind IN (5, 9, 10)) GROUP BY 1 HAVING count(*) >= 4""")
LEVELS = {**dict.fromkeys((0, 2, 3, 4, 7), "'INFO'"), 1: "'WARNING'", **dict.fromkeys((5, 6, 9, 10), "'ERROR'")}
over_varied("severity_csv", f"SELECT line_no, {by_kind({**LEVELS, 8: chr(39) + 'ERROR' + chr(39)}, chr(39) + 'UNKNOWN' + chr(39))} AS severity FROM varied")
over_varied("severity_api", f"SELECT line_no, {by_kind(LEVELS, chr(39) + 'UNKNOWN' + chr(39))} AS severity FROM varied")
DAY = "d BETWEEN '2024-01-05' AND '2024-01-07'"
over_varied("window", f"""SELECT line_no FROM varied WHERE {by_kind({0: 'event_id >= 4 * 86400', 1: 'event_id >= 4 * 86400', **dict.fromkeys((5, 6, 7, 9, 10), DAY)}, 'true')}""")
over_varied("range_window", f"SELECT line_no FROM varied WHERE {by_kind(dict.fromkeys((2, 3, 4, 5, 6, 7, 9, 10), DAY), 'true')}")
