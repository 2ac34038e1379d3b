"""Named log formats: registry, detection, parsing; JSON, audit and W3C lines."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.messages import with_detected_message
from logscope.functions.severity import level_text
from logscope.functions.staged import computed
from logscope.functions.text import first_match
from logscope.operators.joins import join_per_file
from logscope.operators.ranking import BLOCK, position, with_block
from logscope.sources.files import bounded, split_bound, split_shifts

SAMPLE_LINES = 20
MARK = "\u0001"


@dataclass(frozen=True)
class LogFormat:
    """``regex`` has one capture group per field. Low priorities win ties; None takes
    the format out of detection, it can only be named. A format with a ``header`` is
    detected only where a line matches that too."""

    name: str
    fields: tuple[str, ...]
    regex: str
    priority: int | None
    header: str | None = None


def _format(name: str, fields: str, regex: str, priority: int | None, header: str | None = None) -> LogFormat:
    return LogFormat(name, tuple(fields.split()), regex, priority, header)


# Names, fields and regular expressions of the supported formats.
BUILT_IN = (
    _format("aws_cloudtrail", "json_data", r'^(\{"Records":\[.*\]\})$', 1),
    _format("json", "json_data", r"^(\{.*\})$", 2),
    _format("syslog",
            "priority version timestamp hostname app_name proc_id msg_id structured_data message",
            r"^<([0-9]{1,3})>([0-9]) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) (\[.*?\]|-)? ?(.*)$", 3),
    _format("apache_combined", "host ident authuser timestamp request status bytes referer user_agent",
            r'^([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]+)\] "([^"]*)" ([0-9]+) ([0-9]+|-) "([^"]*)" "([^"]*)"$', 4),
    _format("apache_common", "host ident authuser timestamp request status bytes",
            r'^([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]+)\] "([^"]*)" ([0-9]+) ([0-9]+|-)$', 5),
    _format("spring_boot", "timestamp thread severity logger message",
            r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+) +(\[[^\]]+\]) +([A-Z]+) +([^ ]+) +- +(.*)$", 6),
    _format("mysql_error", "timestamp thread_id severity subsystem message",
            r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+Z) +([0-9]+) +\[([^\]]+)\] +\[([^\]]+)\] +(.*)$", 7),
    _format("postgresql", "timestamp pid user database severity message",
            r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)? [A-Z]+) \[([0-9-]+)\] (?:user=([^,]+),)?(?:db=([^,]+),)?(?: )?((?:DEBUG|INFO|NOTICE|WARNING|ERROR|LOG|FATAL|PANIC)[^:]*): (.*)$", 8),
    _format("django", "timestamp severity module message",
            r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]+) +([A-Z]+) ++([^:]++): +(.*)$", 9),
    _format("kubernetes", "timestamp severity component message",
            r"^([A-Z][a-z]{2} [A-Z][a-z]{2} [ 0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+Z) +([A-Z]+) ++([^:]++): +(.*)$", 10),
    _format("winston", "timestamp severity message",
            r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+Z) +([A-Z]+) +(.*)$", 11),
    _format("java_stacktrace", "exception message",
            r"^((?:[\w$]++\.)++[\w$]+(?:Exception|Error|Throwable)): (.*)$", 12),
    _format("w3c_iis", "fields data", r"^(?:#Fields: (.*)|([0-9-]+ [0-9:]+ .*))$", 13, "^#Fields: "),
    _format("simple", "timestamp severity message",
            r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?) +([A-Z]+) +(.*)$", 14),
    _format("nginx_access",
            "remote_addr remote_user timestamp request status body_bytes_sent http_referer http_user_agent",
            r'^([^ ]+) - ([^ ]+) \[([^\]]+)\] "([^"]*)" ([0-9]+) ([0-9]+) "([^"]*)" "([^"]*)"', None),
)
ALIASES = {"json_log": "json"}
# Lines of this format are in the right form already: parsing hands them on as ``entry``.
PASS_THROUGH = "simple_log"


class FormatRegistry:
    """Built-in formats and those registered by the user; a later definition replaces an earlier one."""

    def __init__(self, formats=BUILT_IN):
        self._formats = {f.name: f for f in formats}

    def register(self, name: str, fields: str | list[str], regex: str, priority: int | None = 0,
                 header: str | None = None) -> LogFormat:
        names = tuple(fields.split() if isinstance(fields, str) else fields)
        self._formats[name] = LogFormat(name, names, regex, priority, header)
        return self._formats[name]

    def __getitem__(self, name: str) -> LogFormat:
        return self._formats[ALIASES.get(name, name)]

    def __iter__(self):
        return iter(self._formats.values())

    def detectable(self) -> list[LogFormat]:
        return sorted((f for f in self if f.priority is not None), key=lambda f: f.priority)


REGISTRY = FormatRegistry()
register_format = REGISTRY.register


def format_parts(line: Column, fmt: LogFormat) -> Column:
    """Array of the capture groups of a line, after one element of no meaning.

    One pass of the regex writes all groups with a mark between them; a line of
    another format stays in one piece, so its array has one element. Lines that hold
    the mark themselves take one pass per group.
    """
    n = len(fmt.fields)
    groups = "".join(f"{MARK}${i}" for i in range(1, n + 1))
    written = F.split(F.regexp_replace(line, fmt.regex, f"{groups}{MARK}"), MARK)
    one_by_one = F.array(F.lit(""), *[F.regexp_extract(line, fmt.regex, i) for i in range(1, n + 1)])
    return F.when(~line.contains(MARK), written).when(line.rlike(fmt.regex), one_by_one).otherwise(F.array(line))


def parse_format(df: DataFrame, name: str, registry: FormatRegistry = REGISTRY) -> DataFrame:
    """The lines with the fields of a named format, NULL where a line is of another one."""
    if name == PASS_THROUGH:
        return df.withColumn("entry", F.col("line"))
    fmt = registry[name]
    parts = F.col("parts")
    values = [
        F.when(F.size(parts) > 1, F.get(parts, F.lit(i))).alias(field) for i, field in enumerate(fmt.fields, start=1)
    ]
    return df.withColumn("parts", format_parts(F.col("line"), fmt)).select(*df.columns, *values)


def syslog_priority(priority: Column) -> list[Column]:
    """Facility and level number of an RFC 5424 priority."""
    number = priority.try_cast("int")
    return [F.floor(number / 8).cast("int").alias("facility"), (number % 8).alias("level")]


def json_fields(df: DataFrame) -> DataFrame:
    """Timestamp, level (or severity) and message of JSON lines; empty where missing or malformed."""
    parsed = df.withColumn("json", F.try_parse_json("line"))
    field = lambda name: F.try_variant_get("json", f"$.{name}", "string")
    return parsed.select(
        *df.columns,
        F.coalesce(field("timestamp"), F.lit("")).alias("timestamp"),
        F.coalesce(field("level"), field("severity"), F.lit("")).alias("severity"),
        F.coalesce(field("message"), F.lit("")).alias("message"),
    )


CLOUDTRAIL_RECORD = (
    "struct<eventTime:string,eventSource:string,eventName:string,awsRegion:string,"
    "sourceIPAddress:string,errorCode:string,errorMessage:string>"
)


def cloudtrail_records(df: DataFrame, record: str = CLOUDTRAIL_RECORD) -> DataFrame:
    """One row per audit record of each line."""
    parsed = F.from_json("line", f"Records array<{record}>")
    keep = [c for c in df.columns if c != "line"]
    return df.where(F.col("line").startswith('{"Records":[')).select(*keep, F.inline(parsed["Records"]))


#: Splits whose header table may be broadcast, and how long the headers in it may be: some 100 MB at most.
HEADED_BLOCKS, HEADER_LENGTH = 50_000, 500


def w3c_rows(df: DataFrame, block: int = BLOCK, limit: int = HEADED_BLOCKS) -> DataFrame:
    """Data lines of W3C files as a map from the field names of their ``#Fields:`` header.

    A file may repeat its header; a data line takes the nearest one above it. Headers are
    few, so they are intervals that lines meet, not rows sorted among the lines: a block
    of lines (a split, for lines as read) has the last header of earlier blocks up to its own
    header, and that one from there on. Only blocks with several headers, or with one
    too long to hand round, are ordered, each on its own. Of a name that a header
    repeats, the last value counts.
    """
    places = [c for c in df.columns if c != "line"]
    blocked = with_block(df, block).select(
        "file", "block", position(df).alias("at"), "line", *[c for c in places if c not in ("file", "block")]
    )
    names = F.nullif(F.regexp_extract("line", "^#Fields: (.*)$", 1), F.lit(""))
    lines = computed(blocked, names=names, is_data=F.col("line").rlike("^[0-9-]+ [0-9:]+ "))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = F.collect_list(F.when(F.col("names").isNotNull(), F.struct("at", "names")))
    per_block = lines.groupBy("file", "block").agg(found.alias("found")).select(
        "file", "block", F.size("found").alias("headers"), F.array_min("found")["at"].alias("own_at"), F.array_min("found")["names"].alias("own"),
        F.last(F.array_max("found")["names"], ignorenulls=True).over(earlier).alias("carried"),
    )
    short = F.coalesce(F.greatest(F.length("carried"), F.length("own")), F.lit(0)) <= HEADER_LENGTH
    plain = short & (F.col("headers") <= 1)
    few = per_block.where(plain).drop("headers")
    few = F.broadcast(few) if split_bound(df) <= limit else few
    simple = lines.where("is_data").join(few, ["file", "block"]).withColumn(
        "names", F.when(F.col("at") > F.col("own_at"), F.col("own")).otherwise(F.col("carried"))
    )
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    mixed = (
        lines.where("is_data or names is not null").join(bounded(df, per_block.where(~plain).select("file", "block")), ["file", "block"], "left_semi")
        .withColumn("names", F.last("names", ignorenulls=True).over(so_far)).where("is_data")
        .join(per_block.where(~plain).select("file", "block", "carried"), ["file", "block"])
        .withColumn("names", F.coalesce("names", "carried"))
    )
    named = simple.select("line", "names", *places).unionByName(mixed.select("line", "names", *places)).where("names is not null")
    keys, values = F.split("names", " "), F.split("line", " ")
    pairs = F.slice(F.arrays_zip(keys.alias("key"), values.alias("value")), F.lit(1), F.least(F.size(keys), F.size(values)))
    once = F.filter(pairs, lambda pair, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]))
    return named.select(*places, F.map_from_entries(once).alias("row"))


def head_lines(df: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    """The first ``n`` lines of each file."""
    if "line_no" in df.columns:
        return df.where(F.col("line_no") <= n)
    # A long line may fill a whole split, so the head can span several of them: at most
    # ``n``, which the counts of all splits tell. No line is sorted for that.
    shifts = split_shifts(df)
    wanted = bounded(df, shifts.where(F.col("first") + F.col("shift") <= n).drop("first"))
    return df.join(wanted, ["file", "block"]).where(F.col("seq") + F.col("shift") <= n).select(*df.columns)


def _first_pattern(patterns, flags: str = "") -> Column:
    return F.coalesce(*[
        F.when(F.bool_or(F.col("line").rlike(f"{flags}{p}")), F.lit(p)) for p in patterns
    ])


def detect_patterns(df: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Per file, the first timestamp and severity pattern that occurs in its first 20 lines (``heads``, if at hand)."""
    return (head_lines(df) if heads is None else heads).groupBy("file").agg(
        F.lit("custom").alias("format"),
        _first_pattern(P.DETECT_TIMESTAMPS).alias("timestamp_pattern"),
        _first_pattern(P.DETECT_SEVERITIES, "(?i)").alias("severity_pattern"),
    )


def _vote(fmt: LogFormat) -> Column:
    matched = F.count_if(F.col("line").rlike(fmt.regex))
    if fmt.header is None:
        return matched
    return F.when(F.bool_or(F.col("line").rlike(fmt.header)), matched).otherwise(0)


def detect_format(df: DataFrame, registry: FormatRegistry = REGISTRY, heads: DataFrame | None = None) -> DataFrame:
    """Per file, the named format that most of its first 20 lines (``heads``, if at hand) have; ``custom`` if none.

    Of equally frequent formats the more specific one (by priority) wins.
    """
    formats = registry.detectable()
    votes = (head_lines(df) if heads is None else heads).groupBy("file").agg(
        F.count("*").alias("lines"),
        *[_vote(f).alias(f"v{i}") for i, f in enumerate(formats)],
    )
    most = F.greatest(*[F.col(f"v{i}") for i in range(len(formats))])
    name = F
    for i, f in enumerate(formats):
        name = name.when((F.col(f"v{i}") == most) & (most > 0), f.name)
    return votes.select("file", name.otherwise("custom").alias("format"), "lines", most.alias("matched"))


def parse_detected(df: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Timestamp, severity and message by the patterns detected for each file (from ``heads``, if at hand).

    A part whose pattern was not detected is empty, and so is one that a line lacks.
    """
    line = F.col("line")
    found = join_per_file(df, detect_patterns(df, heads).drop("format"))

    def by_pattern(column, patterns, extract):
        out = F
        for p in patterns:
            out = out.when(F.col(column) == p, extract(p))
        return F.coalesce(out, F.lit(""))

    ts = by_pattern("timestamp_pattern", P.DETECT_TIMESTAMPS, lambda p: first_match(line, p))
    level = by_pattern("severity_pattern", P.DETECT_SEVERITIES, lambda p: level_text(line, p))
    parts = computed(found, timestamp=ts, severity=level)
    return with_detected_message(parts, "timestamp", "severity").select(
        *df.columns, "timestamp", "severity", "message"
    )
