"""Counts, time range and the summary record of log files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.severity import severity
from logscope.functions.timestamps import normalize_ts
from logscope.operators.errors import top_errors
from logscope.operators.filters import has_text, matches
from logscope.operators.occurrences import occurrences
from logscope.sources.files import bounded


def _count_columns() -> list[Column]:
    line = F.col("line")
    return [
        F.count("*").alias("total_lines"),
        F.count_if(has_text(line, "error")).alias("error_count"),
        F.count_if(has_text(line, "warn")).alias("warning_count"),
        F.count_if(has_text(line, "info")).alias("info_count"),
    ]


def summary_counts(df: DataFrame, *by: str) -> DataFrame:
    """Lines in all, and lines with error, warn, info in any case (a line can count in several)."""
    return df.groupBy(*by).agg(*_count_columns())


def rollup_by_file(df: DataFrame) -> DataFrame:
    """Counts per file and, with a NULL file, over all files."""
    per_file = summary_counts(df, "file")
    names = [c for c in per_file.columns if c != "file"]
    return per_file.rollup("file").agg(*[F.sum(c).alias(c) for c in names])


def count_severity(df: DataFrame, pattern: str) -> DataFrame:
    return df.agg(F.count_if(matches(F.col("line"), pattern)).alias("count"))


def severity_distribution(df: DataFrame, profile: str = "csv") -> DataFrame:
    return df.groupBy(severity(F.col("line"), profile).alias("severity")).agg(F.count("*").alias("count"))


def _order(df: DataFrame) -> tuple[list[str], str]:
    """Group columns and position column that order the lines of a file."""
    return (["file"], "line_no") if "line_no" in df.columns else (["file", "block"], "seq")


# Times travel through the aggregation as BIGINT, so that min_by and max_by keep to
# the hash aggregate; with strings Spark would sort all rows by file first.


PACK_ISO = "cast(replace(replace(replace(replace({ts}, '-', ''), ':', ''), 'T', ''), ' ', '') as bigint)"
UNPACK_ISO = (
    "regexp_replace(lpad({n}, 14, '0'),"
    " '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})$', '$1-$2-$3 $4:$5:$6')"
)
# Three letters, then whether the day has two digits, day (2 places), clock (6 places).
PACK_SYSLOG = (
    "cast(conv(hex(substr({ts}, 1, 3)), 16, 10) as bigint) * 1000000000"
    " + if(length({ts}) = 15, 100000000, 0) + cast(replace(replace(substr({ts}, 5), ' ', ''), ':', '') as bigint)"
)
UNPACK_SYSLOG = (
    "regexp_replace(cast(unhex(hex({n} div 1000000000)) as string)"
    " || if({n} % 1000000000 >= 100000000, lpad({n} % 100000000, 8, '0'), lpad({n} % 100000000, 7, '0')),"
    " '^([A-Za-z]{{3}})([0-9]{{1,2}})([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})$', '$1 $2 $3:$4:$5')"
)
_PACKED = (
    (P.ISO_T, PACK_ISO, UNPACK_ISO),
    (P.ISO_SPACE, PACK_ISO, UNPACK_ISO),
    (P.SYSLOG_SINGLE_BLANK, PACK_SYSLOG, UNPACK_SYSLOG),
)


def _ends(df: DataFrame, forms) -> DataFrame:
    """``form, first, last``: ends of the matches in each line; ``last`` is NULL if there is one match."""
    found = F.col("found")
    return occurrences(df, forms, *df.columns).withColumn("first", F.get(found, F.lit(0))).withColumn(
        "last", F.when(F.size(found) > 1, F.element_at(found, -1))
    )


def _with_packed(df: DataFrame) -> DataFrame:
    def packed(end):
        out = F
        for i, (_, pack, _) in enumerate(_PACKED):
            out = out.when(F.col("form") == i, F.expr(pack.format(ts=end)))
        return out.otherwise(None)

    ends = _ends(df, [form for form, _, _ in _PACKED]).withColumn("a", packed("first"))
    b = F.when(F.col("last").isNull(), F.col("a")).otherwise(packed("last"))
    return ends.select(*df.columns, "form", "a", b.alias("b"))


def _of_form(i: int, column: str):
    return F.when(F.col("form") == i, F.col(column))


def _first_last(position: str, n: int) -> list[Column]:
    """Per form, the earliest and latest time by ``position``."""
    return [
        c for i in range(n) for c in (
            F.min_by(_of_form(i, "a"), _of_form(i, position)).alias(f"a{i}"),
            F.max_by(_of_form(i, "b"), _of_form(i, position)).alias(f"b{i}"),
        )
    ]


def _first_last_block(n: int) -> list[Column]:
    """The same over the results of the blocks of a file."""
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("block"))
    return [
        c for i in range(n) for c in (
            F.min_by(f"a{i}", has(f"a{i}")).alias(f"a{i}"), F.max_by(f"b{i}", has(f"b{i}")).alias(f"b{i}"),
        )
    ]


def _unpacked() -> list[Column]:
    def time(side: str) -> Column:
        return F.coalesce(*[F.expr(unpack.format(n=f"{side}{i}")) for i, (_, _, unpack) in enumerate(_PACKED)])

    return [time("a").alias("time_start"), time("b").alias("time_end")]


def file_statistics(df: DataFrame) -> DataFrame:
    """Counts and time range per file: one scan, one aggregation.

    The range is the first and last match in file order (not the least and greatest
    time) of the first form that occurs in the file: ISO with ``T``, ISO with a
    blank, then month and day without year.
    """
    counts = list(COUNTS)
    return _packed_statistics(df, counts).select("file", *counts, *_unpacked())


def time_range(df: DataFrame) -> DataFrame:
    return _packed_statistics(df, []).select("file", *_unpacked())


def _packed_statistics(df: DataFrame, counts: list[str]) -> DataFrame:
    keys, position = _order(df)
    n = len(_PACKED)
    stats = _with_packed(df).groupBy(*keys).agg(*(_count_columns() if counts else []), *_first_last(position, n))
    if "block" in keys:
        stats = stats.groupBy("file").agg(*[F.sum(c).alias(c) for c in counts], *_first_last_block(n))
    return stats


def iso_time_range(df: DataFrame) -> DataFrame:
    """Range of ISO times only, as written; ``Unknown`` if there is none."""
    return _text_range(df, [P.ISO_T_OR_SPACE], lambda ts: ts, "Unknown")


def date_range(df: DataFrame, year: int | None = None, counts: bool = False) -> DataFrame:
    """Normalised range of the first detection form that occurs in the file; NULL if none. With ``counts``, the
    counts of ``summary_counts`` beside it, from the same pass."""
    return _text_range(df, P.DETECT_TIMESTAMPS, lambda ts: normalize_ts(ts, year=year), None, COUNTS if counts else ())


COUNTS = ("total_lines", "error_count", "warning_count", "info_count")


def _text_range(df: DataFrame, forms, show, missing: str | None, counts: tuple[str, ...] = ()) -> DataFrame:
    """The ends as text of any length. Lines as read are counted by place first, and the two lines that matter are
    fetched by place; with text in the aggregate all lines would be sorted, as they are for tables."""
    texts = _ends_of_table(df, forms, counts) if "line_no" in df.columns else _ends_by_place(df, forms, counts)
    both = [show(F.col(side)) for side in "ab"]
    if missing is not None:
        both = [F.coalesce(end, F.lit(missing)) for end in both]
    return texts.select("file", *counts, both[0].alias("time_start"), both[1].alias("time_end"))


def _ends_of_table(df: DataFrame, forms, counts: tuple[str, ...]) -> DataFrame:
    n = len(forms)
    ends = _ends(df.select("file", "line_no", "line"), forms).select(
        "file", "line_no", "line", "form", F.col("first").alias("a"), F.coalesce("last", "first").alias("b")
    )
    times = ends.groupBy("file").agg(*(_count_columns() if counts else []), *_first_last("line_no", n))
    return times.select("file", *counts, *[F.coalesce(*[F.col(f"{side}{i}") for i in range(n)]).alias(side) for side in "ab"])


def _ends_by_place(df: DataFrame, forms, counts: tuple[str, ...]) -> DataFrame:
    n = len(forms)
    places = occurrences(df, forms, "file", "block", "seq", "line").groupBy("file", "block").agg(
        *(_count_columns() if counts else []), F.min("seq").alias("any"),
        *[c for i in range(n) for c in (F.min(_of_form(i, "seq")).alias(f"a{i}"), F.max(_of_form(i, "seq")).alias(f"b{i}"))],
    )
    block_of = lambda c: F.when(F.col(c).isNotNull(), F.col("block"))
    files = places.groupBy("file").agg(
        *[F.sum(c).alias(c) for c in counts], F.min("block").alias("any_block"), F.min_by("any", "block").alias("any"),
        *[c for i in range(n) for c in (
            F.min(block_of(f"a{i}")).alias(f"a{i}_block"), F.min_by(f"a{i}", block_of(f"a{i}")).alias(f"a{i}"),
            F.max(block_of(f"b{i}")).alias(f"b{i}_block"), F.max_by(f"b{i}", block_of(f"b{i}")).alias(f"b{i}"),
        )],
    )
    # A file without a time keeps a row by the place of any line of it.
    place = lambda side: F.struct(
        F.lit(side).alias("side"),
        F.coalesce(*[F.col(f"{side}{i}_block") for i in range(n)], F.col("any_block")).alias("block"),
        F.coalesce(*[F.col(f"{side}{i}") for i in range(n)], F.col("any")).alias("seq"),
    )
    form = F.coalesce(*[F.when(F.col(f"a{i}").isNotNull(), i) for i in range(n)])
    wanted = files.select("file", *counts, form.alias("form"), F.inline(F.array(place("a"), place("b"))))
    fetched = df.join(bounded(df, wanted), ["file", "block", "seq"])
    found = F
    for i, pattern in enumerate(forms):
        found = found.when(F.col("form") == i, F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))
    fetched = fetched.withColumn("found", found.otherwise(None))
    return fetched.groupBy("file").agg(
        *[F.max(c).alias(c) for c in counts],
        F.max(F.when(F.col("side") == "a", F.get("found", F.lit(0)))).alias("a"),
        F.max(F.when(F.col("side") == "b", F.element_at("found", -1))).alias("b"),
    )


def summarize(df: DataFrame, top: int = 5) -> DataFrame:
    """Summary record per file, with its ``top`` most frequent error lines."""
    errors = top_errors(df, top, by_file=True).groupBy("file").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("occurrences", "message")))).alias("top_errors")
    )
    none = F.array().cast("array<struct<occurrences:bigint,message:string>>")
    return (
        file_statistics(df).join(errors, "file", "left")
        .withColumn("top_errors", F.coalesce("top_errors", none))
    )
