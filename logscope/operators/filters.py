"""Predicates on lines, their effect counts, and search."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.staged import computed
from logscope.functions.text import contains_any
from logscope.functions.timestamps import extract_ts, to_ts, within

OPEN = 10**12  # seconds, beyond every readable timestamp


@dataclass(frozen=True)
class Predicate:
    """A condition and the columns it needs, which are computed once per line."""

    keep: Column
    needs: dict[str, Column] = field(default_factory=dict)

    def staged(self, df: DataFrame) -> DataFrame:
        return computed(df, **self.needs) if self.needs else df


def where(df: DataFrame, test: Predicate | Column) -> DataFrame:
    if isinstance(test, Column):
        return df.where(test)
    return test.staged(df).where(test.keep).select(*df.columns)


def has_error(line: Column) -> Column:
    return F.lower(line).contains("error")


def has_broad_error(line: Column) -> Column:
    return contains_any(F.lower(line), P.BROAD_ERRORS)


def basic_regex(pattern: str) -> str:
    """A POSIX basic regular expression as a Java one.

    There ``\\|``, ``\\+``, ``\\?``, ``\\{``, ``\\(`` are operators and the bare characters are text; a star
    at the beginning is text, and in brackets a backslash is.
    """
    out, at, fresh = [], 0, True
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            c = pattern[at]
            out.append(c if c in "|+?{}()" else "\\" + c)
            fresh = c in "(|"
        elif c == "[" and (end := pattern.find("]", at + 2 + pattern.startswith("[^", at))) > 0:
            inner = pattern[at + 1 : end].replace("\\", "\\\\").replace("&&", "&\\&")
            inner = inner if inner.startswith("[:") else inner.replace("[", "\\[")
            out.append(f"[{inner}]".replace("[^]", "[^\\]").replace("[]", "[\\]"))
            at, fresh = end, False
        else:
            text = c in "|+?{}()" or c == "*" and fresh or c == "^" and not fresh or c == "$" and at + 1 < len(pattern) and pattern[at + 1 : at + 3] != "\\|"
            out.append("\\" + c if text else c)
            fresh = c == "^" and fresh
        at += 1
    return "".join(out)


def matches(line: Column, pattern: str, dialect: str = "basic") -> Column:
    """Regular expression, any case: a POSIX basic one, or with ``dialect="java"`` one of Spark."""
    if dialect not in ("basic", "java"):
        raise ValueError("dialect is 'basic' or 'java'")
    return line.rlike(f"(?i){basic_regex(pattern) if dialect == 'basic' else pattern}")


def has_text(line: Column, text: str) -> Column:
    """Literal text, any case."""
    return F.lower(line).contains(text.lower())


def text_filter(line: Column, text: str, regex: bool = False, dialect: str = "basic") -> Column:
    return matches(line, text, dialect) if regex else has_text(line, text)


def in_lexical_window(line: Column, start: str | None = None, end: str | None = None) -> Predicate:
    """Compare timestamp text with the bounds as written; lines without one stay.

    Bounds are not expanded: an end of ``2023-10-15`` is before all of that day.
    """
    ts = F.col("lexical_ts")
    keep = F.lit(True)
    if start:
        keep = keep & (ts >= start.replace("T", " "))
    if end:
        keep = keep & (ts <= end.replace("T", " "))
    return Predicate(ts.isNull() | keep, {"lexical_ts": extract_ts(line, "lexical")})


def in_time_window(
    line: Column,
    start: str | None = None,
    end: str | None = None,
    ts_profile: str = "rich",
    year: int | None = None,
    drop_comments: bool = False,
) -> Predicate:
    """Inclusive window on instants; lines without a readable timestamp stay.

    A date alone starts at 00:00:00 or ends at 23:59:59. A bound that cannot be read
    leaves its side open.
    """
    instant = F.unix_seconds(to_ts(F.col("window_ts"), year))
    keep = F.coalesce(within(instant, *window_bounds(start, end, year)), F.lit(True))
    if drop_comments:
        keep = ~line.startswith("#") & keep
    return Predicate(keep, {"window_ts": extract_ts(line, ts_profile, year)})


def window_bounds(start: str | None, end: str | None, year: int | None = None) -> tuple[Column, Column]:
    """First and last second of a window as ``in_time_window`` takes it."""
    bound = lambda text, clock, open_end: F.coalesce(
        F.unix_seconds(to_ts(F.lit(_whole_day(text or "", clock)), year)), F.lit(open_end)
    )
    return bound(start, "00:00:00", -OPEN), bound(end, "23:59:59", OPEN)


def _whole_day(bound: str, clock: str) -> str:
    dated = re.fullmatch(rf"{P.ISO_DATE}|{P.US_DATE}", bound)
    return f"{bound} {clock}" if dated else bound


def passed(df: DataFrame, *tests: Predicate | Column) -> DataFrame:
    """``df`` with ``passed``: whether a line passes all tests."""
    columns, keep = df.columns, F.lit(True)
    for i, test in enumerate(tests):
        if isinstance(test, Predicate):
            # two windows may need a column of the same name
            df = test.staged(df).withColumn(f"test{i}", test.keep).drop(*test.needs)
            test = F.col(f"test{i}")
        keep = keep & test
    return df.select(*columns, F.coalesce(keep, F.lit(False)).alias("passed"))


def filter_counts(df: DataFrame, *tests: Predicate | Column) -> DataFrame:
    """``kept, total``: lines that pass all tests, and all lines, in one pass."""
    return passed(df, *tests).agg(F.count_if("passed").alias("kept"), F.count("*").alias("total"))


def search(
    df: DataFrame, text: str, start: int, direction: str = "forward", file: str | None = None
) -> DataFrame:
    """``line_no`` of the nearest line with ``text`` from ``start`` on (or back); NULL if none."""
    if file is not None:
        df = df.where(F.col("file") == file)
    found = df.where(has_text(F.col("line"), text))
    if direction == "forward":
        return found.where(F.col("line_no") >= start).agg(F.min("line_no").alias("line_no"))
    if direction == "backward":
        return found.where(F.col("line_no") <= start).agg(F.max("line_no").alias("line_no"))
    raise ValueError("direction is 'forward' or 'backward'")
