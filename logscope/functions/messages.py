"""Message part of a line, under four definitions, and error-message clean-up."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.severity import level_text
from logscope.functions.staged import computed
from logscope.functions.text import WHITE_SPACE, after_first, first_match, remove_first, strip
from logscope.functions.timestamps import extract_ts

PROFILES = ("csv", "detected", "separator", "contextual")


def with_message(df: DataFrame, profile: str = "csv", year: int | None = None) -> DataFrame:
    """``df`` with the ``message`` of its ``line``."""
    line = F.col("line")
    if profile == "csv":
        staged = computed(df, csv_ts=extract_ts(line, "csv", year))
        return staged.withColumn("message", csv_message(line, F.col("csv_ts"))).drop("csv_ts")
    if profile in ("detected", "separator"):
        levels = F.coalesce(*[level_text(line, p) for p in P.DETECT_SEVERITIES])
        staged = computed(df, found_ts=extract_ts(line, "detected"), found_level=levels)
        staged = with_detected_message(staged, "found_ts", "found_level").drop("found_ts", "found_level")
        return staged if profile == "detected" else computed_separator(staged)
    if profile == "contextual":
        ts = F.when(line.rlike(P.CLOCK), F.coalesce(
            first_match(line, P.ISO_T_OR_SPACE + P.ISO_TAIL), first_match(line, P.SYSLOG_PADDED), first_match(line, P.US)
        ))
        staged = computed(df, found_ts=ts)
        return computed(staged, message=contextual_message(line, F.col("found_ts"))).drop("found_ts")
    raise ValueError(f"unknown message profile {profile!r}, use one of {PROFILES}")


def csv_message(line: Column, ts: Column) -> Column:
    """What follows the timestamp, a first word and a word like a host name."""
    text = after_first(line, ts)
    text = F.regexp_replace(text, P.CSV_LEAD, "")
    text = F.regexp_replace(F.ltrim(text, F.lit(WHITE_SPACE)), P.CSV_HOST, "")
    return F.when(ts.isNull(), line).otherwise(text)


def with_detected_message(df: DataFrame, ts: str, level: str) -> DataFrame:
    """``message``: the line without its timestamp and level texts (each removed once)."""
    part = lambda name: F.coalesce(F.col(name), F.lit(""))
    df = df.withColumn("rest", remove_first(F.col("line"), part(ts)))
    return df.withColumn("message", strip(remove_first(F.col("rest"), part(level)))).drop("rest")


def computed_separator(df: DataFrame) -> DataFrame:
    """``message`` cut to what follows its last colon, or without colons its last ``- ``.

    NULL if nothing is left or the rest looks like a comment.
    """
    text = F.replace(F.col("uncut"), F.lit("\r"), F.lit(""))
    text = F.regexp_replace(text, P.LAST_SEPARATOR, "")
    text = F.nullif(F.regexp_replace(text, "(?s)^#.*$", ""), F.lit(""))
    return computed(df.withColumnRenamed("message", "uncut"), message=text).drop("uncut")


def contextual_message(line: Column, ts: Column) -> Column:
    """What follows a level word, else ``file:line:``, else ``process[pid]:``."""
    text = F.when(ts.isNull(), line).otherwise(F.regexp_replace(remove_first(line, ts), P.CONTEXT_LEAD, ""))
    return F.rtrim(F.ltrim(text, F.lit(" \t:")), F.lit(WHITE_SPACE))


def error_message(line: Column) -> Column:
    """Error text free of a leading timestamp and of all through the last ERROR; may be empty."""
    text = strip(line)
    for lead in P.ERROR_LEADS:
        text = F.regexp_replace(text, lead, "")
    return strip(text)
