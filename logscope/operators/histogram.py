"""Counts of timestamps over time, their peak, anomalies and chart."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.patterns import DETECT_TIMESTAMPS
from logscope.functions.text import bar, sanitize_text
from logscope.functions.timestamps import to_ts
from logscope.operators.filters import has_error
from logscope.operators.occurrences import occurrences

# grain: written form of a bucket
GRAINS = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def time_histogram(df: DataFrame, interval: str = "hour", year: int | None = None) -> DataFrame:
    """``file, bucket, count`` of every timestamp of the file's form, in the order of files and buckets.

    The form of a file is the first detection pattern that occurs in it. All forms
    are counted in one pass and the others dropped from the (small) counts. Buckets
    are grouped as instants and written out afterwards; a timestamp that cannot be
    read is its own bucket. An unknown interval means hours.
    """
    return _time_histogram(df, interval, year).orderBy("file", "bucket")


def _time_histogram(df: DataFrame, interval: str, year: int | None) -> DataFrame:
    grain = interval if interval in GRAINS else "hour"
    instant = to_ts(F.col("text"), year)
    counts = (
        occurrences(df, DETECT_TIMESTAMPS, "file").where("file is not null and form is not null").select("file", "form", F.explode("found").alias("text"))
        .select("file", "form", F.date_trunc(grain, instant).alias("at"), "text")
        .withColumn("text", F.when(F.col("at").isNull(), F.col("text")))
        .groupBy("file", "form", "at", "text").agg(F.count("*").alias("count"))
    )
    # the two sides share one aggregation: the filter above is the one that the join
    # would add to its left side, and the right side reads the count as well
    form = counts.groupBy("file").agg(F.min(F.when(F.col("count") > 0, F.col("form"))).alias("form"))
    return counts.join(form, ["file", "form"]).select(
        "file", F.coalesce(F.date_format("at", GRAINS[grain]), "text").alias("bucket"), "count"
    )


def peak(histogram: DataFrame) -> DataFrame:
    """Largest count per file and its bucket, the earliest of several."""
    most = Window.partitionBy("file").orderBy(F.desc("count"), F.asc("bucket"))
    return (
        histogram.withColumn("rank", F.row_number().over(most)).where("rank = 1")
        .select("file", F.col("bucket").alias("peak_bucket"), F.col("count").alias("peak_count"))
    )


def error_anomalies(
    df: DataFrame, interval: str = "hour", threshold: int = 100, year: int | None = None
) -> DataFrame:
    """Buckets with at least ``threshold`` timestamps on lines with "error"."""
    errors = df.where(has_error(F.col("line")))
    return time_histogram(errors, interval, year).where(F.col("count") >= threshold)


#: Scales a median deviation to the standard deviation of a normal distribution.
NORMAL = 1.4826
_STEPS = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH"}


def _without_gaps(spans: DataFrame, grain: str) -> DataFrame:
    """``spans`` (file, form, first, last) with each bucket ``at`` from first to last; by days, then within them, so no array is long."""
    if grain in ("day", "month"):
        return spans.select("file", "form", F.explode(F.sequence("first", "last", F.expr(_STEPS[grain]))).alias("at"))
    days = spans.select("file", "form", "first", "last", F.explode(F.sequence(F.date_trunc("day", "first"), "last", F.expr("INTERVAL 1 DAY"))).alias("day"))
    step = F.expr(_STEPS[grain])
    within_day = days.select("file", "form", "first", "last", F.explode(F.sequence("day", F.col("day") + F.expr("INTERVAL 1 DAY") - step, step)).alias("at"))
    return within_day.where("at BETWEEN first AND last").select("file", "form", "at")


def error_baseline(
    df: DataFrame, interval: str = "hour", window: int = 24, factor: float = 3.0, year: int | None = None
) -> DataFrame:
    """``file, bucket, count, median, deviation, anomaly``: timestamps on lines with "error" per bucket, against the buckets before.

    Every bucket between a file's first and last timestamp has a row, those without any line
    with a count of 0. ``median`` is of the ``window`` buckets before (as many as there are),
    ``deviation`` the median distance from it, scaled by 1.4826 and 1 at least. A bucket
    is an anomaly if its count exceeds the median by more than ``factor`` deviations. The first
    bucket has nothing to be compared with: NULL.
    """
    grain = interval if interval in GRAINS else "hour"
    wrong = df.withColumn("wrong", has_error(F.col("line")))
    found = occurrences(wrong, DETECT_TIMESTAMPS, "file", "wrong").where("file is not null and form is not null")
    counts = (
        found.select("file", "form", "wrong", F.explode("found").alias("text"))
        .select("file", "form", "wrong", F.date_trunc(grain, to_ts(F.col("text"), year)).alias("at")).where("at is not null")
        .groupBy("file", "form", "at").agg(F.count_if("wrong").alias("count"))
    )
    spans = counts.groupBy("file", "form").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    of_file = spans.groupBy("file").agg(F.min_by(F.struct("form", "first", "last"), "form").alias("span")).select("file", "span.*")
    series = _without_gaps(of_file, grain).join(counts, ["file", "form", "at"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(-window, -1)
    held = series.withColumn("before", F.array_sort(F.collect_list("count").over(before)))
    held = held.withColumn("median", _median("before"))
    held = held.withColumn("distances", F.array_sort(F.transform("before", lambda x: F.abs(x - F.col("median")))))
    held = held.withColumn("deviation", F.greatest(F.lit(1.0), NORMAL * _median("distances")))
    deviation = F.when(F.col("median").isNotNull(), F.col("deviation"))
    return held.select(
        "file", F.date_format("at", GRAINS[grain]).alias("bucket"), "count", "median", deviation.alias("deviation"),
        (F.col("count") - F.col("median") > factor * deviation).alias("anomaly"),
    ).orderBy("file", "bucket")


def _median(sorted_array: str) -> Column:
    """The middle of a sorted array, between the two middle ones if their number is even; NULL if it is empty."""
    n = F.size(sorted_array)
    low, high = F.get(sorted_array, F.floor((n - 1) / 2).cast("int")), F.get(sorted_array, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def time_chart(histogram: DataFrame) -> DataFrame:
    """The histogram with a bar each, scaled to the largest count of all files."""
    largest = histogram.agg(F.max("count")).scalar()
    return histogram.select(
        "file", sanitize_text(F.col("bucket")).alias("bucket"), "count", bar(F.col("count"), largest).alias("bar")
    )
