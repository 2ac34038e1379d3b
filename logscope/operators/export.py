"""Export of a view: CSV data and a metadata record beside it."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logscope.operators.filters import filter_counts, passed
from logscope.operators.rows import csv_rows
from logscope.sources.csv import write_csv


def _metadata(counts: DataFrame, filters: list[str], source: str, scope: str) -> DataFrame:
    labels = F.array(*[F.lit(f) for f in filters]) if filters else F.array().cast("array<string>")
    return counts.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("export_date"),
        F.lit(source).alias("source"),
        F.lit(scope).alias("export_type"),
        F.col("total").alias("total_entries"),
        F.col("kept").alias("filtered_entries"),
        labels.alias("filters"),
    )


def export_metadata(
    everything: DataFrame, tests: list, filters: list[str], source: str, scope: str
) -> DataFrame:
    """One row: date, source, scope, entries in all and of those that pass the tests, filter labels."""
    return _metadata(filter_counts(everything, *tests), filters, source, scope)


def export_view(
    everything: DataFrame, path: str, tests: list, filters: list[str], source: str, scope: str = "filtered", year: int | None = None,
) -> None:
    """Write ``path/data`` (CSV) and ``path/metadata`` (JSON).

    The entries are counted while the rows are written, so the input is read once. Metrics of
    tasks that fail or run twice do not count.
    """
    if scope not in ("filtered", "full"):
        raise ValueError("scope is 'filtered' or 'full'")
    counted = Observation()
    seen = passed(everything, *tests).observe(counted, F.count("*").alias("total"), F.count_if("passed").alias("kept"))
    rows = csv_rows((seen.where("passed") if scope == "filtered" else seen).drop("passed"), "view", year)
    write_csv(rows, f"{path}/data")
    counts = {"total": 0, "kept": 0, **counted.get}  # nothing is observed of what is known to be empty
    one = everything.sparkSession.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])
    _metadata(one, filters, source, scope).write.json(f"{path}/metadata")
