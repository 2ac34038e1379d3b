"""All matches of a list of timestamp forms, where a file goes by its first form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.staged import computed


def occurrences(df: DataFrame, forms, *keep: str) -> DataFrame:
    """``form, found``: index of the first form that a line has, and all its matches.

    A line with an earlier form proves that its file does not go by a later one, so
    its matches of later forms are never wanted. Lines without any have NULL.
    """
    line = F.col("line")
    staged = computed(df, m0=F.regexp_extract_all(line, F.lit(forms[0]), F.lit(0)))
    for i, form in enumerate(forms[1:], start=1):
        more = F.when(F.size(f"m{i - 1}") == 0, F.regexp_extract_all(line, F.lit(form), F.lit(0)))
        staged = computed(staged, **{f"m{i}": more})
    form = found = F
    for i in range(len(forms)):
        form = form.when(F.size(f"m{i}") > 0, i)
        found = found.when(F.size(f"m{i}") > 0, F.col(f"m{i}"))
    return staged.select(*keep, form.otherwise(None).alias("form"), found.otherwise(None).alias("found"))
