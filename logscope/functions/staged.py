"""Columns computed once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each evaluated once however often it is mentioned later.

    A plain projection does not promise that: a filter on its columns is moved below
    it, with the whole expression in place of every mention. Filters do not move
    below a generator that makes the columns.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
