"""What JSON lines hold: paths, types and counts per file, and columns made by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions.staged import computed

#: Levels of objects and arrays that are looked into; what is below counts as one value.
DEPTH = 6
#: Paths that become columns, at most.
COLUMNS = 500
ROOT = "$"


def _type(value: Column) -> Column:
    """string, integer, number, boolean, null, object or array; other types by their own name."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    names = {"STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null"}
    out = F
    for written, shown in names.items():
        out = out.when(name == written, shown)
    return out.otherwise(F.lower(name))


def json_schema(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``file, path, type, count`` of the values in JSON lines, in one pass.

    Counted are the values themselves: scalars, nulls, empty objects and arrays, and what lies deeper than
    ``depth`` levels, as object or array. Elements of arrays share the path of their array and
    ``[]``. A path that has several types has a row for each. Lines that do not begin with JSON count as
    ``malformed``, blank ones not at all.
    """
    lines = df.where(F.trim("line") != "").select("file", "line")
    # a generator's columns are made once; the parsed value is used at every level
    rows = computed(lines, path=F.lit(ROOT), value=F.try_parse_json("line")).drop("line")
    tvf = df.sparkSession.tvf
    for _ in range(depth):
        rows = rows.lateralJoin(tvf.variant_explode_outer(F.col("value").outer()).toDF("at", "key", "inner")).select(
            "file",
            F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).when(F.col("at").isNotNull(), F.concat("path", F.lit("[]"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("at").isNotNull(), F.col("inner")).otherwise(F.col("value")).alias("value"),
        )
    kind = F.when(F.col("value").isNull(), "malformed").otherwise(_type(F.col("value")))
    return rows.select("file", "path", kind.alias("type")).groupBy("file", "path", "type").agg(F.count("*").alias("count"))


#: Spark type of a column whose values have these types, nulls aside; any other mix is a string.
_COLUMNS = {
    frozenset({"integer"}): "bigint", frozenset({"number"}): "double", frozenset({"integer", "number"}): "double", frozenset({"boolean"}): "boolean",
}


def json_columns(df: DataFrame, schema: DataFrame, most: int = COLUMNS) -> DataFrame:
    """The lines with a column for each scalar path of ``schema`` that leads through no array, typed by what was found there.

    Columns are named by their path without the root. ``schema`` (of ``json_schema``, of any number of files) is read
    when the columns are planned; more than ``most`` paths raise an error.
    """
    found = schema.where(~F.contains("path", F.lit("[]")) & ~F.col("type").isin("malformed", "object", "array") & (F.col("path") != ROOT))
    paths = found.groupBy("path").agg(F.collect_set("type").alias("types")).orderBy("path").limit(most + 1).collect()
    if len(paths) > most:
        raise ValueError(f"more than {most} paths")
    parsed = computed(df, json=F.try_parse_json("line"))
    columns = []
    for r in paths:
        kind = _COLUMNS.get(frozenset(r["types"]) - {"null"}, "string")
        keys = "".join(f'["{k}"]' for k in r["path"][len(ROOT) + 1 :].split("."))
        columns.append(F.try_variant_get("json", ROOT + keys, kind).alias(r["path"][len(ROOT) + 1 :]))
    return parsed.select(*df.columns, *columns)
