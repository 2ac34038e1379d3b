"""The expressions as functions of SQL.

After ``register(spark)`` a query can say ``SELECT ts_csv(line), severity_csv(line), fields_syslog(line).hostname FROM logs``. Each
function is a SQL function of the session whose body is the text of the native expression, so the planner sees through it
and no Python runs. A view of registered formats is taken when ``register`` is called; call it again after adding one.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logscope.functions import messages, severity, timestamps
from logscope.functions.text import csv_field, sanitize_text
from logscope.operators.formats import REGISTRY, FormatRegistry, format_parts

_ARGUMENT = "line"


def _bodies(year: int | None, registry: FormatRegistry) -> dict[str, Column]:
    line = F.col(_ARGUMENT)
    made = {f"ts_{p}": timestamps.extract_ts(line, p, year) for p in timestamps.PROFILES}
    made |= {f"severity_{p}": severity.severity(line, p) for p in severity.PROFILES}
    made["msg_csv"] = messages.csv_message(line, timestamps.extract_ts(line, "csv", year))
    made["msg_error"] = F.nullif(messages.error_message(line), F.lit(""))
    made["ts_normal"] = timestamps.normalize_ts(line, year=year)
    made["ts_epoch"] = timestamps.to_epoch(line, year)
    made["ts_instant"] = timestamps.to_ts(line, year)
    made["clean_text"], made["csv_text"] = sanitize_text(line), csv_field(line)
    for fmt in registry:
        parts = format_parts(line, fmt)
        fields = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(fmt.fields, start=1)]
        made[f"fields_{fmt.name}"] = F.when(F.size(parts) > 1, F.struct(*fields))
    return made


def register(spark: SparkSession, year: int | None = None, registry: FormatRegistry = REGISTRY) -> list[str]:
    """Make the functions known to the session; their names. They take one text, mostly a line; ``year`` is for timestamps without one."""
    bodies = _bodies(year, registry)
    one = spark.createDataFrame([], f"{_ARGUMENT} string").select(*[body.alias(name) for name, body in bodies.items()])
    expressions = one._jdf.queryExecution().analyzed().expressions()
    for i, field in enumerate(one.schema.fields):
        text = expressions.apply(i).child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {field.name}({_ARGUMENT} STRING) RETURNS {field.dataType.simpleString()} RETURN {text}")
    return list(bodies)
