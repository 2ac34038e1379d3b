"""CSV sink and source of ``timestamp, severity, message`` rows."""

from pyspark.sql import DataFrame, SparkSession

CSV_COLUMNS = ("timestamp", "severity", "message")


def csv_options(writer):
    """Header, every field quoted, quotes doubled, blanks kept."""
    return (
        writer.option("header", True).option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("nullValue", "").option("emptyValue", "")
    )


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file per partition."""
    csv_options(rows.select(*CSV_COLUMNS).write.mode(mode)).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``write_csv``; a record that does not parse keeps its text in ``csv_parse_error``."""
    return (
        spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "csv_parse_error")
        .option("nullValue", None).option("emptyValue", "")
        .schema("timestamp string, severity string, message string, csv_parse_error string")
        .csv(path)
    )
