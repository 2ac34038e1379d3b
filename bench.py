"""Times the headline queries: one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logscope.frame import read
from logscope.operators import summary
from logscope.plans.catalog import QUERIES
from logscope.plans.dataset import log_lines

HEADLINE = (
    "summary_counts", "file_statistics", "top_errors_5", "unique_errors", "hist_hour", "csv_rows",
    "sample_systematic", "page_3", "filter_time_epoch", "severity_contextual", "parse_apache_combined",
    "detect_format", "stacktrace_records", "report_long", "split_text_lines",
)

# Over text files with COPIES times the lines of the events table.
COPIES = 20
ON_FILES = {
    "statistics": lambda log: summary.file_statistics(log.lines), "unique_errors": lambda log: log.unique_errors(),
    "page": lambda log: log.errors_only().page(3), "stacktraces": lambda log: log.stacktraces(), "csv_rows": lambda log: log.csv_rows(year=2024),
}


def text_files(spark: SparkSession, sf_dir: str, path: str) -> str:
    lines = log_lines(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    lines.repartition(8, "copy").sortWithinPartitions("copy", "line_no").select(F.col("line").alias("value")).write.text(path)
    return path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        logs = text_files(spark, sf_dir, f"{folder}/logs")
        runs = {name: lambda name=name: QUERIES[name](spark, sf_dir) for name in HEADLINE}
        runs |= {f"files_{name}": lambda make=make: make(read(spark, logs)) for name, make in ON_FILES.items()}
        times = {}
        for name, run in runs.items():
            best = []
            for _ in range(2):
                start = time.perf_counter()
                run().write.format("noop").mode("overwrite").save()
                best.append(time.perf_counter() - start)
            times[name] = round(min(best), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times[name] for name in HEADLINE), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
