import uuid

import pytest
from pyspark.sql import SparkSession

EXAMPLE = """
2023-09-01 12:00:00 INFO Server started on port 3000
2023-09-01 12:01:15 INFO User login: user123
2023-09-01 12:02:30 WARNING Slow database query took 2.5s
2023-09-01 12:03:45 ERROR Failed to connect to payment gateway: timeout
2023-09-01 12:04:50 INFO User logout: user123
2023-09-01 12:05:10 ERROR Cannot process order #12345: invalid payment
2023-09-01 12:06:20 INFO New user registered: user456
2023-09-01 12:07:30 WARNING Memory usage above 80%
2023-09-01 12:08:40 ERROR Failed to connect to payment gateway: timeout
2023-09-01 12:09:50 INFO System health check completed
"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def example(spark):
    from logscope import read_text
    return read_text(spark, EXAMPLE)


@pytest.fixture
def lines(spark):
    """Frame of given lines: ``lines("a", "b")`` or ``lines([("f", 1, "a"), …])``."""
    def make(*texts):
        rows = texts[0] if len(texts) == 1 and isinstance(texts[0], list) else [
            ("f", i, t) for i, t in enumerate(texts, start=1)
        ]
        return spark.createDataFrame(rows, "file string, line_no bigint, line string")
    return make


@pytest.fixture
def measured(spark):
    """``measured(run)``: the result of a call, and the sums of its tasks' metrics by name."""
    names = ("inputBytes", "inputRecords", "shuffleWriteBytes", "shuffleWriteRecords")

    def run_measured(run):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        try:
            result = run()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        tracker, store = spark.sparkContext.statusTracker(), context.statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        attempts = [store.lastStageAttempt(s) for s in stages if tracker.getStageInfo(s)]
        return result, {n: sum(getattr(a, n)() for a in attempts) for n in names}

    return run_measured
