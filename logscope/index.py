"""Facts about files, stored, so that later questions open only the files that matter.

An index is a folder of small tables of what is known of each file: its counts, the span of its timestamps, its error messages,
and for a view how many of its lines pass. Each row carries the size and modification time that the file had. Using a table compares them with the listing of today:
files that are new or changed are read and their rows made again, those of files that are gone are left out, and nothing
else is read. A changed table is a new version beside the old one, so a reader never sees half of it.

With it a time window plans a scan of the files whose span meets it, and pages and samples of a view scan the few files that
hold the wanted positions. Results are those of the same operations without an index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.frame import LogFrame
from logscope.functions.staged import computed
from logscope.functions.timestamps import extract_ts, to_ts
from logscope.operators import errors, filters, ranking, summary
from logscope.sources.files import file_listing, read_lines

#: Files that a plan names one by one, at most; beyond that all are scanned.
NAMED = 10_000
_LISTED = ["file", "size", "modified"]


@dataclass(frozen=True)
class FileIndex:
    """The index of the files under ``paths``, kept in the folder ``location``."""

    spark: SparkSession
    paths: str | list[str]
    location: str

    # -- tables ----------------------------------------------------------------------

    def _stored(self, name: str) -> DataFrame | None:
        """The last version of a table, if there is one."""
        try:
            versions = self.spark.read.parquet(f"{self.location}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        last = versions.agg(F.max("version")).first()[0]
        return versions.where(F.col("version") == last)

    def table(self, name: str, facts: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``file, size, modified`` and the columns of ``facts`` (made of lines, for each ``file`` by itself) as of now."""
        now, old = file_listing(self.spark, self.paths), self._stored(name)
        if old is None:
            kept, files = None, None
        else:
            fresh = [r["file"] for r in now.join(old, _LISTED, "left_anti").select("file").limit(NAMED + 1).collect()]
            gone = old.join(now, _LISTED, "left_anti").isEmpty()
            if not fresh and gone:
                return old.drop("version", "part")
            kept, files = old.drop("version", "part").join(now, _LISTED, "left_semi"), fresh
            if len(fresh) > NAMED:
                kept, files = None, None
        found = now.join(facts(read_lines(self.spark, self.paths, files)), "file", "left")
        if kept is not None:
            found = found.where(F.col("file").isin(files)).unionByName(kept)
        version = 1 + (0 if old is None else old.first()["version"])
        found.withColumns({"version": F.lit(version), "part": F.lit(uuid.uuid4().hex)}).write.mode("append").partitionBy("version").parquet(f"{self.location}/{name}")
        return self._stored(name).drop("version", "part")

    def times(self, ts_profile: str = "rich", year: int | None = None) -> DataFrame:
        """Per file: ``lines``, ``untimed`` lines without a readable timestamp, ``first`` and ``last`` second."""
        def facts(lines: DataFrame) -> DataFrame:
            read = computed(lines.select("file", "line"), ts=extract_ts(F.col("line"), ts_profile, year))
            read = read.select("file", F.unix_seconds(to_ts(F.col("ts"), year)).alias("at"))
            return read.groupBy("file").agg(
                F.count("*").alias("lines"), F.count_if(F.col("at").isNull()).alias("untimed"), F.min("at").alias("first"), F.max("at").alias("last")
            )

        return self.table(f"times-{ts_profile}-{year or 'now'}", facts)

    def statistics(self) -> DataFrame:
        """``file_statistics`` of all lines, of which new and changed files alone are read."""
        return self.table("statistics", summary.file_statistics).drop("size", "modified").where("total_lines is not null")

    def rollup(self) -> DataFrame:
        """Counts per file and, with a NULL file, over all files."""
        names = ["total_lines", "error_count", "warning_count", "info_count"]
        return self.statistics().rollup("file").agg(*[F.sum(c).alias(c) for c in names])

    def unique_errors(self, threshold: int = 1) -> DataFrame:
        """``unique_errors`` of all lines, from the messages of each file."""
        counted = self.table("unique-errors", errors.messages_by_file).where("message is not null")
        messages = counted.groupBy("message").agg(F.sum("occurrences").alias("occurrences")).where(F.col("occurrences") >= threshold)
        return messages.select("occurrences", "message").orderBy(F.desc("occurrences"), F.desc("message"))

    def counts(self, log: LogFrame) -> DataFrame:
        """Per file: ``n`` lines that pass the filters of a view."""
        def facts(lines: DataFrame) -> DataFrame:
            return filters.passed(lines, *log.tests).where("passed").groupBy("file").agg(F.count("*").alias("n"))

        return self.table(f"view-{_name(log)}", facts).withColumn("n", F.coalesce("n", F.lit(0)))

    # -- windows ---------------------------------------------------------------------

    def files_between(self, start: str | None, end: str | None, ts_profile: str = "rich", year: int | None = None) -> list[str] | None:
        """The files that may have lines in a window; None if they are too many to be named.

        Lines without a readable timestamp are in every window, and so are the files that have any.
        """
        first, last = filters.window_bounds(start, end, year)
        meets = (F.col("untimed") > 0) | ((F.col("last") >= first) & (F.col("first") <= last))
        named = [r["file"] for r in self.times(ts_profile, year).where(meets).select("file").limit(NAMED + 1).collect()]
        return named if len(named) <= NAMED else None

    def between(self, log: LogFrame, start: str | None = None, end: str | None = None, ts_profile: str = "rich", year: int | None = None) -> LogFrame:
        """``log.between`` (on instants) over the files that may have lines in the window."""
        files = self.files_between(start, end, ts_profile, year)
        return self._only(log, files).between(start, end, "instant", ts_profile, year)

    def _only(self, log: LogFrame, files: list[str] | None) -> LogFrame:
        return replace(log, lines=read_lines(self.spark, self.paths, files))

    # -- positions -------------------------------------------------------------------

    def page(self, log: LogFrame, number: int, size: int = ranking.PAGE_SIZE) -> DataFrame:
        """As ``log.page``."""
        first = self._total(log).select(
            ((F.least(F.lit(max(number, 1)), F.greatest(F.lit(1), F.ceil(F.col("total") / size))) - 1) * size + 1).cast("bigint").alias("first")
        ).first()[0]
        return self._at(log, list(range(first, first + size)))

    def sample(self, log: LogFrame) -> DataFrame:
        """As ``log.sample``."""
        total, step = self._total(log).select("total", ranking.sample_step(F.col("total")).cast("bigint")).first()
        return self._at(log, list(range(step, total + 1, step)))

    def _total(self, log: LogFrame) -> DataFrame:
        return self.counts(log).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def _at(self, log: LogFrame, wanted: list[int]) -> DataFrame:
        """The rows of a view at ``wanted`` positions (some hundred at most), from the files that hold them."""
        places = ranking.running(self.counts(log).where("n > 0").select("file", "n"))
        holds: Column = F.exists(F.array(*[F.lit(p).cast("bigint") for p in wanted]), lambda p: (p > F.col("before")) & (p <= F.col("before") + F.col("n")))
        files = places.where(holds).orderBy("file").collect() if wanted else []
        view = self._only(log, [r["file"] for r in files]).view
        # positions among these files alone, and what to add for those left out
        local, add, before = [], [], 0
        for r in files:
            local += [p - r["before"] + before for p in wanted if r["before"] < p <= r["before"] + r["n"]]
            add.append(F.struct(F.lit(r["file"]).alias("file"), F.lit(r["before"] - before).cast("bigint").alias("add")))
            before += r["n"]
        if not files:
            return view.limit(0).select(F.lit(0).cast("bigint").alias("position"), *view.columns)
        rows = ranking.at_positions(view, local)
        offsets = F.map_from_entries(F.array(*add))
        return rows.withColumn("position", F.col("position") + F.element_at(offsets, F.col("file")))


def _name(log: LogFrame) -> str:
    """A name of a view's filters."""
    return hashlib.sha256("\n".join(str(t) for t in log.tests).encode()).hexdigest()[:32]
