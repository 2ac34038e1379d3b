"""Quality rules: decision lists learned by sequential covering.

Every document gets interpretable statistics, all by built-in expressions within its row. Rules that reject are learned
from the labelled documents that pass the base rules, one after another:

* *grow*: on two thirds of the labelled rows that no earlier rule covers, add the threshold condition with the greatest
  information gain, until the rule covers no good document or gain ends;
* *prune*: on the other third, cut the conjunction back to the prefix with the best (bad - good) / (bad + good);
* keep the rule if its precision there is high enough, and go on with the rows that it leaves.

All counts are Spark aggregates over all labelled rows: per statistic and threshold bin, so what comes to the driver
has a fixed size. The result is an ordered conditional expression (``case when ... then 1 when ... else null``).

Defined results: a null or blank text has no words, fails the base rules and is rejected; rows without labels of both
kinds give no rules, so that the base rules decide alone; repeated rows each give a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions.staged import computed
from logscope.llm import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
#: Threshold bins per statistic, rules at most, conditions per rule at most.
BINS, RULES, CONDITIONS = 32, 12, 3
#: A rule is kept if, of the held-out labelled rows that it covers, this share is bad, and so many are bad at least.
PRECISION, SUPPORT = 0.9, 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, as expressions over the statistics; a text without words has no shares (null).
TESTED = {
    "symbols_per_word": "try_divide(n_symbols, n_words)", "shouts_per_word": "try_divide(n_shouts, n_words)", "word_length": "try_divide(word_chars, n_words)",
    "repeat_share": "try_divide(n_repeat_words, n_words)", "dup_line_share": "try_divide(n_dup_lines, n_lines)", "distinct_share": "try_divide(n_distinct, n_words)",
    "words_per_line": "try_divide(n_words, n_lines)", "n_words": "double(n_words)",
}
_BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        tested = F.expr(TESTED[self.name])
        return tested > self.threshold if self.above else tested <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


def _count(text: Column, characters: str) -> Column:
    """How many of these ASCII characters a text holds."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def statistics(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (text, ...) with the statistics of each text, for a name clash in place of the old columns."""
    own = ("_text", "_words", "_lines", "_hashes", "_windows", "_sorted")
    made = (*BASE, "n_shouts", "n_lines", "n_distinct")
    docs = docs.drop(*[c for c in (*own, *made) if c != "text"])
    docs = computed(docs, _text=F.coalesce("text", F.lit("")))
    trimmed = F.btrim("_text", F.lit(_BLANKS))
    docs = computed(
        docs,
        _words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        _lines=F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""),
    )
    docs = computed(
        docs,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_symbols=_count(F.col("_text"), SYMBOLS),
        n_shouts=_count(F.col("_text"), "!"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _hashes=F.transform("_words", lambda w: F.xxhash64(w)),
    ).drop("_words", "_lines", "_text")
    last = F.size("_hashes") - (window - 1)
    docs = computed(
        docs,
        n_distinct=F.size(F.array_distinct("_hashes")).cast("long"),
        _windows=F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_hashes", i, window)))),
    ).drop("_hashes")
    docs = computed(docs, _sorted=F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )).drop("_windows")
    n, none = F.size("_sorted"), F.lit(None).cast("struct<x:bigint,i:int>")
    beside = F.zip_with(
        F.concat(F.array(none), F.slice("_sorted", 1, n - 1)), F.concat(F.slice("_sorted", 2, n - 1), F.array(none)),
        lambda a, b: F.struct(a["x"].alias("before"), b["x"].alias("after")),
    )
    places = F.sort_array(F.filter(F.zip_with(
        "_sorted", beside, lambda s, o: F.when((s["x"] == o["before"]) | (s["x"] == o["after"]), s["i"])
    ), lambda i: i.isNotNull()))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + window).alias("end"), (a["n"] + F.least(F.lit(window), i + window - a["end"])).alias("n")),
    )["n"]
    return computed(docs, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """How much a condition that keeps ``p`` bad and ``n`` good of ``p0`` and ``n0`` tells, weighted by the bad."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


class _Labelled:
    """The binned statistics of labelled rows, as a table; every question is one aggregate of a fixed size."""

    def __init__(self, rows: DataFrame):
        rows = rows.select("bad", "grow", *[F.expr(e).alias(k) for k, e in TESTED.items()])
        at = [i / BINS for i in range(1, BINS)]
        cuts = rows.agg(*[F.percentile_approx(k, at, 10_000).alias(k) for k in TESTED]).first()
        self.cuts = {k: sorted({float(x) for x in cuts[k] or [] if x is not None}) for k in TESTED}
        self.rows = rows

    def _bins(self) -> Column:
        """Per statistic its bin: the number of thresholds below its value."""
        def bin_of(k):
            return sum((F.when(F.col(k) > t, 1).otherwise(0) for t in self.cuts[k]), F.lit(0))
        return F.array(*[F.struct(F.lit(k).alias("name"), bin_of(k).alias("bin")) for k in TESTED])

    def prepare(self) -> None:
        self.rows = common.written(self.rows.withColumn("bins", self._bins()), "labelled")

    @staticmethod
    def _where(rule: list[Condition]) -> Column:
        ok = F.lit(True)
        for c in rule:
            ok = ok & (F.col(c.name) > c.threshold if c.above else F.col(c.name) <= c.threshold)
        return F.coalesce(ok, F.lit(False))

    def left(self, rules: list[list[Condition]]) -> DataFrame:
        rows = self.rows
        for rule in rules:
            rows = rows.where(~self._where(rule))
        return rows

    def histogram(self, rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
        counts = {k: [(0, 0)] * (len(self.cuts[k]) + 1) for k in TESTED}
        for r in (
            rows.select("bad", F.explode("bins").alias("b")).groupBy("b.name", "b.bin")
            .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("n")).collect()
        ):
            counts[r["name"]][r["bin"]] = (r["p"], r["n"] - r["p"])
        return counts

    def grow(self, rows: DataFrame) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < CONDITIONS:
            counts = self.histogram(rows.where(self._where(rule)))
            p0 = sum(p for p, _ in counts["n_words"])
            n0 = sum(n for _, n in counts["n_words"])
            if not p0 or not n0:
                break
            best = (0.0, None)
            for name, bins in counts.items():
                p = n = 0
                for (bp, bn), cut in zip(bins, self.cuts[name]):
                    p, n = p + bp, n + bn
                    best = max(best, (_gain(p0, n0, p, n), Condition(name, False, cut)), (_gain(p0, n0, p0 - p, n0 - n), Condition(name, True, cut)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def pruned(self, rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
        sums = rows.agg(*[
            F.coalesce(F.sum((self._where(rule[: k + 1]) & (F.col("bad") == bad)).cast("long")), F.lit(0)).alias(f"c{k}_{bad}")
            for k in range(len(rule)) for bad in (True, False)
        ]).first()
        tried = [(rule[: k + 1], sums[2 * k], sums[2 * k + 1]) for k in range(len(rule))]
        return max(tried, key=lambda x: ((x[1] - x[2]) / max(1, x[1] + x[2]), -len(x[0])))


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """The ordered rejecting rules. ``labelled``: statistics, ``doc_id`` and ``quality`` (0 is bad)."""
    data = _Labelled(labelled.where(~base_failed() & F.col("quality").isNotNull()).withColumns(
        {"bad": F.col("quality") == 0, "grow": F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0}
    ))
    data.prepare()
    rules: list[list[Condition]] = []
    while len(rules) < RULES:
        left = data.left(rules)
        rule = data.grow(left.where("grow"))
        if not rule:
            break
        rule, bad, good = data.pruned(left.where("NOT grow"), rule)
        if bad < SUPPORT or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
    return rules


def fired(rules: list[list[Condition]]) -> Column:
    """The decision list: the number of the first rule that holds, null if none does."""
    case = None
    for k, rule in enumerate(rules, start=1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        case = F.when(holds, k) if case is None else case.when(holds, k)
    return F.lit(None).cast("int") if case is None else case


def verdict(rules: list[list[Condition]]) -> Column:
    return ~base_failed() & fired(rules).isNull()


def _learned(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    return learn(stats.join(labels.select("doc_id", "quality"), "doc_id"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Condition]]]:
    """The statistics of ``docs`` (doc_id, text) with ``base_failed``, ``rule`` (the first that rejects) and ``kept``; and the rules."""
    stats = common.written(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    rules = _learned(stats, labels)
    return stats.withColumns({"base_failed": base_failed(), "rule": fired(rules), "kept": verdict(rules)}), rules


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected; their statistics are computed again beside the text, to spare a join."""
    _, rules = quality_rules(docs, labels)
    return statistics(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text")).where(verdict(rules)).select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    done, rules = quality_rules(docs, labels)
    return done.select("doc_id", *BASE, "base_failed", "kept", "rule")
