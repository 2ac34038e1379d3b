"""Personal data by patterns, and by bootstrapped contextual extraction.

Each whole text is read once. The base patterns give the spans that are certain by their form. A wider pattern gives the
items of a text: what looks like an identifier or at least holds a digit or an @, with the words around it. Items whose form is
certain are seeds; items that hold an identifier written another way ("bob (at) example.org", 743 555 3824, 4111.1111...)
are candidates; the others only count against a context. Seeds induce lexical patterns: the word before, the two words
before, the words on either side. Patterns and instances (kind and value) make a graph that is scored in turns:

* a pattern's score for a kind is positive / (positive + negative + 1): the scores of its instances of the kind against
  known instances of other kinds and plain items; candidates not known yet count for neither; it needs ``SUPPORT`` positives;
* an instance's score is 1 for what some seed says too, else 1 less the product of what its patterns leave open; from
  ``THRESHOLD`` on it is known, counts for its patterns in the next turn, and all its occurrences become spans.

An instance counts once per context, so copies of documents add nothing. All is built-in expressions and joins; texts are
not shuffled, hot contexts are counted with partial aggregates, each turn is a table in the shared folder.

Defined results: a null or empty text has no spans; positions are code points, the end exclusive; spans added do not overlap
base ones; the counts ``n_email`` to ``n_phone`` are of base spans, ``n_added`` of the others; each row counts by itself, whatever its doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscope.functions.staged import computed
from logscope.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring at most, positives that a pattern needs, the score from which an instance is known.
ROUNDS, SUPPORT, THRESHOLD = 6, 3.0, 0.75
#: Characters beside an item that its context is read from.
BESIDE = 80

#: What the contract's patterns match, read once: a start within a run of their characters is not tried again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[(\[][aA][tT][)\]]\x20?)", r"(?:\.|\x20?[(\[](?:\.|[dD][oO][tT])[)\]]\x20?)"
_MAIL = rf"[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"
_ADDRESS = rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"
_NUMBER = r"[+(]{0,2}[0-9](?:[\x20()._/-]{0,2}[0-9]){9,18}+(?![0-9A-Za-z])"
#: What is taken from a text as an item, in this order at each place.
ITEM = rf"(?<![A-Za-z0-9._%+-]){_MAIL}|(?<![A-Za-z0-9.]){_ADDRESS}|(?<![A-Za-z0-9]){_NUMBER}|[0-9@][^\x20\x09-\x0D]*+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _n_digits(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


def _luhn(match: Column) -> Column:
    turned = F.reverse(_digits(match))

    def added(total: Column, place: Column) -> Column:
        x = F.substring(turned, place, F.lit(1)).cast("int")
        return total + F.when(place % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), added) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern of a kind counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    return _luhn(match) if kind == "card" else _n_digits(match, 10, 15)


# -- places ----------------------------------------------------------------------------------

_PIECE = 256


def _added_up(values: Column) -> Column:
    """For each of ``values`` (a column) the sum of those before it; in pieces, as arrays are copied when they grow."""
    def sums(array: Column, size) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(array, zero, lambda a, x: F.struct((a["sum"] + size(x)).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _PIECE).cast("int")), lambda p: F.slice(values, p * _PIECE + 1, _PIECE))
    within = F.transform(parts, lambda part: sums(part, lambda x: x))
    spread = F.zip_with(within, sums(within, lambda x: x["sum"])["before"], lambda part, before: F.transform(part["before"], lambda x: x + before))
    return F.when(F.size(values) > 0, F.flatten(spread)).otherwise(F.array().cast("array<bigint>"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, a column of spans per kind, items): per row of ``docs`` the base spans, and the items with their surroundings."""
    text = F.col("_text")
    has_digit = text.rlike("[0-9]")
    wanted = {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": has_digit, "phone": F.contains(text, F.lit("+")),
        "item": text.rlike(r"[0-9@]|[(\[][aA][tT][)\]]"),
    }
    patterns = {**BASE, "item": ITEM}
    none = F.array().cast("array<string>")
    rows = computed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), **{
        f"_{part}_{kind}": F.when(wanted[kind], make).otherwise(none) for kind, p in patterns.items() for part, make in (
            ("found", F.regexp_extract_all(text, F.lit(p), F.lit(0))), ("gaps", F.split(text, p, -1)),
        )
    }).drop("_text")
    rows = computed(rows, **{f"_size_{k}": F.zip_with(
        F.slice(f"_gaps_{k}", F.lit(1), F.size(f"_found_{k}")), f"_found_{k}", lambda gap, match: (F.length(gap) + F.length(match)).cast("long")
    ) for k in patterns})
    rows = computed(rows, **{f"_before_{k}": _added_up(F.col(f"_size_{k}")) for k in patterns})

    def place(kind: str, i: Column) -> Column:
        return F.get(f"_before_{kind}", i) + F.length(F.get(f"_gaps_{kind}", i))

    def spans(kind: str) -> Column:
        all_ = F.transform(f"_found_{kind}", lambda match, i: F.struct(place(kind, i).alias("start"), (place(kind, i) + F.length(match)).alias("end"), match.alias("match")))
        return F.transform(F.filter(all_, lambda s: _valid(kind, s["match"])), lambda s: F.struct(s["start"], s["end"]))

    items = F.transform("_found_item", lambda match, i: F.struct(
        place("item", i).alias("start"), (place("item", i) + F.length(match)).alias("end"), match.alias("match"),
        F.right(F.get("_gaps_item", i), F.lit(BESIDE)).alias("left"), F.left(F.get("_gaps_item", i + 1), F.lit(BESIDE)).alias("right"),
    ))
    done = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *[spans(k).alias(k) for k in KINDS], items.alias("items"))
    return common.written(done, "marked")


# -- the graph -------------------------------------------------------------------------------


def _word(found: Column) -> Column:
    return F.lower(F.regexp_replace(found, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of an item's place."""
    blank = r"[\x20\x09-\x0D]+"
    before = F.filter(F.transform(F.split(left, blank), _word), lambda w: w != "")
    after = F.filter(F.transform(F.split(right, blank), _word), lambda w: w != "")
    one, two, next_ = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2), F.get(after, F.lit(0))
    return F.array_compact(F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), next_)))


def occurrences(marks: DataFrame) -> DataFrame:
    """Each item with its kind (null: a plain one), whether it is a seed, its value, and its contexts."""
    rows = marks.select("row", F.inline("items"))
    m = F.col("match")
    mail = m.rlike(f"^{_MAIL}$")
    plain = F.lower(F.regexp_replace(F.regexp_replace(m, rf"^([A-Za-z0-9._%+-]+){_AT}", "$1@"), _DOT, "."))
    address = F.regexp_replace(m, _DOT, ".")
    is_address = m.rlike(f"^{_ADDRESS}$") & _valid("ip", address)
    number = m.rlike(f"^{_NUMBER}$")
    kind = (
        F.when(mail, "email").when(is_address, "ip").when(number & _n_digits(m, 14, 19) & _luhn(m), "card").when(number & _n_digits(m, 10, 15), "phone")
    )
    seed = reduce(lambda a, b: a | b, [(F.col("kind") == k) & m.rlike(f"^{BASE[k]}$") for k in KINDS])
    rows = computed(rows, kind=kind, contexts=_contexts(F.col("left"), F.col("right"))).drop("left", "right")
    value = F.when(F.col("kind") == "email", plain).when(F.col("kind") == "ip", address).when(F.col("kind").isNotNull(), _digits(m)).otherwise(F.lower(m))
    return common.written(rows.select("row", "start", "end", "kind", F.coalesce(seed, F.lit(False)).alias("seed"), value.alias("value"), "contexts"), "items")


def _patterns(links: DataFrame) -> DataFrame:
    """(context, kind, confidence) of the patterns with enough support, by the scores of their instances."""
    sums = links.groupBy("context").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS],
        F.sum(F.when(F.col("kind").isNull(), 1.0).otherwise(0.0)).alias("plain"),
    )
    every = reduce(lambda a, b: a + b, [F.col(k) for k in KINDS], F.col("plain"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("positive"), (F.col(k) / (every + 1)).alias("confidence")) for k in KINDS])
    return sums.select("context", F.inline(each)).where(F.col("positive") >= SUPPORT).drop("positive")


def discovered(items: DataFrame) -> DataFrame:
    """(kind, value, score) of the instances that become known, other than those of seeds alone."""
    same = ["kind", "value"]
    seeds = items.where("seed").select(*same).distinct()
    links = items.select(*same, F.explode("contexts").alias("context")).distinct()
    links = common.written(links.join(seeds.withColumn("base", F.lit(1.0)), same, "left").withColumn("base", F.coalesce("base", F.lit(0.0))), "links")
    open_ = links.where("kind IS NOT NULL AND base = 0").drop("base")
    known, before = None, None
    for _ in range(ROUNDS):
        scored = links.withColumn("score", F.col("base")) if known is None else links.join(known, same, "left").withColumn(
            "score", F.greatest("base", F.coalesce("score", F.lit(0.0)))
        )
        score = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        reached = open_.join(_patterns(scored), ["context", "kind"]).groupBy(*same).agg(score.alias("score")).where(F.col("score") >= THRESHOLD)
        known = common.written(reached, "known")
        state = tuple(known.agg(F.count("*"), F.sum(F.round("score", 6))).first())
        if state == before:
            break
        before = state
    return known.unionByName(seeds.withColumn("score", F.lit(1.0)))


def added(marks: DataFrame, items: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the spans of known instances that are no base spans and overlap none."""
    found = items.where("NOT seed AND kind IS NOT NULL").join(discovered(items).select("kind", "value"), ["kind", "value"], "left_semi").select("row", "kind", "start", "end")
    found = common.written(found, "found")
    beside = marks.join(found.select("row").distinct(), "row", "left_semi").select("row", F.inline(F.concat(*KINDS)))
    both = found.unionByName(beside.withColumn("kind", F.lit(None).cast("string")))
    base = F.col("kind").isNull()
    order = Window.partitionBy("row").orderBy("start")
    ends = F.max(F.when(base, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(base, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    clear = (F.coalesce(ends, F.lit(0)) <= F.col("start")) & (F.coalesce(starts, F.col("end")) >= F.col("end"))
    return both.withColumn("clear", clear).where("clear AND kind IS NOT NULL").drop("clear")


def private_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``base`` and ``found`` (added ones), arrays of (start, place of the kind, kind, end)."""
    marks = marked(docs)
    more = added(marks, occurrences(marks)).groupBy("row").agg(
        F.collect_list(F.struct("start", _place(F.col("kind")).alias("at"), "kind", "end")).alias("found")
    )

    def own(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("at"), F.lit(kind).alias("kind"), s["end"]))

    base = marks.select("row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(F.concat(*[own(k) for k in KINDS])).alias("base"))
    return base.join(more, "row", "left").withColumn("found", F.coalesce("found", F.expr("filter(base, x -> false)"))).drop("row")


def _place(kind: Column) -> Column:
    return reduce(lambda a, k: a.when(kind == k, KINDS.index(k)), KINDS[1:], F.when(kind == KINDS[0], 0))


def _written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = private_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written_out(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_added"),
    )
