"""Repair of conversation structure: the cheapest edits by a dynamic programme over scalar integers.

The rows of a conversation, in order, and the roles seen so far (none, s, u, ua) span an acyclic graph whose edges are
the edits. The weight of a path is one integer: its high digits are the cost, its low digits the audit letters, one of
three bits each from the left, with zeros behind the last. Letters are made from the end of a conversation to its
start, so an edit adds its cost, moves the letters behind it one place down and sets the first. Integers then order as
(cost, audit) does, and the least integer decides everything.

No conversation is held by a task. Rows are sorted by ranges and numbered, and cut into blocks of neighbouring numbers;
a segment is what a block holds of a conversation. First each segment gives the least costs between the four states,
which one pass from last to first adds up to the cost of what follows each segment. With that as the high digits at its
end, a segment's integers are decided alone: two paths through its rows differ in a letter before either ends, since
insertions belong to the row behind them. A pass from first to last then picks the entry state of each segment. What these
passes carry has a fixed size; only the audit, which is a value of the result, and the running hash see a whole conversation.

Defined results: a null role or text is one space, also in the key of the damage; a null conv_id is a conversation of
its own, null turns come first; rows of one turn are taken by role, then text; a role that starts with none of s, u and
a (or is empty) cannot be kept; equal rows (conversation, turn, role, text) travel as one with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions.staged import computed
from logscope.llm import common

#: Neighbouring rows of a block: 2 to this power. The integers of a segment have some 9 bits a row.
BLOCK_BITS = 10
BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Digits of the letters, in the order of the letters.
LETTERS = "\0DIKR"
D, I, K, R = range(1, 5)
#: States: nothing yet, s, ...u, ...ua. What an inserted or renamed role leads to, and what a kept one does.
STATES = range(4)
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FINAL = {0: 0, 3: 0}
_NEVER = 1 << 62


# -- rows ------------------------------------------------------------------------------------


def _damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n): the rows that are left, with how often each stands there."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    left = computed(rows.select("conv_id", "turn", "role", "text"), hit=hit).where("hit <> 0")
    return left.select(
        _key(F.col("conv_id")).alias("conv"), "turn",
        F.when(F.col("hit") == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text")).alias("text"),
        F.when(F.col("hit") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def ordered(left: DataFrame) -> DataFrame:
    """Rows with their faults and a number ``at`` that ascends in their order, written."""
    left = left.withColumns({"_a": F.xxhash64(F.lit(1), "text"), "_b": F.xxhash64(F.lit(2), "text")})
    merged = left.groupBy("conv", "turn", "role", "text", "_a", "_b").agg(F.sum("n").alias("n"))
    seen = left.groupBy("conv", "role", "_a", "_b").agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("bare"))
    rows = merged.join(seen, ["conv", "role", "_a", "_b"]).drop("_a", "_b")
    said = F.btrim("text", F.lit(BLANKS))
    again = F.when(F.col("bare"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    rows = rows.withColumns({"blank": said == "", "truncated": ~F.substring(said, -1, 1).isin(".", "!", "?")}).withColumn(
        "duplicate", ~F.col("blank") & again
    ).withColumn("forced", F.col("blank") | F.col("duplicate"))
    order = ["conv", "turn", "role", "text"]
    sorted_ = rows.select(*order, "n", "blank", "duplicate", "forced", (~F.col("forced") & F.col("truncated")).alias("truncated"))
    at = F.monotonically_increasing_id()
    placed = sorted_.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    return common.written(placed.withColumn("block", F.shiftright("at", BLOCK_BITS)), "turns")


# -- integers --------------------------------------------------------------------------------


class Weights:
    """Integers of a cost and up to ``width`` letters behind it."""

    def __init__(self, width: int):
        self.low = 3 * width
        self.mask = (1 << self.low) - 1
        self.first = [letter << max(self.low - 3, 0) if width else 0 for letter in range(5)]

    def of(self, cost: int) -> int:
        return cost << self.low

    def prepend(self, weight: int, cost: int, letter: int) -> int:
        return ((weight >> self.low) + cost << self.low) + self.first[letter] + ((weight & self.mask) >> 3)

    def letters(self, weight: int) -> str:
        digits = weight & self.mask
        out = []
        for at in range(self.low - 3, -1, -3):
            letter = digits >> at & 7
            if not letter:
                break
            out.append(LETTERS[letter])
        return "".join(out)

    def inserted(self, here: list[int]) -> list[int]:
        """The least of going on here and of one or two insertions before; more would come back to a state."""
        once = [min(here[q], self.prepend(here[NEXT[q]], INSERT, I)) for q in STATES]
        return [min(here[q], self.prepend(once[NEXT[q]], INSERT, I)) for q in STATES]

    def row(self, after: list[int], initial: str, forced: bool, truncated: bool) -> list[int]:
        """The least weight from each state before a row to the end, by those behind it."""
        here = [self.prepend(w, DELETE, D) for w in after]
        if not forced:
            extra = TRUNCATED if truncated else 0
            kept = KEPT.get(initial, (None,) * 4)
            for q in STATES:
                here[q] = min(here[q], self.prepend(after[NEXT[q]], REROLE + extra, R))
                if kept[q] is not None:
                    here[q] = min(here[q], self.prepend(after[kept[q]], KEEP + extra, K))
        return self.inserted(here)

    def end(self) -> list[int]:
        return self.inserted([self.of(FINAL.get(q, _NEVER)) for q in STATES])


def through(rows: list[tuple], audit: str, state: int) -> int:
    """The state behind ``rows`` (initial, ...) after these edits."""
    rows = iter(rows)
    for letter in audit:
        if letter != "I":
            initial = next(rows)[0]
        if letter == "K":
            state = KEPT[initial][state]
        elif letter in "IR":
            state = NEXT[state]
    return state


# -- segments --------------------------------------------------------------------------------

_NARROW = ["initial", "forced", "truncated"]


def _segments(table: pa.Table, columns: list[str]) -> Iterator[tuple[str, list[tuple], int]]:
    """The conversations of a block, sorted by ``at``, with their rows and where they start."""
    values = list(zip(*[table.column(c).to_pylist() for c in columns]))
    convs = table.column("conv").to_pylist()
    start = 0
    for at in range(1, len(convs) + 1):
        if at == len(convs) or convs[at] != convs[start]:
            yield convs[start], values[start:at], start
            start = at


def _costs(table: pa.Table) -> pa.Table:
    """Per segment the least cost from each state before it to each state behind it."""
    table, plain, out = table.sort_by("at"), Weights(0), {"conv": [], "block": [], "costs": []}
    for conv, rows, _ in _segments(table, _NARROW):
        matrix = [0] * 16
        for e in STATES:
            ahead = [0 if q == e else _NEVER for q in STATES]
            for row in reversed(rows):
                ahead = plain.row(ahead, *row)
            for q in STATES:
                matrix[4 * q + e] = min(ahead[q], _NEVER)
        out["conv"].append(conv)
        out["block"].append(table.column("block")[0].as_py())
        out["costs"].append(matrix)
    return pa.table(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows with whether their conversation starts here."""
    conv = None
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv"] != conv, row
            conv = row["conv"]


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


_AHEAD = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("ahead", pa.list_(pa.int64())), ("last", pa.bool_()), ("total", pa.int64())])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from a conversation's last to its first: the least cost of what follows, from each state."""
    def rows():
        ahead = []
        for new, row in _streamed(batches):
            if new:
                ahead = Weights(0).end()
            m = row["costs"]
            before = [min(_NEVER, min(m[4 * q + e] + ahead[e] for e in STATES)) for q in STATES]
            yield {"conv": row["conv"], "block": row["block"], "ahead": ahead, "last": new, "total": before[0]}
            ahead = before

    return _batched(rows(), _AHEAD)


_DECIDED = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())),
])


def _decide(table: pa.Table) -> pa.Table:
    """Per segment and state before it the letters of the least integer, and the state behind it."""
    table, out = table.sort_by("at"), []
    for conv, rows, start in _segments(table, _NARROW):
        ahead, last, total = (table.column(c)[start].as_py() for c in ("ahead", "last", "total"))
        weights = Weights(3 * len(rows) + 2)
        least = weights.end() if last else [weights.of(a) for a in ahead]
        for row in reversed(rows):
            least = weights.row(least, *row)
        audits = [weights.letters(w) for w in least]
        out.append({"conv": conv, "block": table.column("block")[start].as_py(), "total": total, "audits": audits,
                    "ends": [through(rows, a, q) for q, a in enumerate(audits)]})
    return pa.Table.from_pylist(out, _DECIDED)


_CHOSEN = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("audit", pa.string()), ("state", pa.int64()), ("total", pa.int64())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from a conversation's first to its last: the state before each, and its letters from there."""
    def rows():
        state = 0
        for new, row in _streamed(batches):
            state = 0 if new else state
            yield {"conv": row["conv"], "block": row["block"], "audit": row["audits"][state], "state": state, "total": row["total"] if new else 0}
            state = row["ends"][state]

    return _batched(rows(), _CHOSEN)


_PIECES = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("audit", pa.string()), ("repaired", pa.string()),
    ("illegal", pa.int64()), ("first", pa.string()), ("final", pa.string()),
])


def _repair(table: pa.Table) -> pa.Table:
    """Per segment the repaired rows as text (null: none), the audit with a D for each further equal row, and illegal neighbours."""
    table, out = table.sort_by("at"), []
    for conv, rows, start in _segments(table, ["initial", "role", "text", "n"]):
        edits, state, total = (table.column(c)[start].as_py() for c in ("audit", "state", "total"))
        audit, lines, left = [], [], iter(rows)
        for letter in edits:
            initial, role, text, n = ("", "", "", 1) if letter == "I" else next(left)
            audit.append(letter + "D" * (n - 1))
            total += DELETE * (n - 1)
            if letter in "IR":
                state = NEXT[state]
                role = "assistant" if state == 3 else "user"
            elif letter == "K":
                state = KEPT[initial][state]
            if letter != "D":
                lines.append(f"{role}:{text}")
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append({
            "conv": conv, "block": table.column("block")[start].as_py(), "total": total, "audit": "".join(audit),
            "repaired": "\n".join(lines) if lines else None, "illegal": pairs + sum(r[3] - 1 for r in rows), "first": rows[0][0], "final": rows[-1][0],
        })
    return pa.Table.from_pylist(out, _PIECES)


_RESULT = pa.schema([("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation, in order, added up and hashed as they come."""
    def rows():
        held = None
        for new, row in _streamed(batches):
            if new:
                if held:
                    yield finished(held)
                held = {"conv": row["conv"], "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False}
            elif held["final"] + row["first"] not in ("su", "ua", "au"):
                held["illegal"] += 1
            held["final"] = row["final"]
            held["illegal"] += row["illegal"]
            held["cost"] += row["total"]
            held["audit"].append(row["audit"])
            if row["repaired"] is not None:
                held["hash"].update((("\n" if held["any"] else "") + row["repaired"]).encode())
                held["any"] = True
        if held:
            yield finished(held)

    def finished(held):
        return {**{k: held[k] for k in ("conv", "illegal", "cost")}, "audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}

    return _batched(rows(), _RESULT, 100)


def _per_block(rows: DataFrame, apply: Callable, schema: str) -> DataFrame:
    return rows.groupBy("block").applyInArrow(apply, schema)


def _per_conversation(rows: DataFrame, apply: Callable, schema: str, last_first: bool = False) -> DataFrame:
    order = F.desc("block") if last_first else F.asc("block")
    return rows.repartition("conv").sortWithinPartitions("conv", order).mapInArrow(apply, schema)


def turn_repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text) that are left as they are: faults, cost, audit and hash of the repair.

    ``rows``: (conv, turn, role, text, n), ``conv`` a name, ``n`` how often the row stands there.
    """
    turns = ordered(rows)
    initial = F.substring("role", 1, 1).alias("initial")
    narrow = turns.select("conv", "block", "at", initial, "forced", "truncated")
    costs = _per_block(narrow, _costs, "conv string, block long, costs array<long>")
    ahead = _per_conversation(costs, _backward, "conv string, block long, ahead array<long>, last boolean, total long", last_first=True)
    decided = _per_block(narrow.join(ahead, ["conv", "block"]), _decide, "conv string, block long, total long, audits array<string>, ends array<long>")
    chosen = _per_conversation(decided, _forward, "conv string, block long, audit string, state long, total long")
    whole = turns.select("conv", "block", "at", initial, "role", "text", "n").join(chosen, ["conv", "block"])
    pieces = _per_block(whole, _repair, "conv string, block long, total long, audit string, repaired string, illegal long, first string, final string")
    done = _per_conversation(pieces, _join_up, "conv string, illegal long, cost long, audit string, repaired_sha256 string")

    def times(fault: str, n: Column) -> Column:
        return F.sum(F.when(F.col(fault), n).otherwise(0))

    counts = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        times("blank", F.col("n")).cast("long").alias("blank"),
        # All equal rows but the first are duplicates of it, blank ones aside.
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - 1 + F.col("duplicate").cast("long"))).cast("long").alias("duplicate"),
        times("truncated", F.lit(1)).cast("long").alias("truncated"),
    )
    return counts.join(done, "conv")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = turn_repair(_damage(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(done, "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: Rows are numbered from 1; ``f`` holds per state the least of cost (nine digits) and letters, from the last row to the first.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
hit AS (SELECT *, xor(r, 4294967295) % 20 AS h FROM base),
left_over AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM left_over),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before, trim(text, E' \t\n\x0b\f\r') AS said FROM numbered),
rows AS (
  SELECT *, said = '' AS blank, said <> '' AND again AS duplicate, said <> '' AND NOT again AND said[-1:] NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN said = '' OR again THEN '' ELSE role[1:1] END AS initial, said = '' OR again AS forced FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
f AS (
  SELECT conv_id, n AS i, '000000000' AS f0, '000000004II' AS fs, '000000002I' AS fu, '000000000' AS fa FROM counts
  UNION ALL
  SELECT conv_id, i - 1,
    least(h0, printf('%09d', hu[:9]::INT + 2) || 'I' || hu[10:], printf('%09d', ha[:9]::INT + 4) || 'II' || ha[10:]),
    least(hs, printf('%09d', hu[:9]::INT + 2) || 'I' || hu[10:], printf('%09d', ha[:9]::INT + 4) || 'II' || ha[10:]),
    least(hu, printf('%09d', ha[:9]::INT + 2) || 'I' || ha[10:], printf('%09d', hu[:9]::INT + 4) || 'II' || hu[10:]),
    least(ha, printf('%09d', hu[:9]::INT + 2) || 'I' || hu[10:], printf('%09d', ha[:9]::INT + 4) || 'II' || ha[10:])
  FROM (
    SELECT f.conv_id, f.i,
      least(printf('%09d', f0[:9]::INT + 3) || 'D' || f0[10:], CASE WHEN NOT forced THEN printf('%09d', fu[:9]::INT + 2 + t) || 'R' || fu[10:] END,
        CASE initial WHEN 's' THEN printf('%09d', fs[:9]::INT + t) || 'K' || fs[10:] WHEN 'u' THEN printf('%09d', fu[:9]::INT + t) || 'K' || fu[10:] END) AS h0,
      least(printf('%09d', fs[:9]::INT + 3) || 'D' || fs[10:], CASE WHEN NOT forced THEN printf('%09d', fu[:9]::INT + 2 + t) || 'R' || fu[10:] END,
        CASE initial WHEN 'u' THEN printf('%09d', fu[:9]::INT + t) || 'K' || fu[10:] END) AS hs,
      least(printf('%09d', fu[:9]::INT + 3) || 'D' || fu[10:], CASE WHEN NOT forced THEN printf('%09d', fa[:9]::INT + 2 + t) || 'R' || fa[10:] END,
        CASE initial WHEN 'a' THEN printf('%09d', fa[:9]::INT + t) || 'K' || fa[10:] END) AS hu,
      least(printf('%09d', fa[:9]::INT + 3) || 'D' || fa[10:], CASE WHEN NOT forced THEN printf('%09d', fu[:9]::INT + 2 + t) || 'R' || fu[10:] END,
        CASE initial WHEN 'u' THEN printf('%09d', fu[:9]::INT + t) || 'K' || fu[10:] END) AS ha
    FROM f JOIN (SELECT *, truncated::INT AS t FROM rows) r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i)),
best AS (SELECT conv_id, f0[:9]::BIGINT AS cost, f0[10:] AS audit FROM f WHERE i = 0),
letters AS (
  SELECT b.conv_id, j, b.audit[j:j] AS letter, length(replace(b.audit[:j], 'I', '')) AS i, length(replace(b.audit[:j], 'D', '')) AS o,
    length(replace(b.audit, 'D', '')) % 2 AS s FROM best b, range(1, length(b.audit) + 1) x(j)),
lines AS (
  SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j) AS repaired
  FROM letters l LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id
"""
