"""Stack traces of input that never ends.

Lines come in order, file by file, in batches that may end anywhere. The open record of a file is its state: the place and the
lines so far. The next head or any line that is no continuation closes it; so does a timer, for files that fall
silent. Records that begin and end within the lines that a task reads together, a *stretch*, are written there, by any number of
tasks. Only what may reach over the ends of a stretch goes to the task that holds the state of a file: the
continuations at its beginning, the line that ends them and the record that is open at its end. How many lines come at once is set at
the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logscope.functions.staged import computed
from logscope.operators.formats import REGISTRY
from logscope.operators.records import CONTINUATION

RECORD = "file string, head_no bigint, n_lines bigint, head string, stacktrace string"
#: A file that has shown no record yet, or none open, has the head number 0.
_STATE = "head_no bigint, last_no bigint, head string, lines array<string>"
_NO_RECORD = (0, 0, "", [])


def _closed(file: str, state: tuple) -> dict:
    head_no, _, head, lines = state
    return {"file": file, "head_no": head_no, "n_lines": 1 + len(lines), "head": head, "stacktrace": "\n".join(lines)}


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait_ms: int | None) -> Iterator[pd.DataFrame]:
    """The records that the new lines of a file close."""
    (file,) = key
    held, done = state.get if state.exists else _NO_RECORD, []
    if state.hasTimedOut:
        if held[0]:
            done.append(_closed(file, held))
        state.remove()
    else:
        held = (*held[:3], list(held[3]))
        rows = pd.concat(list(batches)).sort_values("line_no", kind="stable")
        for line_no, kind, line in zip(rows["line_no"].tolist(), rows["kind"].tolist(), rows["line"].tolist()):
            head_no, last_no, head, lines = held
            if kind == "at" and head_no and line_no == last_no + 1:
                lines.append(line)
                held = (head_no, line_no, head, lines)
                continue
            if head_no:
                done.append(_closed(file, held))
            held = (line_no, line_no, line, []) if kind == "head" else _NO_RECORD
        state.update(held)
        if wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
    yield pd.DataFrame(done, columns=["file", "head_no", "n_lines", "head", "stacktrace"])


def _stretches(batch: pa.RecordBatch):
    """The lines of a batch by file and number; where heads and continuations are; per line where its stretch starts and ends, lines without a gap."""
    table = pa.Table.from_batches([batch]).sort_by([("file", "ascending"), ("line_no", "ascending")])
    file = table.column("file").combine_chunks().dictionary_encode()
    file = np.asarray(file.indices.fill_null(-1))
    number, kind = np.asarray(table.column("line_no")), np.asarray(table.column("kind"), object)
    new = np.ones(len(number), bool)
    new[1:] = (file[1:] != file[:-1]) | (number[1:] != number[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(number))
    which = np.cumsum(new) - 1
    return table, kind == "head", kind == "at", starts[which], ends[which]


def _next(marks: np.ndarray) -> np.ndarray:
    """For each place the first marked one from there on, or the number of places."""
    places = np.where(marks, np.arange(len(marks)), len(marks))
    return np.minimum.accumulate(places[::-1])[::-1]


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that a stretch holds whole, with the line that ends them."""
    for batch in batches:
        table, head, at, _, ends = _stretches(batch)
        after = np.append(_next(~at), len(at))
        first = np.flatnonzero(head)
        stop = after[first + 1]
        whole = stop < ends[first]
        first, stop = first[whole], stop[whole]
        text = table.column("line").combine_chunks()
        traces = ["\n".join(text[a + 1 : b].to_pylist()) for a, b in zip(first.tolist(), stop.tolist())]
        own = table.take(pa.array(first))
        yield from pa.table({
            "file": own.column("file"), "head_no": own.column("line_no"), "n_lines": pa.array(stop - first, pa.int64()), "head": own.column("line"),
            "stacktrace": pa.array(traces, pa.string()),
        }).combine_chunks().to_batches()


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a stretch that may belong to a record beyond it: those up to its first line that is no continuation, and an open record."""
    for batch in batches:
        table, head, at, starts, ends = _stretches(batch)
        places = np.arange(len(at))
        lead = np.append(_next(~at), len(at))[starts]
        # of the lines from the last one on that is no continuation, those of a head
        last = np.maximum.accumulate(np.where(at, -1, places))
        last = last[ends - 1] if len(at) else last
        is_open = (last >= starts) & head[last]
        keep = (places <= lead) | is_open & (places >= last)
        # a head whose record ends in the stretch only ends what comes before it
        done = pa.array(head & ~(is_open & (places == last)))
        for name, value in (("kind", "other"), ("line", None)):
            table = table.set_column(table.column_names.index(name), name, pc.if_else(done, pa.scalar(value, pa.string()), table.column(name)))
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()


def _split(records: DataFrame) -> DataFrame:
    regex = REGISTRY["java_stacktrace"].regex
    return records.select(
        "file", "head_no", "n_lines", F.regexp_extract("head", regex, 1).alias("exception"), F.regexp_extract("head", regex, 2).alias("message"), "stacktrace"
    )


def stream_stacktraces(lines: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """Closed records of a stream of lines (``file, line_no, line``), for output mode append; columns as ``stacktrace_records``.

    ``line_no`` are the numbers of all lines of a file, 1 by 1. With ``wait_ms`` a record closes when its file has shown nothing for
    so long; else what is open at the end stays in the checkpoint (``open_records``).
    """
    line = F.col("line")
    kind = F.when(line.rlike(REGISTRY["java_stacktrace"].regex), "head").when(line.rlike(CONTINUATION), "at").otherwise("other")
    marked = computed(lines.select("file", "line_no", "line"), kind=kind)
    # the text of other lines decides nothing
    marked = marked.withColumn("line", F.when(F.col("kind") != "other", line))

    def advance(key, batches, state):
        return _advance(key, batches, state, wait_ms)

    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    over = marked.mapInArrow(_outer, marked.schema).groupBy("file").applyInPandasWithState(advance, RECORD, _STATE, "append", timeout)
    return _split(marked.mapInArrow(_inner, RECORD).unionByName(over))


def open_records(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The records that are open in a checkpoint, as far as they have come."""
    state = spark.read.format("statestore").load(checkpoint).select("key.*", "value.groupState.*").where("head_no > 0")
    return _split(state.select("file", "head_no", (F.size("lines") + 1).cast("bigint").alias("n_lines"), "head", F.array_join("lines", "\n").alias("stacktrace")))
