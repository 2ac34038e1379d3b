"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from logscope.sources.scratch import scratch_path

#: Text that one vectorised step holds at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and gives the planner its true size."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(table: DataFrame) -> None:
    """Deletes a table that ``written`` made, when all that was read from it is written itself."""
    spark: SparkSession = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if "/logscope-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, at least ``n``, of the hash base and of its inverse."""
    if "p" not in _POWERS or len(_POWERS["p"][0]) < n:
        size = max(n, 2 * STEP_BYTES)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS["p"] = tuple(made)
    return _POWERS["p"]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each pair; equal slices have equal hashes."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes, one row at least."""
    texts = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    total = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a line end behind each, and where each text starts (one more entry: the end)."""
    rows = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])
    return data, starts


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than blank and 0x09-0x0D."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each with one blank behind it, and where each starts (one more entry: the end)."""
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] = 1
    keep[ends + 1] -= 1
    out = data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out[at[1:] - 1] = 32
    return out.tobytes(), at


def bucket_count(docs: DataFrame, column: str, bytes_each: int) -> int:
    """Groups to deal messages into, so that the texts behind one group hold about ``bytes_each`` bytes."""
    from pyspark.sql import functions as F

    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // bytes_each + 1))


def dealt(keys: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket of ``keys``; each column as the bytes of its values in that bucket."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    ends = np.append(first[1:], len(at))
    arrays = [pa.array(found, pa.int64())]
    for values in columns.values():
        raw, size = np.ascontiguousarray(values[order]).tobytes(), values.dtype.itemsize
        arrays.append(pa.array([raw[a * size : b * size] for a, b in zip(first, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def gathered(table: pa.Table | pa.RecordBatch, columns: dict[str, type]) -> list[np.ndarray]:
    """The values of all rows of ``dealt`` batches, column by column."""
    return [
        np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype) for name, dtype in columns.items()
    ]


def slide(least, values: np.ndarray, width: int) -> np.ndarray:
    """``least`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = least(out[:-step], out[step:])
        done += step
    return out


def chosen(grams: np.ndarray, whole: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram is the least of some window of ``span`` grams that counts (``whole``); and each window's least."""
    least = slide(np.minimum, grams, span)[: len(whole)]
    pad = np.zeros(len(whole) + 2 * (span - 1), np.uint64)
    pad[span - 1 : span - 1 + len(whole)] = np.where(whole, least, np.uint64(0))
    most = slide(np.maximum, pad, span)
    return np.flatnonzero(most == grams[: len(most)]), least


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def spread(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the value at the start of its run."""
    return values[np.maximum.accumulate(np.where(marks, np.arange(len(marks)), 0))]
