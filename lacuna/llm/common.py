"""Helpers shared by the training-data operators: sizes, running sums in a global order, Arrow batches, hashes of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import ranked
from ..sources.shared import materialize, shared_dir, sweep

__all__ = ["SpanHashes", "flat_bytes", "hashes_of", "materialize", "mix", "n_buckets", "ranked", "running", "shared_dir", "slices", "sweep", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_buckets(total: int, each: int, least: int = 8) -> int:
    """Buckets of about ``each`` for a total that was counted over all rows."""
    return max(least, -(-int(total or 0) // each))


def running(df: DataFrame, order: list[Column], size: str, n: int) -> DataFrame:
    """``df`` with ``_place`` (from 0) and ``_sum`` (of the long column ``size``): the rows before each row in the order, and their sizes.

    One shuffle into ``n`` ranges of the order. A task carries its own running sums from batch to batch; those of the ranges
    before it come from a total for each range.
    """
    kept = df.columns

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = 0, 0
        for batch in batches:
            part = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = total + np.concatenate([[0], np.cumsum(part)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("_part"), pa.array(place + np.arange(len(part))), pa.array(sums[:-1])], names=[*kept, "_part", "_place", "_sum"])
            place, total = place + len(part), int(sums[-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _part int, _place long, _sum long"
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).mapInArrow(carry, schema)
    out = materialize(out, "running")  # once, so ranges stay as they are
    sizes = sorted((r["_part"], r["n"], r["b"]) for r in out.groupBy("_part").agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect())  # a row for each range
    bases, rows, total = [], 0, 0
    for p, many, b in sizes:
        bases.append((p, rows, total))
        rows, total = rows + many, total + (b or 0)
    base = df.sparkSession.createDataFrame(bases, "_of int, _rows long, _bytes long")
    out = out.join(F.broadcast(base), F.col("_part") == F.col("_of"))
    return out.withColumn("_place", F.col("_place") + F.col("_rows")).withColumn("_sum", F.col("_sum") + F.col("_bytes")).drop("_part", "_of", "_rows", "_bytes")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has about ``limit`` bytes in each, a longer value standing alone."""
    for batch in batches:
        values = batch.column(column)
        sizes = np.array([v if v is not None else 0 for v in pc.binary_length(values).to_pylist()], dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string column as one byte array and the offsets of its values; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] and len(column) else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


ROOT = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Powers that a worker keeps from one batch to the next.
_KEPT = 1 << 23


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size in _POWERS:
        return _POWERS[size]
    out = []
    for r in (ROOT, pow(ROOT, -1, 1 << 64)):
        step = np.full(size, r, dtype=np.uint64)
        step[0] = 1
        out.append(np.cumprod(step, dtype=np.uint64))
    if size <= _KEPT:
        _POWERS.clear()
        _POWERS[size] = tuple(out)
    return tuple(out)


class SpanHashes:
    """64-bit hashes of spans of a byte array, each from two prefix sums (a polynomial modulo 2**64 over mixed bytes)."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.sums[1:])

    @classmethod
    def over(cls, values: np.ndarray) -> SpanHashes:
        """Hashes of spans of a sequence of 64-bit hashes."""
        out = cls(np.empty(0, np.uint8))
        out.up, out.down = _powers(len(values) + 1)
        out.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * out.up[: len(values)], out=out.sums[1:])
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n])


#: Bytes of a text that are hashed at once.
HASHED = 2 << 20


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans, of a long text block by block; a span's hash does not depend on where it lies."""
    if len(data) <= 2 * HASHED:
        return SpanHashes(data).of(start, end)
    out, at = np.empty(len(start), dtype=np.uint64), 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, base + HASHED)))
        out[at:to] = SpanHashes(data[base : int(end[at:to].max())]).of(start[at:to] - base, end[at:to] - base)
        at = to
    return out
