"""Best-fit packing of token sequences by length counts: large items matched in pairs, small ones best-fit.

A piece is a whole document of at most ``capacity`` tokens or a slice of a longer one. What a bin can hold
depends on lengths alone, and there are at most ``capacity`` of those, so the plan is made for the *counts* of
lengths and holds for any number of pieces:

1. A bin holds at most two pieces above a third of the capacity. From the longest down, each is matched with
   the longest other one that still fits.
2. Shorter pieces, longest first, go into the tightest gap that holds them, or into a new bin.

Equal steps are taken together for as many bins as they repeat in. The plan's rows say: pieces of length L
with ranks r to r + k - 1 go to bins s to s + k - 1 at offset o. Ranks come from counts for each length and
hash range, then a window inside one; a hot length has many ranges, so no task gets more than its range.

Defined cases: null text is the end id alone; repeated ids and rows are pieces of their own; an empty table
has no pieces. Other columns of the input play no part.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices, table
from .encoding import encoder

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first bin, offset) for all pieces; counts: pieces of each length.

    It runs over the distinct lengths, at most ``capacity`` of them, whatever the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of bins
    bins = 0

    def put(n: int, many: int, first: int, offset: int) -> None:
        out.append((n, used[n], many, first, offset))
        used[n] += many
        left[n] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == n and left[n] < 2 else 1):
                at -= 1
            mate = large[at] if at >= 0 else None
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, many, bins, 0)
            if mate is not None:
                put(mate, many, bins, n)
            room = capacity - n - (mate or 0)
            if room:
                gaps[room].append((bins, many))
            bins += many
    rooms = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, many = gaps[room].pop()
                if not gaps[room]:
                    rooms.pop(at)
                take = min(many, left[n])
                if take < many:
                    if not gaps[room]:
                        bisect.insort(rooms, room)
                    gaps[room].append((first + take, many - take))
            else:
                each = capacity // n
                take, room, first = -(-left[n] // each), capacity, bins
                bins += take
            put(n, take, first, capacity - room)
            if room > n:
                if not gaps[room - n]:
                    bisect.insort(rooms, room - n)
                gaps[room - n].append((first, take))
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", at_blanks: bool = True, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids as little-endian unsigned 32-bit integers."""
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]
    end = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, at_blanks)
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for doc, ids in zip(batch.column("id").to_pylist(), enc.ids(batch.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (length and any other columns, on storage that gives the same rows twice) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in cut.columns]
    # A length has as many hash ranges as its pieces ask for.
    ranges = cut.sparkSession.createDataFrame([(n, -(-k // 20_000)) for n, k in counts.items()], "length long, _pr long")
    rows = cut.join(F.broadcast(ranges), "length").withColumn("_pg", F.pmod(F.xxhash64(*order), F.col("_pr")).cast("int")).drop("_pr")
    sums = rows.groupBy("length", "_pg").agg(F.count("*").alias("_pn"))  # a row for each length and each 20,000 pieces
    before = Window.partitionBy("length").orderBy("_pg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_pg", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_pbase"))
    inside = Window.partitionBy("length", "_pg").orderBy(*order)
    rows = rows.withColumn("_pin", F.row_number().over(inside) - 1).join(sums, ["length", "_pg"]).withColumn("_rank", F.col("_pbase") + F.col("_pin"))
    steps = sorted(plan(counts, capacity))
    first = np.array([(s[0], s[1]) for s in steps], dtype=np.int64).reshape(-1, 2)
    shared = cut.sparkSession.sparkContext.broadcast((first[:, 0] * (1 << 44) + first[:, 1], np.array([(s[1], s[3], s[4]) for s in steps], dtype=np.int64).reshape(-1, 3)))
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, to = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            step = to[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(step[:, 1] + rank - step[:, 0]), pa.array(step[:, 2])], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)
    return rows.select(*kept, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack(materialize(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))
