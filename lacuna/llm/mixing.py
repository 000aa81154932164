"""Mixing sources to target weights by a Pfair schedule, in DataFrame functions only.

Each source is cut into blocks of equal bytes. Block ``j`` of a source with weight ``w`` may not run before
slot ``floor(j / w)`` (its release) and has to run before slot ``ceil((j + 1) / w)`` (its deadline); of the
released blocks the earliest deadline runs. After every slot each source has had its weight's share to less
than one block.

Weights are exact fractions, never rounded, so this holds against the targets over the whole mixture. The schedule
is worked out once, for as many slots as the mixture has, or as the weights' period where that is shorter: a slot
for each block of bytes, never one for each row. A block has ``BLOCK_BYTES``, or the mixture's bytes by ``MOST_SLOTS``
where that is more: the schedule is no longer for a larger mixture, and the bound of one block holds for these blocks.
Every block finds its slot by a join with it.

The mixture is as long as the source that fills its share last needs: no document is dropped. The others
begin again (``epoch`` 1, 2 and so on), until that source has run once.

Without given weights a source gets its share of all bytes to the power 0.7, so that small sources count more.

Defined cases: a null source is a source of its own; null texts have no bytes and take the block of their
place. Order within a source is by a hash of the id, then the id; repeated rows follow each other. Empty
tables give empty results. Sources without a target weight take no part when weights are given.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush, heapreplace
from itertools import count, islice
from math import gcd, lcm
from sys import maxsize

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

BLOCK_BYTES, ALPHA, MOST_SLOTS = 1 << 16, 0.7, 1 << 20
#: Slots in a row of the schedule's table.
CHUNK = 1024


def dealt(shares: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) for ever: source ``i`` has the weight ``shares[i] / sum(shares)``."""
    total = sum(shares)
    window = lambda i, j: (j * total // shares[i], -(-(j + 1) * total // shares[i]), i, j)
    waiting = [window(i, 0) for i in range(len(shares))]  # the next block of each source: all are released at slot 0
    ready: list[tuple[int, int, int]] = []
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            _, deadline, i, j = heapreplace(waiting, window(waiting[0][2], waiting[0][3] + 1))
            heappush(ready, (deadline, i, j))
        deadline, i, j = heappop(ready)
        if slot >= deadline:
            raise AssertionError("no block may miss its deadline")
        yield i, j, slot


def frame(shares: list[int]) -> list[tuple[int, int, int]]:
    """(source, block, slot) of one period: source ``i`` has ``shares[i]`` of the ``sum(shares)`` slots."""
    return list(islice(dealt(shares), sum(shares)))


def shares_of(weights: dict) -> dict:
    """Whole numbers in the exact proportion of the weights; a float is the decimal number it is written as."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    unit = lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * unit) for k, w in exact.items()}
    return {k: w // gcd(*whole.values()) for k, w in whole.items()}


def schedule(shares: list[int], blocks: list[int]) -> list[array]:
    """For each source the slots of its blocks, until each has come to its last block or a period is over."""
    slots, short = [array("q") for _ in shares], len(shares)
    for i, _, slot in islice(dealt(shares), sum(shares)) if sum(shares) <= maxsize else dealt(shares):
        slots[i].append(slot)
        short -= len(slots[i]) == blocks[i]
        if not short:
            break
    return slots


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_bytes: int = BLOCK_BYTES, alpha: float = ALPHA, most_slots: int = MOST_SLOTS) -> DataFrame:
    """Rows (id, source, epoch, block, slot, place): ``place`` orders the rows of a slot. Read by (slot, place)."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), size.alias("_n")).withColumn("_h", F.xxhash64("_id"))
    sizes = rows.groupBy("_s").agg(F.sum("_n").alias("n"), F.count("*").alias("rows")).collect()  # a row for each source
    sizes = {r["_s"]: (r["n"], r["rows"]) for r in sizes if weights is None or weights.get(r["_s"], 0) > 0}
    if not sizes:
        return rows.where(F.lit(False)).select(F.col("_id").alias(id_col), F.col("_s").alias(source_col), *(F.lit(0).cast("long").alias(k) for k in ("epoch", "block", "slot", "place")))
    share = shares_of({s: weights[s] if weights else max(n, 1) ** alpha for s, (n, _) in sizes.items()})
    whole = max(-(-n * sum(share.values()) // share[s]) for s, (n, _) in sizes.items())  # bytes of the mixture
    block_bytes = max(block_bytes, -(-whole // most_slots))
    blocks = {s: max(1, -(-n // block_bytes)) for s, (n, _) in sizes.items()}
    names = sorted(sizes, key=lambda s: (s is not None, str(s)))
    slots = schedule([share[s] for s in names], [blocks[s] for s in names])
    width = sum(map(len, slots))
    # The mixture ends with the slot in which the last source comes to its last block for the first time.
    end = 1 + max((blocks[s] - 1) // len(at) * width + at[(blocks[s] - 1) % len(at)] for s, at in zip(names, slots, strict=True))
    rest = [bisect_left(at, end % width) for at in slots]
    kind = docs.schema[source_col].dataType.simpleString()
    of = spark.createDataFrame([(i, s, len(slots[i]), blocks[s], end // width * len(slots[i]) + rest[i]) for i, s in enumerate(names)], f"_k int, _s {kind}, _a long, _b long, _want long")
    chunks = [(i, c, at[c * CHUNK : (c + 1) * CHUNK].tolist()) for i, at in enumerate(slots) for c in range(-(-len(at) // CHUNK))]
    plan = spark.createDataFrame(chunks, "_k int, _c long, _slots array<long>")  # 8 bytes for each slot, of which there are MOST_SLOTS and one for each source at most
    of = F.broadcast(of.withColumnRenamed("_s", "_name"))
    rows = rows.join(of, F.col("_s").eqNullSafe(F.col("_name")))
    # Bytes before a row in its source: sums over hash ranges, then inside one range; a hot source has as many
    # ranges as its rows ask for.
    most = max(r for _, r in sizes.values())
    ranges = int(min(1 << 20, max(64, most // 5_000)))
    rows = rows.withColumn("_g", F.floor((F.shiftrightunsigned("_h", 1)) / F.lit((1 << 63) / ranges)).cast("int"))
    sums = rows.groupBy("_k", "_g").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_g", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_k", "_g").orderBy(F.shiftrightunsigned("_h", 1), "_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sums, ["_k", "_g"])
    rows = rows.withColumn("_pos", F.col("_base") + F.col("_in")).withColumn("_block", F.least(F.floor(F.col("_pos") / block_bytes), F.col("_b") - 1))
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_want") - 1 - F.col("_block")) / F.col("_b")))))
    rows = rows.withColumn("_turn", F.col("_block") + F.col("_epoch") * F.col("_b"))
    rows = rows.withColumn("_j", F.col("_turn") % F.col("_a")).withColumn("_c", F.floor(F.col("_j") / CHUNK)).join(F.broadcast(plan), ["_k", "_c"])
    slot = F.floor(F.col("_turn") / F.col("_a")) * F.lit(width) + F.get("_slots", (F.col("_j") % CHUNK).cast("int"))
    return rows.select(F.col("_id").alias(id_col), F.col("_s").alias(source_col), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), slot.alias("slot"), F.col("_pos").alias("place"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture, each as often as its epochs say; any columns are carried along.

    A null source is a source of its own; rows without a text or an id take part like others. Rows that share an id
    share its hash and so its places, and each of them goes with some of the id's places. The files that are written
    from this hold the rows in the mixture's order.
    """
    plan = mix(docs).select(F.col("doc_id").alias("id"), "slot", "place")
    nth = lambda key, *by: F.row_number().over(Window.partitionBy(key).orderBy(*by))
    times = plan.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "place"))).alias("at"))
    same = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text", "source").alias("h"))
    same = same.withColumn("nth", nth("of", "h")).withColumn("rows", F.count("*").over(Window.partitionBy("of")))
    out = same.join(times, same["of"].eqNullSafe(times["id"])).withColumn("at", F.filter("at", lambda x, i: i % F.col("rows") == F.col("nth") - 1))
    out = out.withColumn("x", F.explode("at"))
    return out.repartitionByRange(F.col("x.slot"), F.col("x.place")).sortWithinPartitions("x.slot", "x.place").select("row.*")
