"""Contiguous shards of nearly equal bytes, cut where global prefix sums pass equal targets.

Rows are sorted by ranges of id, size and text hash. Each range's total gives the bytes before the ranges after it, a running
sum inside the range the bytes before each row, and a row goes to the shard its middle byte falls in. No more than a
total for each range and each shard is gathered in one place, and rows of one id, or of none, fill as many ranges as they ask for.

Defined cases: null text has no bytes, and every row weighs ``overhead`` besides. A null id comes first. Rows
with one id order by size and text hash; rows equal in all that are alike. Empty tables give empty results.
Other columns are carried along; :func:`shard` replaces ``shard`` and ``slot`` where they exist, and
:func:`shard_documents` also ``size`` and ``text_crc32``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_buckets, running, table

SHARDS, OVERHEAD = 24, 8


def shard(rows: DataFrame, key: str, size: str, n_shards: int = SHARDS, tie: str | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (place in the shard, from 0), by the long column ``size``."""
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    # Whole rows travel as one column, so that no working column meets one of theirs.
    rows = rows.select(F.struct(*kept).alias("row"), F.col(key).alias("key"), F.col(size).alias("size"), (F.col(tie) if tie else F.lit(0)).alias("tie"))
    all_ = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).head()
    rows = running(rows, [F.col("key").asc_nulls_first(), F.col("size"), F.col("tie")], "size", n_buckets(all_["n"], 50_000))
    middle = F.col("_sum") + F.col("size") / 2
    rows = rows.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, all_["b"] or 0)))).cast("int")).withColumn("rank", F.col("_place"))
    first = rows.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return rows.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their size, text_crc32, shard and slot; columns the caller does not select are not shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("size", (F.octet_length(text) + overhead).cast("long")).withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))
    return shard(rows, id_col, "size", n_shards, "text_crc32")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = r"""
WITH k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1) AS bytes FROM documents),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM b, k),
o AS (SELECT *, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total, row_number() OVER w AS r FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
s AS (SELECT *, least(23, floor((before + size / 2) * 24 / total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, 'bytes' AS law, NULL::INT AS grown_shard FROM s
"""
