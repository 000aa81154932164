"""Daily snapshots as files that are written once, plain or sealed.

A day's file is a folder of parts named after the day: ``2026-09-21.csv.gz`` (plain) or ``2026-09-21.jsonl.gz.enc``
(sealed). The first writer of a day claims it by creating a file exclusively, stages the day's parts under another
name, and puts them in place by one rename; whoever comes later leaves the day as it is.

A sealed file holds blocks. A block is a gzip member without a time over JSON lines in a fixed order, so equal rows give
equal plain bytes; it is encrypted and authenticated (AES-GCM) together with its day, its number, the number of the
day's blocks and the hash of its plain bytes. A changed, moved or missing block raises. Files are decrypted in memory.
"""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import ranked
from .shared import hadoop, materialize

PLAIN, SEALED = ".csv.gz", ".jsonl.gz.enc"
#: Rows of a block, and the columns that stay outside of the rows.
BLOCK_ROWS, DAY = 20_000, "snapshot_date"


# --- days that are written once --------------------------------------------------------------------------------------


def claimed(spark: SparkSession, path: str, day: str) -> bool:
    """Whether this call is the one that gets the day: a file is created exclusively."""
    fs, at = hadoop(spark, f"{path}/_claims/{day}")
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":  # whose Hadoop client looks first and creates then
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def release(spark: SparkSession, path: str, day: str) -> None:
    """Give up a claim, as that of a writer that died before its day was in place."""
    fs, at = hadoop(spark, f"{path}/_claims/{day}")
    fs.delete(at, False)


def abandoned(spark: SparkSession, path: str, name: Callable[[str], str]) -> list[str]:
    """Days that are claimed and not in place: being written, or left by a writer that died."""
    fs, at = hadoop(spark, f"{path}/_claims")
    days = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(d for d in days if not d.startswith(".") and not fs.exists(hadoop(spark, f"{path}/{name(d)}")[1]))


def write_once(rows: DataFrame, path: str, name: Callable[[str], str], stage: Callable[[DataFrame, str], None]) -> list[str]:
    """Write the days of ``rows`` that nobody has claimed, each by one rename; returns them.

    ``stage`` writes rows below a folder, a day's parts in ``_day=<day>``; ``name`` is a day's name in ``path``.
    """
    spark = rows.sparkSession
    days = sorted(str(r[0]) for r in rows.select(DAY).where(f"{DAY} is not null").distinct().collect())  # a row for each day
    held = {d for d in days if hadoop(spark, f"{path}/{name(d)}")[0].exists(hadoop(spark, f"{path}/{name(d)}")[1])}
    mine = [d for d in days if d not in held and claimed(spark, path, d)]
    if not mine:
        return []
    hidden, placed = f"{path}/_staged/{uuid.uuid4().hex}", []
    fs, at = hadoop(spark, hidden)
    try:
        stage(rows.where(F.col(DAY).cast("string").isin(mine)), hidden)
        for d in mine:
            if not fs.rename(hadoop(spark, f"{hidden}/_day={d}")[1], hadoop(spark, f"{path}/{name(d)}")[1]):
                raise OSError(f"{d} could not be put in place")
            placed.append(d)
    finally:
        for d in set(mine).difference(placed):
            release(spark, path, d)
        fs.delete(at, True)
    return placed


def by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_day", F.col(DAY).cast("string"))


def write_table(rows: DataFrame, path: str) -> list[str]:
    """Days of a Parquet table partitioned by day."""
    stage = lambda some, to: by_day(some).drop(DAY).write.partitionBy("_day").parquet(to)
    return write_once(rows, path, lambda d: f"{DAY}={d}", stage)


def write_plain(rows: DataFrame, path: str) -> list[str]:
    """Days as gzipped CSV with a header."""
    stage = lambda some, to: by_day(some).drop(DAY).write.partitionBy("_day").option("header", True).option("compression", "gzip").csv(to)
    return write_once(rows, path, lambda d: d + PLAIN, stage)


# --- sealed files --------------------------------------------------------------------------------------------------------


def _with_key(rows: DataFrame, key: str) -> DataFrame:
    """The key beside each row as data, so that no plan or log shows it."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(key,)], "_key string")))  # one row


def _bound() -> Column:
    """What a block is authenticated with."""
    return F.concat_ws(":", "_day", "block", "blocks", "sha256")


def sealed_blocks(rows: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(_day, block, blocks, sha256, value): the lines of sealed files. Rows are ordered within a day by all their columns."""
    columns = sorted(c for c in rows.columns if c != DAY)
    lines = by_day(rows).select("_day", F.to_json(F.struct(*columns)).alias("line"))
    lines = ranked(materialize(lines, "lines"), [F.col("_day"), F.col("line")], "_at")
    days = lines.groupBy("_day").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each day
    lines = lines.join(F.broadcast(days), "_day").withColumn("block", F.floor((F.col("_at") - F.col("_first")) / block_rows)).withColumn("blocks", F.ceil(F.col("_n") / block_rows))
    texts = lines.groupBy("_day", "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("x"))  # block_rows of each
    texts = texts.select("_day", "block", "blocks", F.concat(F.array_join("x.line", "\n"), F.lit("\n")).alias("text")).withColumn("sha256", F.sha2("text", 256))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(gz=[gzip.compress(t.encode(), mtime=0) for t in batch["text"]])

    packed = _with_key(texts.mapInPandas(squeeze, "_day string, block long, blocks long, sha256 string, gz binary"), key)
    token = F.aes_encrypt("gz", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), _bound())
    return packed.select("_day", "block", "blocks", "sha256", F.concat_ws(":", _bound(), F.translate(F.base64(token), "\r\n", "")).alias("value"))


def write_sealed(rows: DataFrame, path: str, key: str, block_rows: int = BLOCK_ROWS, manifest: str | None = None) -> list[str]:
    """Days as sealed files; ``manifest``: a table to which (day, sha256) of each day's plain bytes is appended."""

    def stage(some: DataFrame, to: str) -> None:
        blocks = materialize(sealed_blocks(some, key, block_rows), "sealed")
        blocks.select("_day", "value").write.partitionBy("_day").text(to)
        if manifest:
            whole = blocks.groupBy(F.col("_day").alias("day")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("block", "sha256")))["sha256"], ""), 256).alias("sha256"))  # 32 bytes for each block
            whole.write.mode("append").parquet(manifest)

    return write_once(rows, path, lambda d: d + SEALED, stage)


def _or_raise(ok: Column, value: Column, message: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message).cast("string"))


def read_sealed(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of all sealed days below ``path`` with their day. Raises where a block is damaged, moved or missing."""
    return sealed_rows(spark.read.text(f"{path}/*{SEALED}").select("value", F.col("_metadata.file_path").alias("_file")), key, schema)


def sealed_rows(lines: DataFrame, key: str, schema: str) -> DataFrame:
    part = F.split("value", ":")
    head = {"_day": part[0], "block": part[1].cast("long"), "blocks": part[2].cast("long"), "sha256": part[3], "token": F.unbase64(part[4])}
    named = F.regexp_extract("_file", r"(\d{4}-\d{2}-\d{2})[^/]*/[^/]*$", 1)
    lines = lines.select(*(c.alias(k) for k, c in head.items()), named.alias("_named"))
    # As many different blocks in each day's file as each of them says.
    whole = lines.groupBy("_named").agg(F.countDistinct("block").alias("_have"), F.max("blocks").alias("_want"), F.min("blocks").alias("_least"), F.max("block").alias("_last"), F.count("*").alias("_all"))
    good = (F.col("_have") == F.col("_want")) & (F.col("_least") == F.col("_want")) & (F.col("_all") == F.col("_want")) & (F.col("_last") == F.col("_want") - 1)
    whole = whole.select(F.col("_named").alias("_file_day"), _or_raise(good, F.lit("whole"), F.concat(F.lit("blocks are missing in the file of "), "_named")).alias("_state"))
    lines = lines.join(F.broadcast(whole), F.col("_named") == F.col("_file_day")).where("_state = 'whole'")  # a row for each day
    lines = lines.withColumn("_day", _or_raise(F.col("_day") == F.col("_named"), F.col("_day"), F.concat(F.lit("a block of another day in the file of "), "_named")))
    opened = _with_key(lines, key).select("_day", "sha256", F.aes_decrypt("token", "_key", F.lit("GCM"), F.lit("DEFAULT"), _bound()).alias("gz"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="gz").assign(text=[gzip.decompress(g).decode() for g in batch["gz"]])

    texts = opened.mapInPandas(unpack, "_day string, sha256 string, text string")
    texts = texts.withColumn("text", _or_raise(F.sha2("text", 256) == F.col("sha256"), F.col("text"), F.lit("a block's plain bytes do not have its hash")))
    rows = texts.select("_day", F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line"))
    return rows.select(F.from_json("line", schema).alias("x"), F.col("_day").cast("date").alias(DAY)).select("x.*", DAY)


def read_plain(spark: SparkSession, path: str, schema: str) -> DataFrame:
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})[^/]*\.csv\.gz(?:/[^/]*)?$", 1).cast("date")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(f"{path}/*{PLAIN}").withColumn(DAY, day)


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, day, sealed) of all days' files below ``path``, plain or sealed."""
    fs, at = hadoop(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    found = [(n, n[:10], n.endswith(SEALED)) for n in names if n.endswith((PLAIN, SEALED))]
    return spark.createDataFrame(found, "name string, day string, sealed boolean").withColumn("day", F.col("day").cast("date"))


def read_days(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """The rows of all days below ``path``, plain and sealed ones alike; sealed ones need the key."""
    kinds = {r["sealed"] for r in data_files(spark, path).select("sealed").distinct().collect()}
    if True in kinds and not key:
        raise ValueError("sealed days need a key")
    out = spark.createDataFrame([], f"{schema}, {DAY} date")
    for sealed in sorted(kinds):
        out = out.unionByName(read_sealed(spark, path, key, schema) if sealed else read_plain(spark, path, schema))
    return out
