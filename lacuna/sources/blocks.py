"""A crawl index in compressed blocks, found through a sparse index of their first keys.

An index is a folder of shard files, each a run of gzip members (blocks) of sorted lines ``urlkey timestamp json``, and a
sparse index with a line for each block: its first key and time, then the shard, the block's offset and its length.
Records of a domain have keys that begin with its reversed labels (``org,example``) and ``)`` or ``,``.

A lookup of many prefixes joins them as of the sparse index (the last block that begins below a prefix may hold its first
records), and reads the bytes of the blocks found, and no others.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.order import asof, ranked
from .shared import materialize, opened

#: Bytes of neighbouring blocks that are read at once, records of a block, and how hard blocks are compressed.
READ_BYTES, PER_BLOCK, LEVEL = 1 << 20, 3000, 6
INDEX = "cluster.idx"


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(key, shard, offset, length) of each block; lines without a tab are no entries."""
    part = F.split("value", "\t")
    rows = spark.read.text(f"{path}/{INDEX}").where(F.contains("value", F.lit("\t")))
    return rows.select(F.substring_index("value", " ", 1).alias("key"), part[1].alias("shard"), part[2].cast("long").alias("offset"), part[3].cast("long").alias("length"))


def blocks_for(sparse: DataFrame, prefixes: DataFrame, most: int | None = None) -> DataFrame:
    """(prefix, block, shard, offset, length): the blocks that can hold records of each prefix, ``most`` of each at most.

    From the last block whose key is below the prefix to the last one that begins within it. Blocks are numbered from 1
    in the order of their keys.
    """
    numbered = materialize(ranked(sparse, [F.col("key"), F.col("shard"), F.col("offset")], "block"), "blocks")
    firsts = numbered.groupBy("key").agg(F.max("block").alias("block"))  # of blocks with one first key the last
    starts = asof(prefixes.select("prefix").distinct().withColumn("key", F.col("prefix")), firsts, "key", "below").select("prefix", F.coalesce("below.block", F.lit(1).cast("long")).alias("a"))
    ends = asof(starts.withColumn("key", F.concat("prefix", F.lit("~"))), firsts, "key", "within", strict=False)
    last = F.greatest(F.col("a"), F.coalesce("within.block", F.lit(1).cast("long")))
    last = last if most is None else F.least(last, F.col("a") + most - 1)
    return ends.select("prefix", F.explode(F.sequence("a", last)).alias("block")).join(numbered.drop("key"), "block")


def read_blocks(found: DataFrame, path: str) -> DataFrame:
    """(prefix, block, line_no, line) of the records of each prefix in the blocks ``found`` for it. Each block is read once.

    Neighbouring blocks go to one task and are read together. Bytes that are no UTF-8 are replaced.
    """

    def lines(b: dict, data: bytes) -> pd.DataFrame:
        wanted, head, ends, out = set(b["prefixes"]), None, [], []
        for no, line in enumerate(zlib.decompress(data, 16 + zlib.MAX_WBITS).decode("utf-8", "replace").splitlines()):
            key = line.split(" ", 1)[0]
            host, bracket, _ = key.partition(")")
            if (host, bracket) != head:  # neighbours often have one host
                head, ends = (host, bracket), [host[:i] for i, c in enumerate(host) if c == "," and host[:i] in wanted] + [host] * (bool(bracket) and host in wanted)
            out += [(p, b["block"], no, line) for p in ends]
        return pd.DataFrame(out, columns=["prefix", "block", "line_no", "line"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = opened(path)
        pending: list[dict] = []

        def flush() -> Iterator[pd.DataFrame]:
            first, last = pending[0], pending[-1]
            with fs.open_input_file(f"{folder}/{first['shard']}") as f:
                data = f.read_at(last["offset"] + last["length"] - first["offset"], first["offset"])
            for b in pending:  # the text of one block at a time
                yield lines(b, memoryview(data)[b["offset"] - first["offset"] :][: b["length"]])
            pending.clear()

        for batch in batches:
            for row in batch.to_dict("records"):
                if pending and (row["shard"] != pending[-1]["shard"] or row["offset"] != pending[-1]["offset"] + pending[-1]["length"] or row["offset"] + row["length"] - pending[0]["offset"] > READ_BYTES):
                    yield from flush()
                pending.append(row)
        if pending:
            yield from flush()

    once = found.groupBy("block", "shard", "offset", "length").agg(F.collect_set("prefix").alias("prefixes"))  # the prefixes of one block
    return once.repartitionByRange("block").sortWithinPartitions("block").mapInPandas(read, "prefix string, block long, line_no int, line string")


def domain_records(spark: SparkSession, path: str, prefixes: DataFrame, limit: int | None = None, most_blocks: int | None = None) -> DataFrame:
    """(prefix, urlkey, timestamp, url, status, mime) of the records below each of ``prefixes``, in the order of the index.

    At most ``limit`` of each prefix, counted before any filter; lines whose JSON is damaged are left out.
    """
    rows = read_blocks(blocks_for(read_sparse(spark, path), prefixes, most_blocks), path)
    record = F.from_json(F.regexp_extract("line", r"(?s)^\S+ \S+ (.*)$", 1), "url string, status string, mime string, _damaged string", {"columnNameOfCorruptRecord": "_damaged"})
    rows = rows.withColumn("r", record).where(F.col("r._damaged").isNull() & F.col("r").isNotNull())
    if limit is not None:
        place = Window.partitionBy("prefix").orderBy("block", "line_no")
        rows = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit)
    part = F.split("line", " ", 3)
    return rows.select("prefix", part[0].alias("urlkey"), part[1].alias("timestamp"), "r.url", "r.status", "r.mime", "block", "line_no")


def pages_of(spark: SparkSession, path: str, prefixes: DataFrame, per_domain: int = 25, most_blocks: int | None = None) -> DataFrame:
    """(prefix, url): of the first ``4 * per_domain`` records of each prefix the first ``per_domain`` that are fetched pages."""
    from .readers import page

    rows = domain_records(spark, path, prefixes, 4 * per_domain, most_blocks).where(page())
    place = Window.partitionBy("prefix").orderBy("block", "line_no")
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= per_domain).select("prefix", "url")


def write_blocks(records: DataFrame, path: str, per_block: int = PER_BLOCK) -> None:
    """An index from (urlkey, timestamp, url, status, mime): a shard for each range of keys, and the sparse index, sorted.

    A repeated task writes the same bytes under the same name; its entries count once, with the task that ends.
    """
    line = F.concat_ws(" ", "urlkey", "timestamp", F.to_json(F.struct("url", "status", "mime")))
    order = ["urlkey", "timestamp", "url"]
    rows = records.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "urlkey", "timestamp", line.alias("line"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = opened(path)
        fs.create_dir(folder, recursive=True)
        out, name, hidden, at, held, entries = None, "", "", 0, [], []

        def close_block() -> None:
            nonlocal at
            data = gzip.compress("".join(x + "\n" for _, x in held).encode(), LEVEL, mtime=0)
            out.write(data)
            entries.append((held[0][0], name, at, len(data)))
            at += len(data)
            held.clear()

        for batch in batches:
            for part, key, time, text in zip(batch["part"], batch["urlkey"], batch["timestamp"], batch["line"], strict=True):
                if out is None:
                    name = f"cdx-{part:05d}.gz"
                    hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(hidden, compression=None)
                held.append((f"{key} {time}", text))
                if len(held) == per_block:
                    close_block()
        if held:
            close_block()
        if out is not None:
            out.close()
            fs.move(hidden, f"{folder}/{name}")
        yield pd.DataFrame([("\t".join(map(str, e)),) for e in entries], columns=["value"])

    entries = rows.mapInPandas(write, "value string")
    entries.coalesce(max(1, min(32, records.sparkSession.sparkContext.defaultParallelism))).write.text(f"{path}/{INDEX}")
