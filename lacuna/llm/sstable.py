"""Token ids in sorted-string-table shards: documents keyed by identifier, found by binary search.

A shard is a run of blocks, then a sparse index, a Bloom filter and a footer:

* key: 9 bytes, 0 for a null id or 1, then the id with its sign bit flipped, big-endian: bytes order as ids do;
* entry: bytes shared with the key before it, bytes not shared, length of the value (variable-length integers),
  the key's other bytes, the value: ids as little-endian unsigned integers of 2 bytes, or 4 if the vocabulary is
  larger;
* block: entries up to about ``block_bytes``; its first entry shares nothing;
* index: for each block the first key, its offset and size (9, 8 and 4 bytes);
* Bloom filter: 10 bits for a document and 7 probes from two halves of blake2b(key);
* footer of 48 bytes: index offset, blocks, filter offset, documents, tokens (8 bytes each), width (4), ``LSS1``.

Shards hold consecutive ranges of ids, so the manifest's first and last ids lead to one shard, its index to one
block: :func:`lookup` reads the footer, the filter, the index and that block alone. Each shard is written by one
task under a temporary name and moved when whole; a range with more than ``ROLL_BYTES`` of ids, as where many rows
share one id, has several. The manifest lists what counts.

Defined cases: null text is empty and has the end id alone. A null id comes first. Rows with one id follow
each other in order of their text's hash, and a lookup returns all of them. Empty tables have an empty manifest.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_buckets, shared_dir, slices, table
from .encoding import encoder
from .files import Whole, opened

MAGIC, FOOTER, BLOCK_BYTES = b"LSS1", struct.Struct("<QQQQQi4s"), 1 << 16
INDEX = struct.Struct("<9sQI")
#: Bytes of text that a shard takes, about, and bytes of a file from which on another one begins.
SHARD_BYTES, ROLL_BYTES = 24 << 20, 256 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(7)]


class Writer:
    def __init__(self, folder: str, name: str, width: int, block_bytes: int = BLOCK_BYTES):
        self.file, self.width, self.block_bytes = Whole(folder, name), width, block_bytes
        self.index, self.keys, self.block, self.last = [], [], bytearray(), b""
        self.docs = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += varint(shared) + varint(9 - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append(INDEX.pack(self.first, self.file.size, len(self.block)))
            self.file.write(bytes(self.block))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at = self.file.size
        self.file.write(b"".join(self.index))
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(-(-bits // 8) * 8, dtype=np.uint8)
        for key in self.keys:
            bloom[probes(key, bits)] = 1
        filter_at = self.file.size
        self.file.write(struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes())
        self.file.write(FOOTER.pack(index_at, len(self.index), filter_at, self.docs, self.tokens, self.width, MAGIC))
        self.file.commit()


class Shard:
    """A shard, read by ``read(offset, size)`` of a file of ``size`` bytes: its footer and index at once, the rest when asked for."""

    def __init__(self, read: Callable[[int, int], memoryview], size: int):
        self.read, self.size = read, size
        self.index_at, n, self.filter_at, self.docs, self.tokens, self.width, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index = read(self.index_at, n * INDEX.size)
        self.blocks = [INDEX.unpack_from(index, i * INDEX.size) for i in range(n)]

    @classmethod
    def of(cls, data) -> Shard:
        """A shard that lies in memory."""
        view = memoryview(data).cast("B")
        return cls(lambda at, size: view[at : at + size], len(view))

    def may_hold(self, doc_id: int | None) -> bool:
        held = self.read(self.filter_at, self.size - FOOTER.size - self.filter_at)
        (bits,) = struct.unpack_from("<Q", held, 0)
        return all(held[8 + p // 8] >> (p % 8) & 1 for p in probes(key_of(doc_id), bits))

    def entries(self, at: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, key, at, end = memoryview(self.read(at, size)), b"", 0, size
        while at < end:
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            length, at = read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + more])
            at += more
            yield key, np.frombuffer(data[at : at + length], dtype=f"<u{self.width}")
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, size in self.blocks:
            for key, ids in self.entries(at, size):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that identifier: a binary search for the block, then its entries in order."""
        key, out = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return out
        firsts = [b[0] for b in self.blocks]
        for _, at, size in self.blocks[max(0, bisect.bisect_left(firsts, key) - 1) :]:
            for k, ids in self.entries(at, size):
                if k == key:
                    out.append(ids)
                elif k > key:
                    return out
        return out


def write_tables(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", at_blanks: bool = False, width: int = 2, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the shards and return the manifest, which is stored beside them: (shard, number, file, first_id, last_id, docs, tokens, bytes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).head()[0]
    n = n_buckets(total or 0, shard_bytes, 1)
    # Ranges of id and text hash, so that rows of one id, or of none, fill as many shards as they ask for.
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, shard, number = encoder(vocabulary, at_blanks), None, None, 0
        done = []

        def finish():
            writer.close()
            done.append((shard, number, writer.file.name, id_of(writer.keys[0]), id_of(writer.keys[-1]), writer.docs, writer.tokens, writer.file.size))

        for batch in slices(batches, "text", 2 << 20):
            for s, i, ids in zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(), enc.ids(batch.column("text")), strict=True):
                if s != shard or writer.file.size + len(writer.block) >= roll_bytes:
                    if writer:
                        finish()
                    shard, number = s, number + 1 if s == shard else 0
                    writer = Writer(folder, f"shard-{s:07d}-{number:04d}.sst", width)
                writer.add(i, np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id)))
        if writer:
            finish()
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["shard", "number", "file", "first_id", "last_id", "docs", "tokens", "bytes"])

    manifest = rows.mapInArrow(write, "shard int, number int, file string, first_id long, last_id long, docs long, tokens long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")  # the commit: what it does not list does not count
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest lists."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # A row for each shard.
    before = manifest.select(F.col("file").alias("_file"), F.coalesce(F.sum("tokens").over(Window.orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.sst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                at, rows = 0, ([], [], [], [])
                for doc_id, ids in Shard.of(content.as_buffer()):
                    for column, value in zip(rows, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(value)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows[0]), pa.string()), *(pa.array(r, pa.int64()) for r in rows)], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(read, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(before, F.col("file") == F.col("_file")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, ids: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The token ids of every document with one of the given identifiers, by ranged reads of the shards that can hold it."""
    out: dict[int | None, list[np.ndarray]] = {i: [] for i in ids}
    manifest = spark.read.parquet(f"{folder}/manifest")
    for doc_id in out:
        least = F.coalesce(F.col("first_id"), F.lit(-(1 << 63)).cast("long"))  # a null id is the first key
        may = F.col("first_id").isNull() if doc_id is None else (least <= doc_id) & (F.col("last_id") >= doc_id)
        for row in manifest.where(may).orderBy("shard", "number").select("file", "bytes").collect():  # one file, or those that the id fills
            fs, path = opened(folder)
            with fs.open_input_file(f"{path}/{row['file']}") as file:
                out[doc_id] += Shard(lambda at, size, file=file: file.read_at(size, at), row["bytes"]).lookup(doc_id)
    return out


def op3_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "sstable")
    write_tables(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tables(spark, folder)
