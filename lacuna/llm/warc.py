"""WARC archives of pages: range-sorted records, files rolled by compressed size, new headers and digests.

Of the pages with equal payloads the smallest id is written as ``response``; the others as ``revisit``
records that refer to it and carry no payload. Records are gzip members of their own, in order of page id. A
task writes its files under temporary names and moves them when whole; names, record ids and dates depend on
the data alone, so a repeated task writes the same bytes again. The manifest is written last and lists the
files that count, with their records, bytes and first and last page id.

Defined cases: null html is an empty payload; a null url has no target header. Null page ids come first and
are written whole as responses of their own, and are never referred to. Repeated page ids: the first row in
order of digest and url is the response if the payload has no smaller id. No pages make no file. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_buckets, shared_dir, slices, table
from .files import Whole

ROLL_BYTES, TASK_BYTES, DATE = 16 << 20, 32 << 20, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE, _VERSION = 0x6C61 << 48, 0x4000  # of the upper half of record ids


def record_id(page_id: int | None, n: int = 0) -> str:
    """A UUID that holds the page id and which of the records with that id it is; for null ids, the number alone."""
    high = _SPACE | _VERSION | 1 if page_id is None else _SPACE | (n & (1 << 32) - 1) << 16 | _VERSION
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | (n if page_id is None else page_id & (1 << 64) - 1))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record[10:-1]).int
    low = n & (1 << 64) - 1
    return None if n >> 64 & 1 else low - (1 << 64) if low >> 63 else low


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, n: int = 0) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    heads = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, n)), ("WARC-Date", DATE)]
    if url is not None:
        heads.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    heads.append(("WARC-Payload-Digest", "sha1:" + digest_of(payload)))
    if refers_to is None:
        block += payload
        heads.append(("WARC-Block-Digest", "sha1:" + digest_of(block)))
    else:
        heads += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, member by member."""
    data = memoryview(data).cast("B")
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        parts, step = [], 1 << 16
        while not z.eof:
            parts.append(z.decompress(data[at : at + step]))
            at += min(step, len(data) - at)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        heads = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield heads, rest[: int(heads["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = 0, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Write the archives and return the manifest. Payloads of fewer than ``least_bytes`` are never revisits."""
    html = F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload") + 256)).head()[0]
    n = n_buckets(total or 0, task_bytes, 1)
    # Digests, without the payloads, find the first page of each payload.
    small = rows.where((F.octet_length("payload") >= least_bytes) & F.col("id").isNotNull()).select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"))
    first = small.groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = small.join(first, ["sha", "size"]).select("id", "sha", "first").distinct()
    # They go into the same sorted stream just before their pages, so payloads are shuffled once.
    notes = again.select("id", F.lit(0).alias("kind"), "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    full = rows.select("id", F.lit(1).alias("kind"), F.sha1("payload").alias("sha"), "url", "payload", F.lit(None).cast("long").alias("first"))
    # Ranges of ids; pages without one, which no note is for, are dealt by their payloads.
    order = [F.col("id").asc_nulls_first(), F.when(F.col("id").isNull(), F.col("sha"))]
    stream = full.unionByName(notes).repartitionByRange(n, *order).sortWithinPartitions(F.col("id").asc_nulls_first(), "kind", "sha", "url").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        part = last = None
        count = nth = 0
        of: dict[str, int] = {}
        served: set[str] = set()

        def finish():
            if out:
                out.commit()
                done.append((out.name, part, number, count, out.size, low, last))

        for batch in slices(batches, "payload", 4 << 20):
            for p, i, kind, sha, url, payload, first_ in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "kind", "sha", "url", "payload", "first")), strict=True):
                if p != part:
                    finish()
                    out, part, number, last, nth = None, p, 0, None, 0
                    of, served = {}, set()
                if i != last:
                    of, served, last, nth = {}, set(), i, 0
                if kind == 0:
                    of[sha] = first_
                    continue
                refers = of.get(sha)
                if refers == i:  # the first of the rows with this id is what others refer to
                    refers = i if sha in served else None
                    served.add(sha)
                # What others refer to is the first record of its page, unless a page has several payloads.
                if out is None:
                    out, count, low = Whole(folder, f"pages-{part:06d}-{number:04d}.warc.gz"), 0, i
                out.write(member(record(i, url, payload, refers, nth)))
                nth += 1
                count += 1
                if out.size >= roll_bytes:
                    finish()
                    out, number = None, number + 1
        finish()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["file", "part", "number", "records", "bytes", "first_id", "last_id"])

    stream.mapInArrow(write, "file string, part int, number int, records long, bytes long, first_id long, last_id long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record in the listed files."""
    listed = spark.read.parquet(f"{folder}/manifest").select(F.col("file").alias("_file"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(listed, F.col("file") == F.col("_file"), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for heads, block in records(content.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest, kind = heads["WARC-Payload-Digest"].removeprefix("sha1:"), heads["WARC-Type"]
                    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"damaged record {heads['WARC-Record-ID']}")
                    rows.append((page_of(heads["WARC-Record-ID"]), size, digest, kind, page_of(heads["WARC-Refers-To"]) if "WARC-Refers-To" in heads else None, heads.get("WARC-Target-URI")))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).drop("url")


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT rid, page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first, row_number() OVER (PARTITION BY x, page_id) AS nth FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  list_aggregate(list_transform(range(0, 5), lambda j: (((instr('0123456789abcdef', substr(x, (5 * i + j) // 4 + 1, 1)) - 1) >> (3 - (5 * i + j) % 4)) & 1) << (4 - j)), 'sum')::INT + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id IS NULL OR (page_id = first AND nth = 1) THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NULL OR (page_id = first AND nth = 1) THEN NULL ELSE first END AS refers_to FROM f
"""
