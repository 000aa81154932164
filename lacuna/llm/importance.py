"""Importance resampling towards a target's distribution of hashed word runs.

Each run of one to ``n`` words is a feature and falls into one of ``buckets``. The log ratio of a bucket's share in the
target and in the corpus is its gain; the sum of the gains of all a document's features, and Gumbel noise from a hash of
its id, is its score; the highest scores are drawn, without replacement.

Texts above ``CHUNK_BYTES`` are split at word boundaries into chunks. A chunk carries the ``n - 1`` words that follow it,
and owns the features that start in it: each feature is counted once, in one chunk. Chunks of one text go to different
tasks, and their counts and weights are summed by document; a short text is one chunk where it lies.

A feature's checksum is put together from those of its words: that of a joined string is linear in those of its parts.

Defined cases: null, empty and wordless texts have no features and the weight 0. A null id is hashed as an empty one and
comes last among equal scores. Repeated rows each have a result and take a rank each. Empty tables give empty results,
and an empty target or corpus counts 0 everywhere. Other columns take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_bytes, materialize, ranked, slices, table
from .words import ALPHANUMERIC, LOWER, blocks, numbered, spans

RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
CHUNK_BYTES = 1 << 16
#: Lengths with a table of their own; longer words are rare and are shifted by powers of two.
SHORT = 64


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending n zero bytes makes of a CRC-32, for each of its four bytes: for n under SHORT, and for powers of two."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1))
    same = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [same]
    for _ in range(SHORT - 1):
        x = short[-1]
        short.append(byte[x & np.uint32(255)] ^ (x >> np.uint32(8)))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(short), powers


_SHIFTS, _POWERS = _shift_tables()


def appended(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings: of the first part, of the second part, and the second's size."""
    n = np.minimum(size, SHORT - 1) << 10
    out = tail.copy()
    for k in range(4):
        out ^= _SHIFTS.take(n + (256 * k) + ((crc >> np.uint32(8 * k)) & np.uint32(255)))
    for i in np.flatnonzero(size >= SHORT).tolist():
        x = crc[i : i + 1]
        for bit in range(int(size[i]).bit_length()):
            if int(size[i]) >> bit & 1:
                x = _applied(_POWERS[bit], x)
        out[i] = x[0] ^ tail[i]
    return out


def features(texts: pa.Array, own: np.ndarray, run: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Own words of each text, and for each length of a run (places of its first words' texts, buckets).

    ``own``: how many of the text's words are its own; negative: all.
    """
    data, offsets = flat_bytes(texts)
    data = LOWER[data]
    start, end, of = spans(data, offsets, ALPHANUMERIC)
    number, distinct = numbered(data, start, end)
    crc = np.array([zlib.crc32(w) for w in distinct], dtype=np.uint32)[number]
    spaced = np.array([zlib.crc32(b" " + w) for w in distinct], dtype=np.uint32)[number]
    size = end - start + 1
    many = np.bincount(of, minlength=len(texts))
    mine = np.where(own < 0, many, own)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    is_own = place < mine[of]
    out, value = [], crc
    for k in range(run):
        if k:
            value = appended(value[:-1], spaced[k:], size[k:]) if len(value) > 1 else value[:0]
        ok = is_own[: len(value)] & (place[: len(value)] + k < many[of[: len(value)]])
        out.append((of[: len(value)][ok], (value[ok] % np.uint32(buckets)).astype(np.int64)))
    return mine, out


def chunked(docs: DataFrame, run: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The short rows of (id, text), and the chunks (id, digest, piece, own, text) of the long ones, dealt out."""
    long_ = F.octet_length("text") > chunk_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("piece", pa.int64()), ("own", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column("text")[row].as_py().encode()
                id_, digest = batch.column("id")[row].as_py(), batch.column("digest")[row].as_py()
                for k, (a, b, own) in enumerate(blocks(text, chunk_bytes, ALPHANUMERIC, run - 1)):
                    yield pa.RecordBatch.from_pylist([{"id": id_, "digest": digest, "piece": k, "own": own, "text": text[a:b].decode()}], schema)

    long_rows = docs.where(long_).select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    chunks = long_rows.mapInArrow(cut, "id long, digest binary, piece long, own long, text string").repartition("digest", "piece")
    return docs.where(~F.coalesce(long_, F.lit(False))), chunks


def bucket_counts(texts: list[DataFrame], run: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the texts; a row for each bucket and task is shuffled, and as many rows as buckets come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices([batch], "text"):
                for _, hit in features(part.column("text"), part.column("own").to_numpy(), run, buckets)[1]:
                    total += np.bincount(hit, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    parts = [t.mapInArrow(count, "bucket long, n long") for t in texts]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    for r in parts[0].groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    total, wanted, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: float(t + 1) * float(total + buckets) / (float(s + 1) * float(wanted + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(rows: DataFrame, gains: np.ndarray, run: int, keys: str) -> DataFrame:
    """``keys`` of each row with its words, features and weight."""
    names = [k.split(" ")[0] for k in keys.split(", ")]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "text"):
                words, found = features(part.column("text"), part.column("own").to_numpy(), run, len(gains))
                count, weight = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
                for of, hit in found:
                    count += np.bincount(of, minlength=len(part))
                    sums = np.concatenate([[0], np.cumsum(gains[hit])])
                    weight += np.diff(sums[np.searchsorted(of, np.arange(len(part) + 1))])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(words), pa.array(count), pa.array(weight)], names=[*names, "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, f"{keys}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for each row; rank is null for what is not drawn."""
    whole = F.lit(-1).cast("long").alias("own")
    as_rows = lambda df, id_, text: df.select(id_.cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    short, chunks = chunked(as_rows(docs, F.col(id_col), text_col), run, chunk_bytes)
    short, chunks = short.select("id", "text", whole), chunks
    wanted_short, wanted_chunks = chunked(as_rows(target, F.lit(0), target_col), run, chunk_bytes)
    source = bucket_counts([short.drop("id"), chunks.select("text", "own")], run, buckets)
    wanted = bucket_counts([wanted_short.select("text", whole), wanted_chunks.select("text", "own")], run, buckets)
    gains = gains_of(source, wanted)  # as many numbers as buckets
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    firsts = [F.first(c).alias(c) for c in ("n_words", "n_features", "weight")]
    pieces = weighed(chunks, gains, run, "id long, digest binary, piece long").groupBy("id", "digest", "piece").agg(*firsts, F.count("*").alias("copies"))
    long_rows = pieces.groupBy("id", "digest").agg(*sums, F.max("copies").alias("copies"))  # repeated rows: as many results
    long_rows = long_rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "n_words", "n_features", "weight")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    out = weighed(short, gains, run, "id long").unionByName(long_rows)
    out = materialize(out.withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words), "scores")
    drawn = out.where("fit").count() * percent // 100
    out = ranked(out, [F.col("fit").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()], "rank")
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


ORACLE_SQL = r"""
WITH k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc),
x AS (SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
g AS (SELECT side, rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w),
f AS MATERIALIZED (SELECT side, rid, f, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1) AS bytes FROM (SELECT DISTINCT f FROM f)),
c AS MATERIALIZED (SELECT f, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM b, k),
n AS MATERIALIZED (SELECT side, rid, b, sum(n) AS n FROM f JOIN c USING (f) GROUP BY ALL),
q AS (SELECT b, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM n GROUP BY b),
a AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM q) + 10000) / ((s + 1) * ((SELECT sum(t) FROM q) + 10000))))::BIGINT AS gain FROM q),
d AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN a USING (b) WHERE side = 's' GROUP BY rid),
e AS (SELECT w.rid, doc_id, len(ws) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d ON w.rid = d.rid WHERE side = 's'),
r AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST) AS r, 5 * count(*) FILTER (fit) OVER () // 100 AS many FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= many THEN r END AS rank FROM r
"""
