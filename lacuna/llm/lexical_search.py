"""Ranked lexical search: a tree of maxima over document ranges, searched best-first.

Documents are dealt into shards where they lie. A shard keeps, of the terms that queries hold, how often each of its
documents has each. Over a shard's documents stands a tree of ranges: ``LEAF`` documents a leaf, ``FAN`` ranges in each
larger one. For each term a range knows the largest share that one of its documents adds to a score. The sum of these
over a query's terms bounds all scores below; ranges are opened in the order of their bounds, from a heap, as long as a
bound is not below the score of the k-th best document. Ranges whose bound equals it are opened as well: a smaller id
may tie there. A task carries each query's best documents from shard to shard, so most later ones end at their root.

Queries are taken in blocks of about ``BLOCK_BYTES`` of text, so what goes to every task is bounded; each block reads
the documents once. A block's counts come back as one number for each of its terms.

Defined cases: null and wordless texts and queries have no terms and no results. Query rows equal in id and text are one
query; rows of one id with other texts are queries of their own, each with ranks from 1. Repeated documents each take a
rank; a null id comes last among equal scores. Long texts are read in blocks. Empty tables give empty results. Other
columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import flat_bytes, materialize, n_buckets, slices, table
from .words import ALPHANUMERIC, LOWER, blocks, numbered, spans

K, LEAF, FAN = 20, 32, 4
#: Bytes of query texts in a block; of document texts in a shard, and read at once.
BLOCK_BYTES, SHARD_BYTES, READ_BYTES = 2 << 20, 16 << 20, 2 << 20
#: Groups in which the tasks' counts, and each query's results, are brought together first.
GROUPS = 16
SCALE, SLOPE = 1_000_000_000, 25
LAST = np.iinfo(np.int64).max


def term_counts(texts: pa.Array, vocabulary: dict[bytes, int] | None, read_bytes: int = READ_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; and (text, term, times) for the terms of the vocabulary, by text and term.

    Without entries the vocabulary learns the terms it meets.
    """
    learn = vocabulary is not None and not vocabulary
    n, keys, times = np.zeros(len(texts), dtype=np.int64), [], []

    def count(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> None:
        start, end, where = spans(data, offsets, ALPHANUMERIC)
        number, distinct = numbered(LOWER[data], start, end)
        np.add.at(n, of, np.bincount(where, minlength=len(of)))
        if learn:
            for w in distinct:
                vocabulary.setdefault(w, len(vocabulary))
        term = np.array([vocabulary.get(w, -1) for w in distinct], dtype=np.int64)[number] if len(number) else number.astype(np.int64)
        hit = term >= 0
        key, many = np.unique((of[where[hit]] << 32) | term[hit], return_counts=True)
        keys.append(key)
        times.append(many)

    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        if sizes[at] > 2 * read_bytes:
            text = texts[at].as_py().encode()
            for a, b, _ in blocks(text, read_bytes, ALPHANUMERIC, 0):
                count(np.frombuffer(text, np.uint8)[a:b], np.array([0, b - a]), np.array([at]))
            at += 1
            continue
        to = at + 1
        while to < len(texts) and sizes[to] <= 2 * read_bytes and sizes[at : to + 1].sum() <= 2 * read_bytes:
            to += 1
        data, offsets = flat_bytes(texts.slice(at, to - at))
        count(data, offsets, np.arange(at, to, dtype=np.int64))
        at = to
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(key)).astype(np.int64) if len(key) else key
    return n, key >> 32, key & 0xFFFFFFFF, total


class Tree:
    """A shard's documents with the maxima of each term over ranges of them."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, share: np.ndarray, n_docs: int, leaf: int = LEAF, fan: int = FAN):
        self.leaf, self.n_docs = leaf, n_docs
        self.at = np.searchsorted(doc, np.arange(n_docs + 1))
        self.terms, self.column = np.unique(term, return_inverse=True)
        self.share = share
        leaves = max(1, -(-n_docs // leaf))
        level = np.zeros((leaves, len(self.terms)), dtype=np.int32)
        np.maximum.at(level, (doc // leaf, self.column), share)
        levels = [level]
        while len(level) > 1:
            level = np.maximum.reduceat(level, np.arange(0, len(level), fan), axis=0)
            levels.append(level)
        sizes = [len(x) for x in reversed(levels)]
        base = np.cumsum([0, *sizes]).tolist()
        self.maxima = np.concatenate(levels[::-1])  # the root first, leaves last
        self.first_leaf = base[len(sizes) - 1]
        self.below = [range(base[d + 1] + fan * i, min(base[d + 1] + fan * (i + 1), base[d + 2])) for d in range(len(sizes) - 1) for i in range(sizes[d])]

    def columns(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``terms`` the shard has, and their columns."""
        at = np.searchsorted(self.terms, terms)
        have = at < len(self.terms)
        have[have] = self.terms[at[have]] == terms[have]
        return have, at[have]

    def search(self, columns: np.ndarray, weights: np.ndarray, order: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put (score, minus the place in ``order``) of the best documents into the heap ``best`` of ``k`` at most."""
        bound = self.maxima[:, columns].astype(np.int64) @ weights
        weight = np.zeros(len(self.terms), dtype=np.int64)
        weight[columns] = weights
        heap = [(-int(bound[0]), 0)]
        while heap:
            most, node = heappop(heap)
            if most == 0 or len(best) == k and -most < best[0][0]:
                return
            if node < self.first_leaf:
                for child in self.below[node]:
                    heappush(heap, (-int(bound[child]), child))
                continue
            lo = (node - self.first_leaf) * self.leaf
            hi = min(lo + self.leaf, self.n_docs)
            a, b = self.at[lo], self.at[hi]
            sums = np.concatenate([[0], np.cumsum(weight[self.column[a:b]] * self.share[a:b])])
            scores = sums[self.at[lo + 1 : hi + 1] - a] - sums[self.at[lo:hi] - a]
            for i in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1)).tolist():
                found = (int(scores[i]), -int(order[lo + i]))
                if len(best) < k:
                    heappush(best, found)
                else:
                    heappushpop(best, found)


def packed(batch: pa.RecordBatch, row: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_py(), kind)


def block_of_queries(rows: list) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray]]]:
    """The terms of a block's queries, and each query's terms (ascending) with their repeats."""
    vocabulary: dict[bytes, int] = {}
    out = []
    texts = pa.array([r["text"] for r in rows], pa.string())
    term_counts(texts, vocabulary)
    if not vocabulary:
        return {}, []
    _, of, term, times = term_counts(texts, vocabulary)
    cut = np.searchsorted(of, np.arange(len(rows) + 1))
    out = [(term[a:b], times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return vocabulary, out


def search_block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """(query, doc, score, rank) for the queries ``rows``; ``query`` is a place among them."""
    spark = docs.sparkSession
    vocabulary, queries = block_of_queries(rows)
    if not vocabulary:
        return None
    terms = spark.sparkContext.broadcast(vocabulary)
    width = len(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "text", SHARD_BYTES):
                n, doc, term, times = term_counts(part.column("text"), terms.value)
                ids = part.column("id")
                order = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
                values = [doc.astype(np.int32), term.astype(np.int32), times, n, order.astype(np.int64)]
                columns = [pa.array([x.tobytes()], pa.binary()) for x in values]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["doc", "term", "times", "n", "ids", "docs", "terms"])

    shards = materialize(docs.mapInArrow(index, "doc binary, term binary, times binary, n binary, ids binary, docs long, terms long"), "shards")
    totals = shards.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).head()
    if not totals["docs"]:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for i in range(len(batch)):
                held += np.bincount(packed(batch, i, "term", "i4"), minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for x in batch.column("held").to_pylist():
                held += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    counts = shards.select("term").mapInArrow(count, "held binary").repartition(GROUPS).mapInArrow(add, "held binary")
    df = sum((np.frombuffer(r["held"], np.int64) for r in counts.collect()), np.zeros(width, dtype=np.int64))  # GROUPS rows
    all_docs, all_terms = totals["docs"], totals["terms"]
    weight = np.array([math.floor(1000 * math.log(float(2 * all_docs + 2) / float(2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    asked = spark.sparkContext.broadcast([(t, times * weight[t]) for t, times in queries])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        for batch in batches:
            for i in range(len(batch)):
                doc, term, times, n = packed(batch, i, "doc", "i4"), packed(batch, i, "term", "i4"), packed(batch, i, "times", "i8"), packed(batch, i, "n", "i8")
                if not len(doc):
                    continue
                m = 100 - SLOPE + (SLOPE * n * all_docs) // all_terms
                tree = Tree(doc, term, (SCALE * times) // (1000 * times + 12 * m[doc]), len(n))
                order = packed(batch, i, "ids", "i8")
                for (t, w), heap in zip(wanted, best, strict=True):
                    have, columns = tree.columns(t)
                    if len(columns):
                        tree.search(columns, w[have], order, heap, k)
        found = [(q, -o, s) for q, heap in enumerate(best) for s, o in heap]
        query, order, score = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(order, mask=order == LAST), pa.array(score)], names=["query", "doc", "score"])

    found = shards.drop("docs", "terms").mapInArrow(search, "query long, doc long, score long")
    place = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    # k rows of each task for each query meet in groups first.
    first = found.withColumn("_g", F.pmod(F.xxhash64("doc"), F.lit(GROUPS))).withColumn("_r", F.row_number().over(Window.partitionBy("query", "_g").orderBy(*place))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*place))).where(F.col("rank") <= k).select("query", "doc", "score", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item that score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n = n_buckets(asked.agg(F.sum(F.octet_length("text"))).head()[0] or 0, BLOCK_BYTES, 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for block in range(n):
        some = asked.where(F.col("block") == block).select("item", "text").distinct().collect()  # a bounded block
        found = search_block(rows, some, k) if some else None
        if found is None:
            continue
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(some)], f"query long, item {kind}")
        found = found.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.where(F.lit(False)).select(F.col("item").alias(item_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0).cast("long").alias("score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM low) GROUP BY ALL),
q AS MATERIALIZED (SELECT item_id, w, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM low WHERE len(ws) > 0),
f AS (SELECT w, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c WHERE w IN (SELECT w FROM q) GROUP BY w, n),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * len(ws)::BIGINT * n) // l AS m FROM low, c WHERE len(ws) > 0),
s AS (SELECT item_id, rid, doc_id, sum(qf * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN t USING (w) JOIN f USING (w) JOIN m USING (rid) GROUP BY ALL)
SELECT * FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 20
"""
