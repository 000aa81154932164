"""Nearest neighbours by cosine with a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample (``SAMPLE`` vectors with the smallest hashes of their ids); every vector is
indexed: it goes down to the nearest centre at each level and lies in one leaf. A query walks the tree with a
priority queue of nodes by their distance and opens leaves, nearest first. How many it opens is calibrated: for
up to ``CALIBRATION`` queries the true neighbours are found by a scan of all vectors, and the number is raised
until the leaves opened hold at least ``RECALL`` of them. A query whose leaves hold fewer than ``k`` candidates opens
further ones until they do, or none is left.

Queries meet the vectors of their leaves in groups of one leaf and one part of it. A leaf with many vectors has as
many parts as they ask for, so that no group outgrows a task; queries of a group are taken in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
vectors of another length than most of the sample. A null id is not a candidate and not a query. Rows that repeat
an id are candidates of their own; a query is never its own candidate, by id. Query rows equal in id and vector are one
query; rows of one id with other vectors are queries of their own, each with its ranks, told apart by ``query_key``, the
hash of id and vector. With fewer vectors than ``k`` all are returned. Without vectors the result is empty. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

SAMPLE, BRANCH, LEAF, CALIBRATION, RECALL = 20_000, 16, 100, 128, 0.97
#: Vectors in a part of a leaf, and queries taken at once.
PART, BLOCK = 20_000, 256
#: Queries of a lot that meets a part of a leaf.
QUERIES = 5_000


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = np.bincount(of, minlength=k) > 0
        centres = np.where(full[:, None], sums, centres)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    return centres, np.argmax(x @ centres.T, axis=1)


class Tree:
    """Inner node: centres and children (nodes by number); leaf: a number from 0."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # a leaf L as -1 - L
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            k = min(branch, len(rows) // max(1, leaf // 2))
            if len(rows) <= leaf or k < 2:
                self.leaves += 1
                return -self.leaves
            centres, of = kmeans(x[rows], k, rng)
            groups = [rows[of == j] for j in range(k)]
            if max(map(len, groups)) == len(rows):  # nothing but copies
                self.leaves += 1
                return -self.leaves
            number = len(self.centres)
            self.centres.append(centres)
            self.children.append([])
            self.children[number] = [grow(g) for g in groups]
            return number

        self.root = grow(np.arange(len(x))) if len(x) else -1
        self.leaves = max(1, self.leaves)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int32)
        waiting = [(self.root, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                best = np.argmax(x[rows] @ self.centres[node].T, axis=1)
                waiting += [(child, rows[best == j]) for j, child in enumerate(self.children[node])]
        return out

    def leaves_near(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """Leaves in best-bin-first order: the queue always opens the node whose centre is nearest.

        ``most`` leaves, and more until by ``sizes`` they hold ``need`` vectors.
        """
        queue, out, held = [(0.0, self.root)], [], 0
        while queue and (len(out) < most or held < need):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += sizes.get(-1 - node, 0) if sizes else 0
            else:
                for far, child in zip((-(self.centres[node] @ q)).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (far, child))
        return out


def usable(column: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0)


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, places and cosines of its k best candidates, ties to the smaller id."""
    xn, qn = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
    for at in range(0, len(q), BLOCK):
        rough = (q[at : at + BLOCK] @ x.T) / (qn[at : at + BLOCK, None] * xn)
        rough[q_ids[at : at + BLOCK, None] == ids] = -np.inf
        kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -2.0)
        for i, row in enumerate(rough):
            hit = np.flatnonzero((row >= kth[i] - 1e-9) & (row > -np.inf))
            # One product after the other, so that equal vectors have equal scores wherever they lie.
            score = np.einsum("ij,ij->i", x[hit], np.broadcast_to(q[at + i], x[hit].shape)) / (xn[hit] * qn[at + i])
            order = np.lexsort((ids[hit], -score))[:k]
            yield at + i, hit[order], score[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, query_key): the k nearest rows of ``vectors`` that were found for each row of ``queries``."""
    spark = vectors.sparkSession
    take = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    vectors, queries = take(vectors), take(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_key long")
    # TakeOrdered: SAMPLE rows at most reach the driver.
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(sample):
        return empty
    width = int(sample["v"].map(len).mode().iloc[0])
    vectors, queries = vectors.where(F.size("v") == width), queries.where(F.size("v") == width).distinct()
    sample = sample[sample["v"].map(len) == width]
    tree = spark.sparkContext.broadcast(Tree(unit(matrix(sample["v"]))))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.value.leaf_of(unit(matrix(b["v"]))) if len(b) else np.empty(0, np.int32))

    indexed = materialize(vectors.mapInPandas(index, "id long, v array<double>, leaf int"), "leaves")
    opened = calibrated(indexed, queries, tree, k, recall)
    sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    parts = {leaf: -(-n // PART) for leaf, n in sizes.items()}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, v, key, own in zip(b["id"], b["v"], b["key"], b["own"], strict=True):
                near = tree.value.leaves_near(unit(np.asarray(v)[None, :])[0], opened, sizes, k + own)
                rows += [(i, v, key, leaf) for leaf in near if leaf in parts]
            yield pd.DataFrame(rows, columns=["id", "v", "key", "leaf"])

    own = indexed.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("own"))  # rows that a query of this id passes over
    asked = queries.join(own, F.col("id") == F.col("_id"), "left").select("id", "v", F.xxhash64("id", "v").alias("key"), F.coalesce("own", F.lit(0)).alias("own"))
    # Queries are few bytes but each walks the tree, so they are spread over all tasks; a given number is not coalesced.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = materialize(asked.repartition(tasks, "key").mapInPandas(visit, "id long, v array<double>, key long, leaf int"), "visits")
    lots = {r["leaf"]: -(-r["n"] // QUERIES) for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    # A leaf's vectors in parts and its queries in lots: each part meets each lot, and no group grows with the table.
    cut = F.broadcast(spark.createDataFrame([(leaf, n, lots.get(leaf, 0)) for leaf, n in parts.items()], "leaf int, _parts int, _lots int"))  # a row for each leaf
    asked = asked.join(cut, "leaf").withColumn("lot", F.pmod(F.col("key"), F.col("_lots")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_lots")
    held = indexed.join(cut.where("_lots > 0"), "leaf").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("_parts")).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1))).drop("_parts", "_lots")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = [] if not len(q) or not len(x) else best_of(matrix(q["v"]), q["id"].to_numpy(), matrix(x["v"]), x["id"].to_numpy(), k)
        ids, keys, of = q["id"].to_numpy(), q["key"].to_numpy(), x["id"].to_numpy() if len(x) else None
        rows = [(ids[i], keys[i], of[j], s) for i, near, score in found for j, s in zip(near, score, strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "query_key", "vec_id", "score"])

    found = asked.groupBy("leaf", "part", "lot").cogroup(held.groupBy("leaf", "part", "lot")).applyInPandas(meet, "query_id long, query_key long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")


def calibrated(indexed: DataFrame, queries: DataFrame, tree, k: int, recall: float) -> int:
    """Leaves to open so that the true neighbours of the calibration queries lie in them often enough."""
    some = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).toPandas()
    if not len(some):
        return 1
    q, ids = matrix(some["v"]), some["id"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = b["leaf"].to_numpy()
            own = b["id"].to_numpy()
            rows = [(i, s, own[j], leaf[j]) for i, near, score in (best_of(q, ids, matrix(b["v"]), own, k) if len(b) else ()) for j, s in zip(near, score, strict=True)]
            yield pd.DataFrame(rows, columns=["i", "score", "id", "leaf"])

    nth = F.row_number().over(Window.partitionBy("i").orderBy(F.col("score").desc(), "id"))
    true = indexed.mapInPandas(scan, "i int, score double, id long, leaf int").withColumn("r", nth).where(F.col("r") <= k).select("i", "leaf").toPandas()  # k rows for each calibration query
    if not len(true):
        return 1
    places = []
    for i, leaves in true.groupby("i")["leaf"]:
        order = {leaf: at for at, leaf in enumerate(tree.value.leaves_near(unit(q[i : i + 1])[0], tree.value.leaves))}
        places += [order[leaf] for leaf in leaves]
    places = np.sort(places)
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def op7_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
