"""Random forests whose trees are grown by tasks and stay in the shared folder: the driver holds no tree.

Rows are binned by quantiles; rows with the same bins and label are one class with a count. Of each class a tree's bootstrap
sample has a Poisson number of rows. Nodes of more than ``LOCAL`` sampled classes are split level by level from histograms
that tasks make of blocks of classes and a shuffle adds up; what lies below a smaller node goes to one task, which grows
that subtree. So no task has more than a block or ``LOCAL`` classes, and deep trees of many rows cost the driver nothing.
Nothing depends on the order of rows, files or tasks, the quantiles neither: one seed, one forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml.base import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, opened, removed_at_exit, shared_dir

#: Bins of a feature; classes of a block, of a subtree's task, and rows that are scored at once; trees that one task samples.
BINS, BLOCK, LOCAL, SCORED, LOT = 32, 1 << 15, 1 << 17, 1 << 16, 10
#: Values that stand for a block's values of a feature; a quantile is off by at most a 1000th of all rows.
POINTS = 1000
WIDTH = BINS + 1  # the last bin has what is missing


def codes_of(batch: pa.RecordBatch, names: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of a batch's rows, a byte for each feature."""
    out = np.empty((batch.num_rows, len(names)), dtype=np.uint8)
    for k, (name, at) in enumerate(zip(names, cuts, strict=True)):
        x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, k] = np.where(np.isnan(x), BINS, np.searchsorted(at, x, side="right"))
    return out


def points(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand for all, ascending, with the counts that they stand for: all distinct ones, or ``POINTS`` at equal steps of the counts."""
    values, at = np.unique(values, return_inverse=True)
    upto = np.cumsum(np.bincount(at, weights=counts).astype(np.int64))
    if len(values) > POINTS:
        ends = np.arange(1, POINTS + 1) * upto[-1] // POINTS
        kept = np.unique(np.searchsorted(upto, ends))
        values, upto = values[kept], upto[kept]
    return values, np.diff(upto, prepend=0)


def quantiles(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The distinct values at which a ``BINS``-th of the counts, two, and so on are reached."""
    values, at = np.unique(values, return_inverse=True)
    upto = np.cumsum(np.bincount(at, weights=counts).astype(np.int64))
    return values[np.unique(np.searchsorted(upto * BINS, np.arange(1, BINS) * upto[-1]))]


def gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The impurity of nodes with weights a and b, times their weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a + b > 0, 2 * a * b / (a + b), 0.0)


def best_cut(sums: np.ndarray, weights: tuple[float, float], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node of ``sums`` (nodes, 2 labels, bins): the gain of its best cut, or -1, and the last bin of its left side."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    all_ = sums.sum(axis=2)[:, :, None]
    right = all_ - left
    w0, w1 = weights
    gain = gini(w0 * all_[:, 0], w1 * all_[:, 1]) - gini(w0 * left[:, 0], w1 * left[:, 1]) - gini(w0 * right[:, 0], w1 * right[:, 1])
    gain[(left.sum(axis=1) < least) | (right.sum(axis=1) < least)] = -1.0
    at = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), at], at


def tried(seed: list[int], nodes: int, features: int, many: int) -> np.ndarray:
    """The features that each of ``nodes`` tries."""
    return np.argsort(np.random.default_rng(seed).random((nodes, features)), axis=1)[:, :many]


def grow(codes: np.ndarray, y: np.ndarray, n: np.ndarray, weights: tuple[float, float], depth: int, many: int, least: int, seed: list[int]) -> tuple[np.ndarray, ...]:
    """A subtree over classes (codes, y, n), all nodes of a level at once: feature (-1: leaf), last bin to the left, left child, probability; and each feature's gain."""
    feature, cut, child, prob, gains = [], [], [], [], np.zeros(codes.shape[1])
    rows, of, nodes, made = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 1, 1
    for level in range(depth + 1):
        labels, counts = y[rows], n[rows]
        total = np.stack([np.bincount(of[labels == k], weights=counts[labels == k], minlength=nodes) for k in (0, 1)], axis=1)
        weight = total @ np.array(weights)
        prob.append(weights[1] * total[:, 1] / np.maximum(weight, 1e-300))
        best, f, c = np.full(nodes, 1e-9), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
        open_ = (total.min(axis=1) > 0) & (total.sum(axis=1) >= 2 * least)
        if level < depth and open_.any():
            keep = open_[of]
            rows, of = rows[keep], of[keep]
            labels, counts = y[rows], n[rows]
            which = np.flatnonzero(open_)
            small = np.zeros(nodes, dtype=np.int64)
            small[which] = np.arange(len(which))
            g, asked = small[of], tried([*seed, level], len(which), codes.shape[1], many)
            for j in range(many):
                key = (g * 2 + labels) * WIDTH + codes[rows, asked[g, j]]
                sums = np.bincount(key, weights=counts, minlength=len(which) * 2 * WIDTH).reshape(-1, 2, WIDTH)
                gain, at = best_cut(sums, weights, least)
                better = gain > best[which]
                best[which[better]], f[which[better]], c[which[better]] = gain[better], asked[better, j], at[better]
        split = f >= 0
        feature.append(f)
        cut.append(c)
        child.append(np.where(split, made + 2 * (np.cumsum(split) - 1), 0))
        gains += np.bincount(f[split], weights=best[split], minlength=len(gains))
        if not split.any():
            break
        keep = split[of]
        rows, of = rows[keep], of[keep]
        of = (child[-1][of] - made) + (codes[rows, f[of]] > c[of])
        nodes = 2 * int(split.sum())
        made += nodes
    return np.concatenate(feature).astype("<i2"), np.concatenate(cut).astype("u1"), np.concatenate(child).astype("<i4"), np.concatenate(prob).astype("<f8"), gains


def scored(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, prob: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = child[here] + (codes[rows, feature[here]] > cut[here])
    return prob[at]


def below(codes: np.ndarray, node: int, top: dict[int, tuple[int, int]]) -> np.ndarray:
    """Which rows come to ``node`` (the root is 1, children of k are 2k and 2k + 1) by the splits ``top``."""
    out = np.ones(len(codes), dtype=bool)
    while node > 1:
        feature, cut = top[node // 2]
        out &= (codes[:, feature] > cut) == bool(node % 2)
        node //= 2
    return out


class TaskForest(RandomForestClassifier):
    """The estimator with the parameters of Spark's own; its features are the columns ``names``."""

    def __init__(self, names: list[str], **settings):
        super().__init__(**settings)
        self.names = names

    def _fit(self, rows: DataFrame) -> TaskForestModel:
        names, trees, depth, seed, least = self.names, self.getNumTrees(), self.getMaxDepth(), self.getSeed(), self.getMinInstancesPerNode()
        many, label = ceil(sqrt(len(names))), self.getLabelCol()
        spark, local, width = rows.sparkSession, LOCAL, len(names)
        rows = materialize(rows.select((F.col(label) == 1).cast("int").alias("y"), *(F.col(c).cast("double") for c in names)), "train")
        vectors = materialize(rows.groupBy(F.array(*names).alias("x")).agg(F.count("*").alias("n")), "vectors")

        def stand(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            data, counts = np.array(part["x"].tolist(), dtype=np.float64), part["n"].to_numpy()
            found = ((k, *points(x[there], counts[there])) for k, x in enumerate(data.T) if (there := ~np.isnan(x)).any())
            return pd.DataFrame([(k, a.tobytes(), b.tobytes()) for k, a, b in found], columns=["f", "x", "n"])

        def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            at = quantiles(np.frombuffer(b"".join(part["x"]), "<f8"), np.frombuffer(b"".join(part["n"]), "<i8"))
            return pd.DataFrame([(key[0], at.tobytes())], columns=["f", "cuts"])

        # Blocks of distinct vectors are the same in every run.
        stands = vectors.groupBy(F.pmod(F.xxhash64("x"), F.lit(max(1, -(-vectors.count() // BLOCK))))).applyInPandas(stand, "f int, x binary, n binary")
        cuts = [np.empty(0)] * width
        for r in stands.groupBy("f").applyInPandas(cut, "f int, cuts binary").collect():  # a row for each feature
            cuts[r["f"]] = np.frombuffer(r["cuts"], "<f8")

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = codes_of(batch, names, cuts)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in data], pa.binary()), batch.column("y")], names=["codes", "y"])

        classes = materialize(rows.mapInArrow(code, "codes binary, y int").groupBy("codes", "y").agg(F.count("*").alias("n")), "classes")
        have = classes.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p")).head()
        if not have["k"]:
            raise ValueError("no rows to train on")
        n, p = have["n"], have["p"]
        weights = (n / max(1, 2 * (n - p)), n / max(1, 2 * p))
        lots = -(-trees // LOT)

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["codes", "y"])
            return pd.DataFrame([(key[0], b"".join(part["codes"]), part["y"].to_numpy("u1").tobytes(), part["n"].to_numpy("<i8").tobytes())], columns=["block", "codes", "y", "n"])

        blocks = classes.groupBy(F.pmod(F.xxhash64("codes", "y"), F.lit(-(-have["k"] // BLOCK))).alias("block")).applyInPandas(pack, "block long, codes binary, y binary, n binary")
        blocks = materialize(blocks, "blocks")
        asked = blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).repartition(max(1, min(lots * -(-have["k"] // BLOCK), 8 * spark.sparkContext.defaultParallelism)), "block", "lot")

        def samples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """(tree, codes, y, n): the sampled classes of a block for each tree of a lot."""
            for batch in batches:
                for block, codes, y, m, lot in zip(batch["block"], batch["codes"], batch["y"], batch["n"], batch["lot"], strict=True):
                    codes, y, m = np.frombuffer(codes, "u1").reshape(-1, width), np.frombuffer(y, "u1"), np.frombuffer(m, "<i8")
                    for t in range(lot * LOT, min(trees, (lot + 1) * LOT)):
                        drawn = np.random.default_rng([seed, t, block]).poisson(m)
                        hit = np.flatnonzero(drawn)
                        yield t, codes[hit], y[hit], drawn[hit]

        # Nodes that are split before their rows are dealt out; some n / LOCAL for each tree.
        top: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(trees)}
        leaves: dict[int, dict[int, float]] = {t: {} for t in range(trees)}
        wide: dict[int, list[int]] = {t: [1] for t in range(trees)} if have["k"] > local else {}
        ready: dict[int, list[int]] = {t: [] if t in wide else [1] for t in range(trees)}
        gains = np.zeros((trees, width))
        while wide:
            def histograms(batches: Iterator[pd.DataFrame], top=top, wide=wide) -> Iterator[pd.DataFrame]:
                for t, codes, y, drawn in samples(batches):
                    for node in wide.get(t, []):
                        hit = np.flatnonzero(below(codes, node, top[t]))
                        out = []
                        for f in tried([seed, t, node], 1, width, many)[0]:
                            key = y[hit].astype(np.int64) * WIDTH + codes[hit, f]
                            out += [np.bincount(key, weights=drawn[hit], minlength=2 * WIDTH), np.bincount(codes[hit, f], minlength=2 * WIDTH)]
                        yield pd.DataFrame([(t, node, np.array(out, dtype="<f8").tobytes())], columns=["tree", "node", "sums"])

            def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
                t, node = key
                sums = sum(np.frombuffer(x, "<f8") for x in part["sums"]).reshape(many, 2, 2 * WIDTH)
                by, here = sums[:, 0].reshape(many, 2, WIDTH), sums[:, 1, :WIDTH]
                gain, at = best_cut(by, weights, least)
                j = int(gain.argmax())
                c = int(at[j])
                left, all_ = by[j, :, : c + 1].sum(axis=1) * weights, by[j].sum(axis=1) * weights
                share = lambda x: float(x[1] / max(x.sum(), 1e-300))
                return pd.DataFrame([(t, node, int(tried([seed, t, node], 1, width, many)[0][j]), c, float(gain[j]), int(here[j, : c + 1].sum()), int(here[j, c + 1 :].sum()), share(all_), share(left), share(all_ - left))], columns=["tree", "node", "f", "c", "gain", "a", "b", "p", "pa", "pb"])

            found = asked.mapInPandas(histograms, "tree int, node long, sums binary").groupBy("tree", "node").applyInPandas(choose, "tree int, node long, f int, c int, gain double, a long, b long, p double, pa double, pb double").collect()  # a row for each wide node
            wide = {}
            for r in found:
                t, node = r["tree"], r["node"]
                if r["gain"] <= 1e-9:
                    leaves[t][node] = r["p"]
                    continue
                top[t][node] = (r["f"], r["c"])
                gains[t, r["f"]] += r["gain"]
                for k, many_rows, share in ((2 * node, r["a"], r["pa"]), (2 * node + 1, r["b"], r["pb"])):
                    if k.bit_length() - 1 >= depth:
                        leaves[t][k] = share
                    elif many_rows > local:
                        wide.setdefault(t, []).append(k)
                    else:
                        ready[t].append(k)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t, codes, y, drawn in samples(batches):
                for node in ready[t]:
                    hit = below(codes, node, top[t])
                    yield pd.DataFrame([(t, node, codes[hit].tobytes(), y[hit].tobytes(), drawn[hit].astype("<i8").tobytes())], columns=["tree", "node", "codes", "y", "n"])

        def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            t, node = key
            part = part.sort_values(["codes", "y", "n"])  # blocks come in any order
            join = lambda c, kind: np.frombuffer(b"".join(part[c]), dtype=kind)
            out = grow(join("codes", "u1").reshape(-1, width), join("y", "u1").astype(np.int64), join("n", "<i8"), weights, depth - (int(node).bit_length() - 1), many, least, [seed, t, node])
            return pd.DataFrame([(t, node, *(x.tobytes() for x in out))], columns=["tree", "node", "feature", "cut", "child", "prob", "gains"])

        path = shared_dir(spark, "forest")
        removed_at_exit(spark, path)
        dealt = asked.mapInPandas(deal, "tree int, node long, codes binary, y binary, n binary")
        dealt.groupBy("tree", "node").applyInPandas(finish, "tree int, node long, feature binary, cut binary, child binary, prob binary, gains binary").write.parquet(path)
        for r in spark.read.parquet(path).select("tree", "node", "gains").toLocalIterator():  # a row for each subtree
            gains[r["tree"]] += np.frombuffer(r["gains"], "<f8")
        return TaskForestModel(path, names, cuts, trees, top, leaves, gains)


class TaskForestModel(Model):
    """Trees in the shared folder, which live as long as the session."""

    def __init__(self, path: str, names: list[str], cuts: list[np.ndarray], trees: int, top: dict, leaves: dict, gains: np.ndarray):
        super().__init__()
        self.path, self.names, self.cuts, self.trees, self.top, self.leaves = path, names, cuts, trees, top, leaves
        by_tree = gains.sum(axis=1, keepdims=True)
        share = np.divide(gains, by_tree, out=np.zeros_like(gains), where=by_tree > 0).sum(axis=0)
        self.importances = share / share.sum() if share.sum() else share

    def _transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with prob. A task reads the trees one after the other for each ``SCORED`` rows; equal rows are scored once."""
        path, names, cuts, trees, top, leaves, kept = self.path, self.names, self.cuts, self.trees, self.top, self.leaves, rows.columns
        inputs = [f"_in_{i}" for i in range(len(names))]

        def probabilities(codes: np.ndarray) -> np.ndarray:
            codes, back = np.unique(codes, axis=0, return_inverse=True)
            total = np.zeros(len(codes))
            for t, by in leaves.items():
                for node, p in by.items():
                    total[below(codes, node, top[t])] += p
            fs, at = opened(path)
            for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".parquet")):
                with fs.open_input_file(file) as f:
                    for batch in pq.ParquetFile(f).iter_batches(8, columns=["tree", "node", "feature", "cut", "child", "prob"]):
                        for r in batch.to_pylist():
                            hit = np.flatnonzero(below(codes, r["node"], top[r["tree"]]))
                            total[hit] += scored(codes[hit], *(np.frombuffer(r[c], kind) for c, kind in (("feature", "<i2"), ("cut", "u1"), ("child", "<i4"), ("prob", "<f8"))))
            return (total / trees)[back.ravel()]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def done() -> Iterator[pa.RecordBatch]:
                prob, first = probabilities(np.concatenate([c for _, c in held])), 0
                for batch, codes in held:
                    yield pa.RecordBatch.from_arrays([*batch, pa.array(prob[first : first + len(codes)])], names=[*kept, "prob"])
                    first += len(codes)

            for batch in batches:
                held.append(([batch.column(c) for c in kept], codes_of(batch, inputs, cuts)))
                size += batch.num_rows
                if size >= SCORED:
                    yield from done()
                    held, size = [], 0
            if size:
                yield from done()

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.select("*", *(F.col(c).cast("double").alias(i) for c, i in zip(names, inputs, strict=True))).mapInArrow(score, f"{schema}, prob double")
