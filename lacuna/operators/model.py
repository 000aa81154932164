"""Random forests over feature columns: fit, frozen thresholds, stored models with their metadata, and the sampling diagnostic.

Spark's forest bins features and has one set of class weights for all trees. :func:`train_balanced` gives each tree its
own bootstrap counts and its own class balance over bins that all trees share; :func:`train_wide` grows trees in tasks. Scores differ from other libraries'
forests while the protocol is the same.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from math import exp, inf
from platform import python_version

from pyspark import __version__ as spark_version
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop, materialize, shared_dir
from . import metrics, splits
from .experiment import CONFOUND_CEILING
from .forest import TaskForest, TaskForestModel

TREES, DEPTH, SEED, TOP, BINS = 300, 20, 20260920, 15, 32


@dataclass(frozen=True)
class Trained:
    """A fitted forest, the names of its features in order, its frozen thresholds by objective, and where it comes from."""

    model: PipelineModel
    features: list[str]
    thresholds: dict[str, float]
    metadata: dict

    def save(self, path: str) -> None:
        """The forest below ``path``/forest and the rest as JSON below ``path``/about, on any storage that Spark writes."""
        self.model.write().overwrite().save(f"{path}/forest")
        about = json.dumps({"features": self.features, "thresholds": self.thresholds, "metadata": self.metadata})
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> Trained:
    about = json.loads(SparkSession.active().read.text(f"{path}/about", wholetext=True).head()[0])
    return Trained(PipelineModel.load(f"{path}/forest"), about["features"], about["thresholds"], about["metadata"])


def train(rows: DataFrame, features: list[str], label: str = "y", trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).head()
    n, p = counts["n"], counts["p"] or 0
    weighted = rows.withColumn("_weight", F.when(F.col(label) == 1, n / max(1, 2 * p)).otherwise(n / max(1, 2 * (n - p))))
    forest = RandomForestClassifier(labelCol=label, featuresCol="_features", weightCol="_weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), forest]).fit(weighted)


def train_wide(rows: DataFrame, features: list[str], label: str = "y", trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """The forest of :func:`train` by :mod:`.forest`: many deep trees of many rows, which the driver never holds. It lives as long as the session."""
    grown = TaskForest(features, labelCol=label, featuresCol="_features", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), grown]).fit(rows)


def bootstrap(rows: DataFrame, tree: Column, label: str, seed: int) -> DataFrame:
    """``rows`` (with a number ``_row``) with ``_n``, how often a row is in the sample of ``tree``: a Poisson count of mean 1 from a hash."""
    u = F.pmod(F.xxhash64("_row", tree, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    below, term, steps = 0.0, exp(-1), []
    for k in range(1, 9):
        below += term
        steps.append((u >= below).cast("int"))
        term /= k
    return rows.withColumn("_n", reduce(Column.__add__, steps))


def tree_balance(rows: DataFrame, label: str, trees: int, seed: int) -> dict[int, dict[int, float]]:
    """For each tree the weight of each label, so that both weigh alike in the tree's own sample."""
    drawn = bootstrap(rows.crossJoin(rows.sparkSession.range(trees).withColumnRenamed("id", "_tree")), F.col("_tree").cast("int"), label, seed)
    sums: dict[int, dict[int, int]] = {}
    for r in drawn.groupBy("_tree", label).agg(F.sum("_n").alias("n")).collect():  # two rows for each tree
        sums.setdefault(r["_tree"], {})[int(r[label])] = r["n"]
    return {t: {y: sum(by.values()) / (len(by) * n) if n else 0.0 for y, n in by.items()} for t, by in sums.items()}


def binned(rows: DataFrame, features: list[str], bins: int = BINS) -> Bucketizer:
    """The bins of all features by quantiles, found in one pass; features with few values have fewer."""
    cuts = rows.approxQuantile(features, [i / bins for i in range(1, bins)], 0.001)
    return Bucketizer(splitsArray=[[-inf, *(sorted(set(c)) or [0.0]), inf] for c in cuts], inputCols=features, outputCols=[f"_bin_{f}" for f in features], handleInvalid="keep")


def train_balanced(rows: DataFrame, features: list[str], label: str = "y", trees: int = TREES, depth: int = DEPTH, seed: int = SEED, at_once: int = 8) -> PipelineModel:
    """A forest whose trees each have a bootstrap sample and a class balance of their own; their probabilities are averaged.

    Rows are binned once and written; ``at_once`` trees are fitted at a time, each as a forest of one tree, and stored. The
    stored trees are read together as one forest of Spark's own kind.
    """
    spark = rows.sparkSession
    first = PipelineModel(stages=[binned(rows, features), VectorAssembler(inputCols=[f"_bin_{f}" for f in features], outputCol="_features")])
    data = materialize(first.transform(rows).select(label, "_features", F.monotonically_increasing_id().alias("_row")), "binned")
    balance, folder = tree_balance(data, label, trees, seed), shared_dir(spark, "trees")

    def grow(t: int) -> None:
        weight = reduce(lambda a, y: F.when(F.col(label) == y, balance[t][y]).otherwise(a), balance[t], F.lit(0.0))
        drawn = bootstrap(data, F.lit(t), label, seed).where("_n > 0").withColumn("_weight", F.col("_n") * weight)
        one = RandomForestClassifier(labelCol=label, featuresCol="_features", weightCol="_weight", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxBins=BINS, maxDepth=depth, minInstancesPerNode=2, seed=seed + t)
        one.fit(drawn).write().save(f"{folder}/{t}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(grow, sorted(balance)))
    forest, of = f"{folder}/forest", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/(?:data|treesMetadata)/[^/]*$", 1).cast("int")
    spark.read.parquet(*(f"{folder}/{t}/data" for t in sorted(balance))).withColumn("treeID", of).coalesce(1).write.parquet(f"{forest}/data")
    spark.read.parquet(*(f"{folder}/{t}/treesMetadata" for t in sorted(balance))).withColumn("_1", of).coalesce(1).write.parquet(f"{forest}/treesMetadata")
    about = json.loads(spark.read.text(f"{folder}/{min(balance)}/metadata").head()[0])
    about["numTrees"] = about["paramMap"]["numTrees"] = len(balance)
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{forest}/metadata")
    out = PipelineModel(stages=[*first.stages, RandomForestClassificationModel.load(forest)])
    fs, at = hadoop(spark, folder)
    fs.delete(at, True)
    return out


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with prob, the probability of label 1."""
    if isinstance(model.stages[-1], TaskForestModel):
        return model.stages[-1].transform(rows)
    out = model.transform(rows).withColumn("prob", F.get(vector_to_array("probability"), F.lit(1)))
    return out.drop("_features", "rawPrediction", "probability", "prediction", *(c for c in out.columns if c.startswith("_bin_")))


def freeze(model: PipelineModel, validation: DataFrame) -> dict[str, float]:
    """Thresholds that are best on the validation part; they are never chosen on the test part."""
    scored = predict(model, validation).select("y", "prob").cache()
    try:
        return {o: metrics.select_threshold(scored, o).head()["threshold"] for o in ("f1", "tss")}
    finally:
        scored.unpersist()


def fit(split: DataFrame, features: list[str], name: str, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, per_tree: bool = False, **about) -> Trained:
    """A forest from a split frame's train part, its thresholds from the val part. The test part is not read.

    ``per_tree``: by :func:`train_balanced`, a job for each tree.
    """
    model = (train_balanced if per_tree else train)(split.where("part = 'train'"), features, trees=trees, depth=depth, seed=seed)
    thresholds = freeze(model, split.where("part = 'val'"))
    sizes = {r["part"]: {"n": r["n"], "base_rate": r["base_rate"]} for r in splits.sizes(split).collect()}  # three rows
    metadata = {
        "trained_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "python": python_version(), "spark": spark_version, "split_name": name, "split_sizes": sizes,
        "estimator": "RandomForestClassifier", "hyperparameters": {"trees": trees, "max_depth": depth, "min_instances": 2, "class_weight": "balanced for each tree" if per_tree else "balanced", "seed": seed},
        "n_features": len(features), "thresholds": {k: round(v, 6) for k, v in thresholds.items()}, "top_features": [{"name": f, "importance": round(w, 6)} for f, w in ranked(model)[:TOP]], **about,
    }
    return Trained(model, features, thresholds, metadata)


def fit_live(rows: DataFrame, features: list[str], **settings) -> tuple[Trained, DataFrame] | None:
    """A forest on dated snapshots alone, and their temporal split; None where no usable split is possible."""
    split = splits.temporal_split(rows)
    spans = split.groupBy("part").agg(F.min("snapshot_date").cast("string").alias("a"), F.max("snapshot_date").cast("string").alias("b")).collect()  # three rows
    if not spans:
        return None
    return fit(split, features, "temporal", live_span={r["part"]: [r["a"], r["b"]] for r in spans}, **settings), split


def ranked(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by importance, the most important first; ties by name."""
    last = model.stages[-1]
    names, weights = model.stages[0].getInputCols(), last.importances if isinstance(last, TaskForestModel) else last.featureImportances.toArray()
    return sorted(((n, float(w)) for n, w in zip(names, weights, strict=True)), key=lambda x: (-x[1], x[0]))


def importances(model: PipelineModel, k: int = TOP) -> DataFrame:
    return SparkSession.active().createDataFrame(ranked(model)[:k], "feature string, importance double")


def path_presence(rows: DataFrame) -> DataFrame:
    """(benign, phishing): of each class the share of URLs with anything but slashes in the path."""
    path = F.substring_index(F.regexp_extract(F.regexp_replace("url", "(?s)^.*?://", ""), "(?s)^[^/]*/(.*)$", 1), "?", 1)
    share = lambda y: metrics.r6(F.avg(F.when(F.col("y") == y, path.rlike("[^/]").cast("double"))))
    return rows.agg(share(0).alias("benign"), share(1).alias("phishing"))


def confound(rows: DataFrame, features: list[str], group: str = "domain", folds: int = 5, trees: int = 200, depth: int = 12) -> DataFrame:
    """(available, n, peak_tss, threshold, breached): the best score of path shape alone, each row scored by a forest that saw none of its group.

    With one label only or fewer than five groups it is not available, and the scores are null.
    """
    spark = rows.sparkSession
    rows = materialize(rows.select("y", group, *features), "confound")  # each fold reads them twice
    have = rows.agg(F.count("*").alias("n"), F.countDistinct("y").alias("labels"), F.countDistinct(group).alias("groups")).head()
    if have["labels"] < 2 or have["groups"] < 5:
        return spark.createDataFrame([(False, have["n"], None, None, None)], "available boolean, n long, peak_tss double, threshold double, breached boolean")
    dealt = rows.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    parts = [predict(train_wide(dealt.where(F.col("_fold") != k), features, trees=trees, depth=depth), dealt.where(F.col("_fold") == k)) for k in range(folds)]
    scored = materialize(reduce(DataFrame.unionByName, parts).select("y", "prob"), "scored")  # each row is scored once
    best = metrics.select_threshold(scored, "tss")
    return best.select(F.lit(True).alias("available"), F.lit(have["n"]).cast("long").alias("n"), metrics.r6(F.col("value")).alias("peak_tss"), metrics.r6(F.col("threshold")).alias("threshold"), (F.col("value") > CONFOUND_CEILING).alias("breached"))
