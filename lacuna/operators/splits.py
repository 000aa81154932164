"""Splits as one ``part`` column: stratified random, group-disjoint, and by time with earlier groups removed.

Orders come from md5(key-seed), so that they are the same wherever they are computed. Greedy quotas need running
totals over groups; they are summed over hash ranges and inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialize

SEED, FRACTIONS = 20260920, (0.70, 0.15)
#: Groups up to which their table is broadcast (some 50 bytes each).
MOST_BROADCAST = 500_000


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(seed)))


def before(df: DataFrame, order: str, size: Column, over: str | None = None) -> DataFrame:
    """``df`` with ``_before``: sum of ``size`` before a row in the order of the hash ``order``, for each value of ``over``."""
    by = [over] if over else []
    df = df.withColumn("_size", size).withColumn("_range", F.substring(order, 1, 3))  # 4096 ranges
    sums = df.groupBy(*by, "_range").agg(F.sum("_size").alias("_sum"))
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(sums, [*by, "_range"]).withColumn("_before", F.col("_base") + F.col("_in")).drop("_size", "_range", "_base", "_in")


def random_split(df: DataFrame, key: str, seed: int = SEED, fractions: tuple[float, float] = FRACTIONS) -> DataFrame:
    """Within each label the first share of a shuffled order is train, the next val, the rest test."""
    sizes = df.groupBy("y").agg(F.count("*").alias("_n"))
    out = before(df.withColumn("_order", F.concat(shuffled(F.col(key), seed), F.coalesce(F.col(key).cast("string"), F.lit("")))), "_order", F.lit(1), "y").join(F.broadcast(sizes), "y")
    train, val = (F.floor(F.col("_n") * F.lit(f)) for f in fractions)
    return out.withColumn("part", F.when(F.col("_before") < train, "train").when(F.col("_before") < train + val, "val").otherwise("test")).drop("_before", "_n", "_order")


def disjoint_split(df: DataFrame, group: str = "domain", seed: int = SEED, fractions: tuple[float, float] = FRACTIONS) -> DataFrame:
    """Whole groups in a shuffled order fill train, then val, to their quotas; the rest is test."""
    sizes = materialize(df.groupBy(group).agg(F.count("*").alias("_n")), "groups")
    have = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).head()
    total = have["rows"]
    sizes = before(sizes.withColumn("_order", F.concat(shuffled(F.col(group), seed), F.coalesce(F.col(group).cast("string"), F.lit("")))), "_order", F.col("_n"))
    in_train = F.col("_before") < F.lit(fractions[0] * total)
    train = sizes.agg(F.coalesce(F.sum(F.when(in_train, F.col("_n"))), F.lit(0)).alias("_t"))
    part = F.when(in_train, "train").when(F.col("_before") - F.col("_t") < F.lit(fractions[1] * total), "val").otherwise("test")
    assign = sizes.crossJoin(F.broadcast(train)).select(F.col(group).alias("_group"), part.alias("part"))  # one row beside each group
    return df.join(beside(assign, have["groups"]), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def beside(groups: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` groups for a join with rows: broadcast up to ``MOST_BROADCAST``, so that a hot group moves no rows; beyond, left to Spark."""
    return F.broadcast(groups) if n <= MOST_BROADCAST else groups


def leaks(split: DataFrame, group: str = "domain") -> DataFrame:
    """Groups that stand in more than one part; a disjoint split has none."""
    return split.groupBy(group).agg(F.countDistinct("part").alias("parts")).where("parts > 1")


def sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("base_rate"))


def temporal_split(rows: DataFrame, day: str = "snapshot_date", group: str = "domain", holdout: float = 0.3, validation: float = 0.2) -> DataFrame:
    """Earliest days train, the latest days test, the end of the training days val; later rows of earlier groups go.

    Empty where a usable split is not possible: fewer than 3 days, an empty part, or a part with one label.
    """
    days = rows.select(day).distinct()  # a row for each day
    w = Window.orderBy(day)
    days = days.select(F.col(day).alias("_day"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_d"))
    held = F.greatest(F.lit(1), F.bround(F.col("_d") * holdout).cast("int"))
    train = F.col("_d") - held
    vals = F.greatest(F.lit(1), F.bround(train * validation).cast("int"))
    part = F.when(F.col("_i") <= train - vals, "train").when(F.col("_i") <= train, "val").otherwise("test")
    days = days.where((F.col("_d") >= 3) & (train >= 2) & (train - vals >= 1)).select("_day", part.alias("part"))
    dealt = rows.join(F.broadcast(days), F.col(day) == F.col("_day")).drop("_day")
    order = F.when(F.col("part") == "train", 0).when(F.col("part") == "val", 1).otherwise(2)
    first = materialize(dealt.groupBy(F.col(group).alias("_group")).agg(F.min(order).alias("_first")), "groups")
    kept = dealt.join(beside(first, first.count()), F.col(group).eqNullSafe(F.col("_group"))).where(order == F.col("_first")).drop("_group", "_first")
    usable = kept.groupBy("part").agg(F.countDistinct("y").alias("l")).agg((F.count_if(F.col("l") >= 2) == 3).alias("ok"))
    return kept.crossJoin(F.broadcast(usable)).where("ok").drop("ok")  # one row beside each


def readiness(rows: DataFrame, day: str = "snapshot_date", group: str = "domain", min_days: int = 14, min_rows: int = 400, min_positives: int = 100) -> DataFrame:
    """(ready, reason, n_days, n_rows, days_needed); the first reason that holds is given."""
    base = rows.agg(F.countDistinct(day).alias("n_days"), F.count("*").alias("n_rows"))
    part = temporal_split(rows, day, group)
    sums = {f"{p}_{k}": c for p in ("train", "test") for k, c in (("n", F.count_if(F.col("part") == p)), ("p", F.count_if((F.col("part") == p) & (F.col("y") == 1))))}
    x = base.crossJoin(part.agg(*(c.alias(k) for k, c in sums.items())))  # one row by one row
    reason = (
        F.when(F.col("n_rows") == 0, "no rows").when(F.col("n_days") < min_days, "too few days").when(F.col("train_n") == 0, "no split")
        .when(F.col("train_n") < min_rows, "train rows").when(F.col("train_p") < min_positives, "train positives")
        .when(F.col("test_n") < min_rows, "holdout rows").when(F.col("test_p") < min_positives, "holdout positives").otherwise("ready")
    )
    return x.select((reason == "ready").alias("ready"), reason.alias("reason"), "n_days", "n_rows", F.greatest(F.lit(min_days) - F.col("n_days"), F.lit(0)).cast("long").alias("days_needed"))
