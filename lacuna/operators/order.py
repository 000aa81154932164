"""Places in a global order and as-of joins: one shuffle by ranges, and a row for each partition to carry on from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialize


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted and written once, with ``name``: an id that ascends with the order; its upper bits are the partition's number."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "ordered")


def part_of(name: str) -> Column:
    return F.shiftright(name, 33)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` (on storage that gives the same rows twice) with ``name``: each row's place in the order, from 1.

    A row's number inside its partition stands in its id, and the rows before come from a total for each partition.
    """
    out = in_order(df, order, name)
    sizes = sorted((r["p"], r["n"]) for r in out.groupBy(part_of(name).alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    bases = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _base long")
    place = F.col("_base") + F.col(name).bitwiseAND((1 << 33) - 1) + 1
    return out.join(F.broadcast(bases), part_of(name) == F.col("_part")).withColumn(name, place).drop("_part", "_base")


def asof(left: DataFrame, right: DataFrame, on: str, name: str, strict: bool = True) -> DataFrame:
    """``left`` with ``name``: the other columns of the last row of ``right`` whose key is below its own, or at most its own where not ``strict``.

    Both sides' keys are sorted together. Within a partition the last row of ``right`` is carried on by a window; into a
    partition it comes from the ones before, as one row for each of them. Each distinct key of ``left`` is looked up once.
    Keys of ``right`` should be distinct. A null key finds nothing.
    """
    others = [c for c in right.columns if c != on]
    keys = left.where(F.col(on).isNotNull()).select(on).distinct().select(F.col(on).alias("_k"), F.lit(0 if strict else 2).alias("_side"), F.lit(None).cast(right.select(F.struct(*others).alias("x")).schema["x"].dataType).alias("_r"))
    rows = keys.unionByName(right.where(F.col(on).isNotNull()).select(F.col(on).alias("_k"), F.lit(1).alias("_side"), F.struct(*others).alias("_r")))
    rows = in_order(rows, [F.col("_k"), F.col("_side")], "_at").withColumn("_part", part_of("_at"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lasts = rows.groupBy("_part").agg(F.max_by("_r", F.when(F.col("_side") == 1, F.col("_at"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    lasts = lasts.select("_part", F.last("_last", True).over(before).alias("_before"))
    found = rows.withColumn("_in", F.last("_r", True).over(inside)).where("_side <> 1").join(F.broadcast(lasts), "_part")
    found = found.select("_k", F.coalesce("_in", "_before").alias(name))
    return left.join(found, F.col(on) == F.col("_k"), "left").drop("_k")
