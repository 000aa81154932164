"""Scores of a frame (y, prob, grp): confusion at a threshold, sweeps, chosen thresholds and bootstrap intervals.

A row is flagged if ``prob >= threshold``. Ratios with nothing below the line are 0. Sweeps are exact over the
distinct probabilities; ties between thresholds go to the highest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import md5_words
from ..sources.shared import materialize, opened, removed_at_exit, shared_dir
from .order import ranked

#: Parts of 0 to 1 over which a sweep sums first, and classes of a block.
CELLS, BLOCK = 1 << 16, 20_000
#: Draws that are hashed at once; bytes of the classes of groups that a task holds, classes that have numbers, and groups that are packed at once.
RUN, TILE, CLASSES, PLACES = 10_000, 64 << 20, 1 << 16, 1 << 18


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def confusion(threshold: Column | float) -> list[Column]:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos = F.col("prob") >= thr, F.col("y") == 1
    return [F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")]


def derived() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, far, precision = ratio(tp, tp + fn), ratio(fp, fp + tn), ratio(tp, tp + fp)
    return {"recall": recall, "false_alarm_rate": far, "precision": precision, "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "tss": recall - far}


def score_at(scored: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """One row of scores, or one for each value of ``by``."""
    return scores(scored.withColumn("threshold", F.lit(float(threshold))), by)


def scores(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores at the column ``threshold``, which is one for each value of ``by``."""
    brier = F.avg(F.pow(F.col("prob") - F.col("y"), F.lit(2.0)))
    keys = by or []  # within which there is one threshold
    out = scored.groupBy(*keys).agg(F.max("threshold").alias("threshold"), F.count("*").alias("n"), F.avg("y").alias("b"), *confusion(F.col("threshold")), brier.alias("br"))
    d = derived()
    b = F.col("b")
    skill = F.when(b * (1 - b) > 0, 1 - F.col("br") / (b * (1 - b))).otherwise(0.0)
    return out.select(*keys, "n", r6(b).alias("base_rate"), "threshold", "tp", "fp", "fn", "tn", *(r6(c).alias(k) for k, c in d.items()), r6(F.col("br")).alias("brier"), r6(skill).alias("brier_skill"))


def sweep(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(prob, tp, fp, fn, tn, ratios) at each distinct probability as threshold, for each value of ``by``.

    The input is read once, into counts for each probability. Running counts are summed over ``CELLS`` equal parts of
    0 to 1, whatever the input's size, and inside a part.
    """
    by = by or []
    cell = F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob"))) * CELLS), F.lit(-1)).cast("int")
    counts = scored.groupBy(*by, "prob").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("q")).withColumn("_cell", cell)
    sums = counts.groupBy(*by, "_cell").agg(F.sum("p").alias("gp"), F.sum("q").alias("gq"))  # CELLS rows at most for each value
    total = Window.partitionBy(*by)
    down = total.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_cell", F.coalesce(F.sum("gp").over(down), F.lit(0)).alias("bp"), F.coalesce(F.sum("gq").over(down), F.lit(0)).alias("bq"), F.sum("gp").over(total).alias("all_p"), F.sum("gq").over(total).alias("all_q"))
    inside = Window.partitionBy(*by, "_cell").orderBy(F.col("prob").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("p", F.sum("p").over(inside)).withColumn("q", F.sum("q").over(inside)).join(F.broadcast(sums) if not by else sums, [*by, "_cell"])
    out = out.select(*by, "prob", (F.col("bp") + F.col("p")).alias("tp"), (F.col("bq") + F.col("q")).alias("fp"), "all_p", "all_q").withColumns({"fn": F.col("all_p") - F.col("tp"), "tn": F.col("all_q") - F.col("fp")})
    return out.select(*by, "prob", "tp", "fp", "fn", "tn", *(r6(c).alias(k) for k, c in derived().items()))


def select_threshold(scored: DataFrame, objective: str, by: list[str] | None = None) -> DataFrame:
    """(threshold, value): the best threshold of the sweep for ``f1`` or ``tss``, for each value of ``by``."""
    best = F.max(F.struct(F.col(objective).alias("value"), F.col("prob").alias("threshold"))).alias("x")
    return sweep(scored, by).groupBy(*(by or [])).agg(best).select(*(by or []), "x.threshold", "x.value")


def group_confusion(scored: DataFrame, threshold: float, group: str = "grp") -> DataFrame:
    return scored.groupBy(group).agg(*confusion(threshold))


def run_of(r: int) -> tuple[str, int, int]:
    """Run ``r`` of the numbers from 0 on: what its numbers begin with, and the first and last of the digits that follow; up to four digits differ."""
    return ("", 10**r if r else 0, 10 ** (r + 1)) if r < 4 else (str(r - 3), 0, RUN)


def runs_below(n: int) -> int:
    return sum(run_of(r)[1] < n for r in range(4)) if n <= RUN else 3 + -(-n // RUN)


_held: dict[str, np.ndarray] = {}


def tile_of(path: str, kind: str) -> np.ndarray:
    """One tile, which a worker keeps until it needs another."""
    if path not in _held:
        _held.clear()
        fs, at = opened(path)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".parquet")]
        parts = sorted((p, c) for f in files for t in [pq.read_table(f, filesystem=fs, partitioning=None)] for p, c in zip(t["part"].to_pylist(), t["codes"].to_pylist(), strict=True))
        _held[path] = np.frombuffer(b"".join(c for _, c in parts), dtype=kind)
    return _held[path]


def resamples(groups: DataFrame, n_resamples: int, seed: int, group: str = "grp", tile: int = TILE, classes: int = CLASSES) -> DataFrame:
    """(b, tss): for each resample the score over groups drawn with replacement.

    Groups are numbered by key; draw ``k`` of resample ``b`` is a hash of (b, k, seed) modulo the number of groups. Draws are
    never rows: a task hashes runs of them and looks them up in an array by place, which it reads from the shared folder,
    and sends one row of sums for each resample. The array has the number of each group's class (groups with the same counts)
    if there are ``classes`` at most, else the counts. More than ``tile`` bytes come in tiles of places; draws are hashed for each tile.
    """
    spark, four = groups.sparkSession, ["tp", "fp", "fn", "tn"]
    groups = materialize(groups, "groups")
    n, schema = groups.count(), "b long, tp long, fp long, fn long, tn long"
    distinct = sorted(map(tuple, groups.select(*four).distinct().limit(classes + 1).collect()))
    narrow = len(distinct) <= classes
    counts = np.array(distinct if narrow else [], dtype=np.int64).reshape(-1, 4)
    places = ranked(groups, [F.col(group)], "_i").withColumn("_i", F.col("_i") - 1)
    if narrow and distinct:
        numbers = spark.createDataFrame([(*c, i) for i, c in enumerate(distinct)], "tp long, fp long, fn long, tn long, _class int")
        places = places.join(F.broadcast(numbers), four)
    columns = ["_class"] if narrow and distinct else four
    kind = "<i8" if not narrow else "u1" if len(distinct) <= 1 << 8 else "<u2"
    each = max(1, tile // (np.dtype(kind).itemsize * len(columns)))  # places of a tile
    n_tiles, n_runs = -(-n // each), runs_below(n)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, rows.sort_values("_i")[columns].to_numpy().astype(kind).tobytes())], columns=["tile", "part", "codes"])

    path = shared_dir(spark, "tiles")
    removed_at_exit(spark, path)
    packed = places.groupBy(F.floor(F.col("_i") / each).alias("tile"), F.floor(F.col("_i") % each / PLACES).alias("part"))  # PLACES rows each
    packed.applyInPandas(pack, "tile long, part long, codes binary").write.partitionBy("tile").parquet(path)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for number in batch["id"].tolist():
                t, rest = divmod(number, n_resamples * n_runs)
                b, r = divmod(rest, n_runs)
                begin, first, last = run_of(r)
                words = md5_words(f"{b}-{begin}", first, last, f"-{seed}")[: n - (int(begin or 0) * RUN + first)]
                at = (words % np.uint32(n) if n < 1 << 32 else words).astype(np.int64)
                held = tile_of(f"{path}/tile={t}", kind)
                if n_tiles > 1:
                    at = at[at // each == t] - t * each
                taken = np.bincount(held[at], minlength=len(counts)) @ counts if narrow else held.reshape(-1, 4)[at].sum(axis=0)
                sums[b] = sums.get(b, 0) + taken
            yield pd.DataFrame([(b, *x.tolist()) for b, x in sums.items()], columns=["b", *four])

    asked = n_tiles * n_resamples * n_runs
    parts = max(1, min(-(-asked // 64), 8 * spark.sparkContext.defaultParallelism))
    out = spark.range(0, asked, 1, parts).mapInPandas(draw, schema).groupBy("b").agg(*(F.sum(c).alias(c) for c in four))
    return out.select("b", derived()["tss"].alias("tss"))


def resampled_counts(groups: DataFrame, n_resamples: int, seed: int, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """(b, tss) like :func:`resamples`, for each value of ``by``, without a draw for each group.

    Groups with the same counts are one class. How often a resample takes each class is a multinomial count: first for
    blocks of about ``block`` classes, then inside each block. So a resample costs a number for each class, four where
    groups are rows, whatever the number of groups. Intervals differ from drawn ones as those of two seeds do.
    """
    spark, of = groups.sparkSession, F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    four = ["tp", "fp", "fn", "tn"]
    classes = materialize(groups.groupBy(of.alias("_of"), *four).agg(F.count("*").alias("m")), "classes")
    blocks = -(-max(1, classes.count()) // block)
    classes = classes.withColumn("_k", F.pmod(F.xxhash64(*four), F.lit(blocks)).cast("int"))
    sizes = classes.groupBy("_of", "_k").agg(F.sum("m").alias("m")).groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("_k", "m"))).alias("x"))  # a number for each block
    asked = spark.range(n_resamples).withColumnRenamed("id", "b").crossJoin(sizes)  # resamples beside a row for each value of `by`

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value, b, x in zip(batch["_of"], batch["b"], batch["x"], strict=True):
                m = np.array([r["m"] for r in x], dtype=np.int64)
                n = np.random.default_rng([seed, b, zlib.crc32(value.encode())]).multinomial(m.sum(), m / m.sum())
                yield pd.DataFrame({"_of": value, "_k": [r["_k"] for r in x], "b": b, "n": n})

    def draw(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(four)
        counts, m = rows[four].to_numpy(np.int64), rows["m"].to_numpy(np.int64)
        out = []
        for value, k, b, n in zip(asked["_of"], asked["_k"], asked["b"], asked["n"], strict=True):
            taken = np.random.default_rng([seed, b, k + 1, zlib.crc32(value.encode())]).multinomial(n, m / m.sum())
            out.append((value, b, *(taken @ counts).tolist()))
        return pd.DataFrame(out, columns=["_of", "b", *four])

    dealt = asked.mapInPandas(deal, "_of string, _k int, b long, n long").groupBy("_of", "_k")
    out = classes.groupBy("_of", "_k").cogroup(dealt).applyInPandas(draw, "_of string, b long, tp long, fp long, fn long, tn long")
    out = out.groupBy("_of", "b").agg(*(F.sum(c).alias(c) for c in four)).select(F.col("_of").alias(by or "_of"), "b", derived()["tss"].alias("tss"))
    return out if by else out.drop("_of")


def interval(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    return samples.groupBy(*(by or [])).agg(r6(F.percentile("tss", F.lit(0.025))).alias("lo"), r6(F.percentile("tss", F.lit(0.975))).alias("hi"))


def resampled(scored: DataFrame, threshold: float, group: str | None, n_resamples: int, seed: int, key: str, draw: str) -> DataFrame:
    if draw == "counts" and group is None:
        one = lambda c: F.col(c).cast("long").alias(c)
        rows = scored.select(((F.col("prob") >= threshold).alias("hit")), (F.col("y") == 1).alias("pos")).select((F.col("hit") & F.col("pos")).alias("tp"), (F.col("hit") & ~F.col("pos")).alias("fp"), (~F.col("hit") & F.col("pos")).alias("fn"), (~F.col("hit") & ~F.col("pos")).alias("tn"))
        return resampled_counts(rows.select(*map(one, ("tp", "fp", "fn", "tn"))), n_resamples, seed)
    groups = group_confusion(scored, threshold, group or key)
    return resampled_counts(groups, n_resamples, seed) if draw == "counts" else resamples(groups, n_resamples, seed, group or key)


def bootstrap_ci(scored: DataFrame, threshold: float, group: str | None = "grp", n_resamples: int = 1000, seed: int = 20260920, key: str = "row_id", draw: str = "counts") -> DataFrame:
    """(lo, hi): 95 % percentile interval of the score over resampled groups, or rows where ``group`` is None.

    ``draw``: ``counts`` (a number for each class of groups) or ``groups`` (a hash for each draw, which SQL can repeat).
    """
    return interval(resampled(scored, threshold, group, n_resamples, seed, key, draw))


def linear_error(groups: DataFrame) -> DataFrame:
    """(point, error): the score over all groups, and its standard error by the groups' linear influence on it."""
    total = groups.agg(*(F.sum(c).alias(f"a_{c}") for c in ("tp", "fp", "fn", "tn"))).select(F.col("a_tp"), F.col("a_fp"), (F.col("a_tp") + F.col("a_fn")).alias("a_p"), (F.col("a_fp") + F.col("a_tn")).alias("a_q"))
    recall, far = ratio(F.col("a_tp"), F.col("a_p")), ratio(F.col("a_fp"), F.col("a_q"))
    share = ratio(F.col("tp") - recall * (F.col("tp") + F.col("fn")), F.col("a_p")) - ratio(F.col("fp") - far * (F.col("fp") + F.col("tn")), F.col("a_q"))
    return groups.crossJoin(F.broadcast(total)).agg(F.max(recall - far).alias("point"), F.sqrt(F.sum(share * share)).alias("error"))  # one row beside each


def difference_ci(a: DataFrame, thr_a: float, b: DataFrame, thr_b: float, group: str = "grp", n_resamples: int = 1000, seed: int = 20260920, draw: str = "counts") -> DataFrame:
    """(point, lo, hi, excludes_zero) of score(a) - score(b); both sides are resampled by themselves."""
    point = score_raw(a, thr_a).crossJoin(score_raw(b, thr_b).withColumnRenamed("tss", "tss_b"))  # one row by one row
    x = resampled(a, thr_a, group, n_resamples, seed, "", draw)
    y = resampled(b, thr_b, group, n_resamples, seed + 1, "", draw).withColumnRenamed("tss", "other")
    both = interval(x.join(y, "b").select((F.col("tss") - F.col("other")).alias("tss")))
    return point.crossJoin(both).select(r6(F.col("tss") - F.col("tss_b")).alias("point"), "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


def score_raw(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(*confusion(threshold)).select(derived()["tss"].alias("tss"))
