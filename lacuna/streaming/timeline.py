"""The timeline of snapshots kept by a stream, whatever the order in which files arrive.

Known of a URL is its earliest row, and of a domain its earliest day. A row that comes late and is earlier than what was
known takes its day's counts back and adds them to the new day. What is known is a table beside the checkpoint's offsets:
each micro-batch is joined to it by one grouping, without Python, and writes its next version, in which the rows that
the batch changed are marked. From them come the changes by day and the totals of all days, a small table with versions of
its own. A repeated batch starts from the version before it and writes the same ones again. A batch costs time for its rows
and for each key that is known.

A URL's domain does not change. A null URL is a URL; a null domain is not counted. Repeated rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import hadoop

ROW = "kind string, key string, day int, tie long, y long"
KNOWN = ROW + ", changed boolean, old_day int, old_y long"
CHANGE = "day int, rows long, phishing long, domains long"


def keyed(rows: DataFrame, tie: str = "page_id") -> DataFrame:
    """Rows (url, y, domain, snapshot_date and ``tie``) as a row for the URL and one for the domain, with days since 1970."""
    one = lambda kind, key, order, y: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.unix_date("snapshot_date").alias("day"), order.cast("long").alias("tie"), y.cast("long").alias("y"))
    pair = F.array(one("url", F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")), F.col(tie), F.coalesce("y", F.lit(0))), one("domain", F.col("domain"), F.lit(0), F.lit(0)))
    return rows.where("snapshot_date is not null").select(F.explode(pair).alias("x")).select("x.*").where("key is not null")


def learned(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What is known after keyed rows came to it; of keys that they changed also what was known before."""
    both = rows.withColumn("new", F.lit(True)).unionByName(known.select(*rows.columns).withColumn("new", F.lit(False)))
    least = lambda new: F.min(F.when(F.col("new") == new, F.struct("day", "tie", "y")))
    # Minima are combined before the shuffle, so a hot domain sends one row for each task.
    best = both.groupBy("kind", "key").agg(least(True).alias("a"), least(False).alias("b"))
    earlier = F.col("b").isNull() | (F.struct("a.day", "a.tie") < F.struct("b.day", "b.tie"))
    best = best.withColumn("changed", F.col("a").isNotNull() & earlier)
    now, old = F.when(F.col("changed"), F.col("a")).otherwise(F.col("b")), F.when(F.col("changed"), F.col("b"))
    return best.select("kind", "key", *(now[c].alias(c) for c in ("day", "tie", "y")), "changed", old["day"].alias("old_day"), old["y"].alias("old_y"))


def changes(known: DataFrame) -> DataFrame:
    """Changes of the counts by day (days since 1970) from what a batch changed."""
    url = (F.col("kind") == "url").cast("long")
    one = lambda day, sign, y: F.struct(F.col(day).alias("day"), (sign * url).alias("rows"), (sign * url * F.col(y)).alias("phishing"), (sign * (1 - url)).alias("domains"))
    return known.where("changed").select(F.explode(F.array(one("day", 1, "y"), one("old_day", -1, "old_y"))).alias("x")).select("x.*").where("day is not null")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of the totals, ascending."""
    fs, at = hadoop(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(hadoop(spark, f"{path}/{n}/_SUCCESS")[1]))


def removed(spark: SparkSession, path: str, gone: list[int]) -> None:
    for v in gone:
        fs, at = hadoop(spark, f"{path}/v{v}")
        fs.delete(at, True)


def merged(path: str):
    """A micro-batch's changes added to the totals before it: version ``batch`` of the table below ``path``."""

    def merge(delta: DataFrame, batch: int) -> None:
        spark = delta.sparkSession
        older = [v for v in versions(spark, path) if v < batch]
        totals = delta if not older else delta.unionByName(spark.read.parquet(f"{path}/v{older[-1]}"))
        totals = totals.groupBy("day").agg(*(F.sum(c).alias(c) for c in ("rows", "phishing", "domains")))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/v{batch}")  # a row for each day
        removed(spark, path, older[:-1])

    return merge


def kept(known: str, out: str, tie: str = "page_id"):
    """A micro-batch's rows added to what is known: version ``batch`` below ``known``, and of the totals below ``out``."""

    def keep(rows: DataFrame, batch: int) -> None:
        spark, path = rows.sparkSession, f"{known}/v{batch}"
        older = [v for v in versions(spark, known) if v < batch]
        if batch and older[-1:] != [batch - 1]:
            raise ValueError(f"what was known before batch {batch} is not below {known}")
        seen = keyed(rows, tie)
        before = spark.read.schema(KNOWN).parquet(f"{known}/v{older[-1]}") if older else seen.where("false")
        learned(seen, before).write.mode("overwrite").parquet(path)
        merged(out)(changes(spark.read.schema(KNOWN).parquet(path)), batch)
        removed(spark, known, older[:-1])

    return keep


def run_timeline(rows: DataFrame, out: str, checkpoint: str, tie: str = "page_id", parts: int | None = None) -> None:
    """Take in what has arrived and stop; the next call goes on from there.

    What is known is dealt into ``parts`` parts, or the session's number if that is larger.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.shuffle.partitions"
    held = conf.get(name)
    conf.set(name, str(max(int(held), parts or 0)))
    try:
        rows.writeStream.foreachBatch(kept(f"{checkpoint}/known", out, tie)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, held)


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """A row for each day from the newest totals: new and cumulative rows, positives and distinct domains."""
    newest = versions(spark, path)
    if not newest:
        return spark.createDataFrame([], "snapshot_date date, new_rows long, new_phishing long, cumulative_rows long, cumulative_phishing long, cumulative_domains long")
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    total = lambda c: F.sum(c).over(running)
    days = spark.read.parquet(f"{path}/v{newest[-1]}").select("day", "rows", "phishing", total("rows").alias("a"), total("phishing").alias("b"), total("domains").alias("c"))
    return days.where("rows > 0").select(F.date_from_unix_date("day").alias("snapshot_date"), F.col("rows").alias("new_rows"), F.col("phishing").alias("new_phishing"), F.col("a").alias("cumulative_rows"), F.col("b").alias("cumulative_phishing"), F.col("c").alias("cumulative_domains"))
