"""Dated snapshots (url, y, source, snapshot_date, domain): deduplication, growth and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order in which a day's streams are taken; the first row of a URL wins.
STREAMS = ["openphish", "urlhaus", "commoncrawl", "tranco_templated"]
PHISH, BENIGN = "openphish", "commoncrawl"


def first_seen(rows: DataFrame, sources: list[str] | None = None, key: str = "url", tie: str = "page_id") -> DataFrame:
    """The earliest row of each URL. Sources are filtered first: a URL first seen elsewhere stays under its other source."""
    if sources is not None:
        rows = rows.where(F.col("source").isin(sources))
    others = [c for c in rows.columns if c != key]
    # A minimum is combined before the shuffle, which a window is not.
    best = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("snapshot_date", tie)).alias("_x"))
    return best.select(*(F.col("_x")[c].alias(c) if c != key else F.col(c) for c in rows.columns))


def within_day(rows: DataFrame, key: str = "url", tie: str = "page_id") -> DataFrame:
    """One row of each URL and day: the first by stream, then by position."""
    others = [c for c in rows.columns if c not in (key, "snapshot_date")]
    rank = F.array_position(F.array(*map(F.lit, STREAMS)), F.col("source"))
    best = rows.groupBy("snapshot_date", key).agg(F.min_by(F.struct(*others), F.struct(rank, F.col(tie))).alias("_x"))
    return best.select(*(F.col(c) if c in (key, "snapshot_date") else F.col("_x")[c].alias(c) for c in rows.columns))


def timeline(rows: DataFrame, tie: str = "page_id") -> DataFrame:
    """A row for each day: new and cumulative rows, positives and distinct domains; each URL counts on its first day."""
    new = first_seen(rows, tie=tie)
    days = new.groupBy("snapshot_date").agg(F.count("*").alias("new_rows"), F.sum(F.col("y").cast("long")).alias("new_phishing"))
    domains = new.where("domain is not null").groupBy("domain").agg(F.min("snapshot_date").alias("snapshot_date")).groupBy("snapshot_date").agg(F.count("*").alias("new_domains"))
    running = Window.orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    out = days.join(domains, "snapshot_date", "left").na.fill(0, ["new_domains"])
    return out.select("snapshot_date", "new_rows", "new_phishing", F.sum("new_rows").over(running).alias("cumulative_rows"), F.sum("new_phishing").over(running).alias("cumulative_phishing"), F.sum("new_domains").over(running).alias("cumulative_domains"))


def timeline_document(days: DataFrame) -> DataFrame:
    """The timeline as one JSON document; it holds a struct for each day."""
    row = F.struct(*days.columns)
    return days.agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("days"))).alias("document"))


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def provenance(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.countDistinct("domain").alias("n_domains"), F.sum(F.col("y").cast("long")).alias("n_phishing"), F.countDistinct("snapshot_date").alias("n_days"), F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day"))


def headline(rows: DataFrame) -> DataFrame:
    return rows.where(((F.col("y") == 1) & (F.col("source") == PHISH)) | ((F.col("y") == 0) & (F.col("source") == BENIGN)))


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """At most k rows of each group; Spark keeps k of each in every task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def error_histogram(errors: DataFrame, column: str = "error") -> DataFrame:
    return errors.groupBy(column).agg(F.count("*").alias("n"))


def snapshot(day: str, seen: str, feeds: dict[str, DataFrame], ranking: DataFrame, pages: DataFrame, n_realistic: int = 300, n_templated: int = 300) -> tuple[DataFrame, DataFrame]:
    """One day's labelled sample (url, y, source, first_seen_utc, snapshot_date), and its statistics (name, n).

    ``feeds``: frames of positive URLs by source. ``ranking`` (domain) is taken in an order shuffled by the day: templated
    URLs come from the domains after the first ``n_realistic``. ``pages`` (url) are the benign pages; the first
    ``n_realistic`` in the day's order are taken. Of a URL that comes more than once the first source's row stays.
    """
    shuffled = lambda c: F.md5(F.concat_ws("-", c, F.lit(day)))
    realistic = pages.select("url").where("url is not null").distinct().orderBy(shuffled("url"), "url").limit(n_realistic)
    drawn = ranking.select("domain").distinct().orderBy(shuffled("domain"), "domain").limit(n_realistic + n_templated)
    templated = drawn.withColumn("n", F.row_number().over(Window.orderBy(shuffled("domain"), "domain"))).where(F.col("n") > n_realistic)  # a day's sample
    parts = {**{k: f.select("url").withColumn("y", F.lit(1)) for k, f in feeds.items()}, BENIGN: realistic.withColumn("y", F.lit(0)), "tranco_templated": templated.select(F.concat(F.lit("https://www."), "domain").alias("url"), F.lit(0).alias("y"))}
    rows = reduce(DataFrame.unionByName, (f.withColumn("source", F.lit(k)) for k, f in parts.items()))
    stamp = F.lit(seen).cast("timestamp").alias("first_seen_utc")
    rows = rows.select("url", "y", "source", stamp, F.lit(day).cast("date").alias("snapshot_date"))
    kept = within_day(rows, tie="y")
    counts = rows.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).unionByName(kept.agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), "n"))
    return kept, counts
