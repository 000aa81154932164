"""Registrable domains: the longest public-suffix rule of a host, looked up in each row without a shuffle.

A rule has at most :attr:`Rules.depth` labels, so a host's last label, last two labels and so on are looked up in turn:
one broadcast join for each number of labels, and no host is grouped or moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rules their table is broadcast; it holds one row for each rule.
MOST_BROADCAST = 50_000
PLAIN, WILDCARD, EXCEPTION = 1, 2, 4


@dataclass(frozen=True)
class Rules:
    """``frame``: (rule, kinds), one row for each rule, with its kinds as bits; ``depth``: labels of the longest; ``rows``: how many."""

    frame: DataFrame
    depth: int
    rows: int


def parse_rules(spark: SparkSession, lines: list[str]) -> Rules:
    """Rules from the lines of a list: ``rule``, ``*.rule`` or ``!rule``; names in other scripts count in both spellings."""
    found: dict[str, int] = {}
    for line in lines:
        word = line.split()[0] if line.strip() and not line.startswith("//") else ""
        kind = WILDCARD if word.startswith("*.") else EXCEPTION if word.startswith("!") else PLAIN
        rule = word.removeprefix("*.").removeprefix("!").lower()
        for spelt in {rule, *([] if rule.isascii() else [rule.encode("idna").decode()])} - {""}:
            found[spelt] = found.get(spelt, 0) | kind
    depth = max((r.count(".") + 1 for r in found), default=1)
    return Rules(spark.createDataFrame(sorted(found.items()), "rule string, kinds int"), depth, len(found))


def official(text: str) -> list[str]:
    """The lines of a public suffix list before its private section."""
    return text.split("===BEGIN PRIVATE", 1)[0].splitlines()


def read_rules(spark: SparkSession, path: str) -> Rules:
    """Rules of a public suffix list in its usual text format, on storage that Spark reads; a list has some ten thousand lines."""
    return parse_rules(spark, official(spark.read.text(path, wholetext=True).head()[0]))


_known: dict[str, Rules] = {}


def default_rules(spark: SparkSession) -> Rules:
    """The public suffix list that comes with Spark's own libraries."""
    context = spark.sparkContext
    if context.applicationId not in _known:
        stream = context._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
        if stream is None:
            raise ValueError("this Spark has no public suffix list: give rules, as of read_rules()")
        _known.clear()
        _known[context.applicationId] = parse_rules(spark, official(context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    return _known[context.applicationId]


def last_labels(host: Column, n: Column | int) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -(F.lit(n) if isinstance(n, int) else n))


def with_suffix(df: DataFrame, host_col: str = "host", rules: Rules | None = None) -> DataFrame:
    """``df`` with subdomain, label, suffix and registrable (the host itself for addresses and where nothing is left)."""
    rules = rules or default_rules(df.sparkSession)
    address = F.col("_h").rlike(r"^\p{Nd}{1,3}(\.\p{Nd}{1,3}){3}$")
    df = df.withColumn("_h", F.coalesce(F.col(host_col), F.lit("")))
    df = df.withColumns({"_size": F.length("_h") - F.length(F.replace("_h", F.lit("."), F.lit(""))) + 1, "_address": address})
    for k in range(1, rules.depth + 1):
        of = rules.frame.where(F.length("rule") - F.length(F.replace("rule", F.lit("."), F.lit(""))) + 1 == k).select(F.col("rule").alias(f"_r{k}"), F.col("kinds").alias(f"_k{k}"))
        tail = F.when((F.col("_size") >= k) & ~F.col("_address"), last_labels(F.col("_h"), k))
        df = df.join(F.broadcast(of) if rules.rows <= MOST_BROADCAST else of, tail == F.col(f"_r{k}"), "left").drop(f"_r{k}")
    none, deep = F.lit(""), range(rules.depth, 0, -1)
    has = lambda k, kind: F.coalesce(F.col(f"_k{k}").bitwiseAND(kind) != 0, F.lit(False))
    # An exception wins; else the rule with most labels, a wildcard's being one more than it names.
    lengths = [F.when(has(k, EXCEPTION), k - 1) for k in deep]
    lengths += [F.greatest(*(F.when(has(k, WILDCARD) & (F.col("_size") > k), k + 1).when(has(k, PLAIN), k).otherwise(0) for k in deep), F.lit(0))]
    df = df.withColumn("_n", F.coalesce(*lengths)).drop(*(f"_k{k}" for k in deep))
    df = df.withColumn("suffix", F.when(F.col("_n") > 0, last_labels(F.col("_h"), F.col("_n"))).otherwise(none))
    rest = F.when(F.col("_n") == 0, F.col("_h")).otherwise(F.substring(F.col("_h"), F.lit(1), F.greatest(F.length("_h") - F.length("suffix") - 1, F.lit(0))))
    df = df.withColumn("_rest", rest)
    df = df.withColumn("label", F.when(F.col("_address"), F.col("_h")).otherwise(last_labels(F.col("_rest"), 1)))
    sub = F.substring(F.col("_rest"), F.lit(1), F.greatest(F.length("_rest") - F.length("label") - 1, F.lit(0)))
    df = df.withColumn("subdomain", F.when(F.col("_address"), none).otherwise(sub))
    joined = F.array_join(F.filter(F.array("label", "suffix"), lambda x: x != ""), ".")
    return df.withColumn("registrable", F.when(joined != "", joined).otherwise(F.col("_h"))).drop("_h", "_size", "_address", "_n", "_rest")
