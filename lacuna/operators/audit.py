"""Construction audits of a labelled corpus (url, y): how much of the label the form of the string gives away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import TEMPLATE
from .metrics import derived, r6

PROPERTIES = ["is_https", "has_www", "has_path", "has_query"]


def template_probability(corpus: DataFrame) -> DataFrame:
    """The rule as a model: 0 where the URL has the template's form, else 1."""
    return corpus.withColumn("prob", F.when(F.coalesce("url", F.lit("")).rlike(TEMPLATE), 0.0).otherwise(1.0))


def template_audit(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    form, pos = F.col("prob") == 0.0, F.col("y") == 1
    out = template_probability(corpus).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(~form & pos).alias("tp"), F.count_if(~form & ~pos).alias("fp"), F.count_if(form & pos).alias("fn"), F.count_if(form & ~pos).alias("tn"))
    share = lambda a, b: r6(F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0)))
    keep = ("recall", "false_alarm_rate", "precision", "accuracy", "tss")
    return out.select(*(by or []), "n", "tp", "fp", "fn", "tn", share("tn", "fp").alias("benign_template_share"), share("fn", "tp").alias("phish_template_share"), *(r6(derived()[k]).alias(k) for k in keep))


def properties(corpus: DataFrame) -> DataFrame:
    """The four surface properties; the scheme counts wherever ``://`` stands in the string."""
    from ..functions.urls import with_parts

    full = F.when(F.contains("url", F.lit("://")), F.col("url")).otherwise(F.concat(F.lit("http://"), "url"))
    p = with_parts(corpus.withColumn("_url", full), "_url").drop("_url", "u")
    return p.withColumns({"is_https": F.col("scheme") == "https", "has_www": F.col("host").startswith("www."), "has_path": F.length(F.regexp_replace("path", "/+$", "")) > 0, "has_query": F.col("query") != ""})


def structural_rates(corpus: DataFrame) -> DataFrame:
    """(property, benign, phishing, separation, verdict); the first verdict that holds is given."""
    means = properties(corpus).agg(*(F.avg(F.when(F.col("y") == k, F.col(p).cast("double"))).alias(f"{p}_{k}") for p in PROPERTIES for k in (0, 1)))
    rows = means.select(F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"{p}_0").alias("b"), F.col(f"{p}_1").alias("f")) for p in PROPERTIES))).alias("x")).select("x.*")
    b, f = F.col("b"), F.col("f")
    apart = F.abs(b - f)
    verdict = (
        F.when((F.greatest(b, f) <= 0.01) | (F.least(b, f) >= 0.99), "constant")
        .when(b.isin(0.0, 1.0) & (apart >= 0.05), "degenerate")
        .when(apart >= 0.70, "high_separation")
        .when(apart >= 0.35, "elevated")
        .otherwise("ok")
    )
    return rows.select("property", r6(b).alias("benign"), r6(f).alias("phishing"), r6(apart).alias("separation"), verdict.alias("verdict"))


def verdict_summary(rates: DataFrame) -> DataFrame:
    """Properties that give the label away, those that are constant, and the best score of a single one."""
    named = lambda *v: F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict").isin(*v), F.col("property")))), ",")
    return rates.agg(named("degenerate", "high_separation").alias("degenerate"), named("constant").alias("constant"), r6(F.coalesce(F.max("separation"), F.lit(0.0))).alias("max_single_property_tss"))
