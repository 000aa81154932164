"""Cells, attribution and comparisons over scored frames; every cell is one aggregate, cells are long tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialize
from . import audit, live, metrics
from .metrics import r6

DECOMPOSABLE, CONFOUND_CEILING = 0.90, 0.30


def cells(frames: dict[str, DataFrame], thresholds: dict[str, float]) -> DataFrame:
    """(cell, point, scores): each scored frame at each frozen threshold, frames read once for all."""
    tagged = reduce(DataFrame.unionByName, (f.select("y", "prob").withColumn("cell", F.lit(k)) for k, f in frames.items()))
    return reduce(DataFrame.unionByName, (metrics.score_at(tagged, t, ["cell"]).withColumn("point", F.lit(p)) for p, t in thresholds.items()))


def attribution(scores: DataFrame, benign_template_share: DataFrame) -> DataFrame:
    """(point, split_leakage, temporal_shift, construction_artifact, total) from cells c1 to c4; the middle steps are null unless the share is at least 0.90."""
    wide = scores.groupBy("point").pivot("cell", ["c1", "c2", "c3", "c4"]).agg(F.first("tss"))
    x = wide.crossJoin(F.broadcast(benign_template_share.select(F.col("benign_template_share").alias("_s"))))  # one row
    step = lambda a, b: r6(F.col(a) - F.col(b))
    guarded = lambda c: F.when(F.col("_s") >= DECOMPOSABLE, c)
    return x.select("point", step("c1", "c2").alias("split_leakage"), guarded(step("c2", "c3")).alias("temporal_shift"), guarded(step("c3", "c4")).alias("construction_artifact"), step("c1", "c4").alias("total"))


def two_by_two(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame, old: float, new: float) -> DataFrame:
    """Scores of the old and the new model (thresholds old, new) on the old test (a, c) and the new holdout (b, d)."""
    one = lambda f, t, k: metrics.score_raw(f, t).withColumnRenamed("tss", k)
    x = reduce(DataFrame.crossJoin, (one(a, old, "a"), one(b, old, "b"), one(c, new, "c"), one(d, new, "d")))  # single rows
    gap, recovery = F.col("a") - F.col("b"), F.col("d") - F.col("b")
    return x.select(*(r6(F.col(k)).alias(k) for k in "abcd"), r6(gap).alias("gap"), r6(recovery).alias("recovery"), r6(F.try_divide(recovery, gap)).alias("recovery_fraction"))


def evaluated_all(scored: DataFrame, thresholds: dict[str, dict[str, float]], n_resamples: int = 1000, seed: int = 20260920) -> DataFrame:
    """Cells at their frozen thresholds: a row for each (cell, point) with its scores, the interval over resampled groups (lo, hi) and the cell's peak.

    ``scored``: cell, y, prob, grp, on storage that gives the same rows twice; ``thresholds``: by cell and point. All
    cells go through one aggregate for the scores, one sweep and one table of the groups' counts.
    """
    spark = scored.sparkSession
    points = spark.createDataFrame([(c, p, float(t)) for c, by in thresholds.items() for p, t in by.items()], "cell string, point string, threshold double")
    at = scored.join(F.broadcast(points), "cell")  # a row for each cell and point
    out = metrics.scores(at, ["cell", "point"])
    groups = at.groupBy("cell", "point", "grp").agg(*metrics.confusion(F.col("threshold"))).withColumn("of", F.concat_ws("|", "cell", "point"))
    ci = metrics.interval(metrics.resampled_counts(groups, n_resamples, seed, "of"), ["of"])
    best = metrics.select_threshold(scored, "tss", ["cell"]).select("cell", r6(F.col("value")).alias("peak_tss"), r6(F.col("threshold")).alias("peak_threshold"))
    return out.withColumn("of", F.concat_ws("|", "cell", "point")).join(F.broadcast(ci), "of").drop("of").join(F.broadcast(best), "cell")  # a row for each cell and point


def evaluated(name: str, scored: DataFrame, thresholds: dict[str, float], n_resamples: int = 1000) -> DataFrame:
    """One cell of :func:`evaluated_all`; ``scored``: y, prob, grp."""
    rows = materialize(scored.select(F.lit(name).alias("cell"), "y", "prob", "grp"), "scored")
    return evaluated_all(rows, {name: thresholds}, n_resamples)


def live_frames(rows: DataFrame) -> dict[str, DataFrame]:
    """The positives of the headline stream with templated and with realistic negatives, and the other positives with realistic ones."""
    of = lambda y, source: rows.where((F.col("y") == y) & (F.col("source") == source))
    real = of(0, live.BENIGN)
    return {"templated": of(1, live.PHISH).unionByName(of(0, "tranco_templated")), "realistic": of(1, live.PHISH).unionByName(real), "malware": of(1, "urlhaus").unionByName(real)}


def run(random_model, disjoint_model, random_test: DataFrame, disjoint_test: DataFrame, live_rows: DataFrame, n_resamples: int = 1000) -> DataFrame:
    """All cells of the experiment for two trained models: c1 to c4 and the robustness cell, a row for each threshold.

    c1: random split; c2: disjoint split; c3, c4: live rows with templated and with realistic negatives, scored by
    the model of the disjoint split. Frames need the features, ``y`` and ``domain``.
    """
    from . import model

    frames = live_frames(live_rows)
    cells_ = [("c1", random_model, random_test), ("c2", disjoint_model, disjoint_test), ("c3", disjoint_model, frames["templated"]), ("c4", disjoint_model, frames["realistic"]), ("robustness", disjoint_model, frames["malware"])]
    one = lambda k, m, f: model.predict(m.model, f).select(F.lit(k).alias("cell"), "y", "prob", F.col("domain").alias("grp"))
    scored = materialize(reduce(DataFrame.unionByName, (one(*c) for c in cells_)), "scored")  # each row is scored once
    return evaluated_all(scored, {k: m.thresholds for k, m, _ in cells_}, n_resamples)


def recovered(benchmark_model, live_model, benchmark_test: DataFrame, holdout: DataFrame, n_resamples: int = 1000) -> DataFrame:
    """The two-by-two of training source and test set (a, b, c, d, gap, recovery, its fraction) with the recovery's interval."""
    from . import model

    frame = lambda m, rows: materialize(model.predict(m.model, rows).select("y", "prob", F.col("domain").alias("grp")), "scored")
    old, new = benchmark_model.thresholds["tss"], live_model.thresholds["tss"]
    a, b, c, d = frame(benchmark_model, benchmark_test), frame(benchmark_model, holdout), frame(live_model, benchmark_test), frame(live_model, holdout)
    ci = metrics.difference_ci(d, new, b, old, n_resamples=n_resamples).select("lo", "hi", (F.col("lo") > 0).alias("significant"))
    return two_by_two(a, b, c, d, old, new).crossJoin(ci)  # one row each


def shares(steps: DataFrame) -> DataFrame:
    """(point, step, value, share): each step of an attribution as a share of the whole gap's size."""
    names = ["split_leakage", "temporal_shift", "construction_artifact"]
    rows = steps.select("point", "total", F.explode(F.array(*(F.struct(F.lit(n).alias("step"), F.col(n).alias("value")) for n in names))).alias("x"))
    return rows.select("point", "x.step", "x.value", r6(F.try_divide(F.abs("x.value"), F.abs("total"))).alias("share")).where("value is not null")


def summary(key: str, title: str, corpus: DataFrame, steps: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """One row of the comparison: a corpus's audits and, where it was evaluated, its cells and attribution at the TSS threshold."""
    rule = audit.template_audit(corpus).select("n", F.col("tss").alias("template_rule_tss"), "benign_template_share")
    best = audit.verdict_summary(audit.structural_rates(corpus)).select(F.col("degenerate").alias("degenerate_properties"), F.col("constant").alias("constant_properties"), "max_single_property_tss")
    out = rule.crossJoin(best).select(F.lit(key).alias("corpus"), F.lit(title).alias("title"), "*", (F.col("benign_template_share") >= DECOMPOSABLE).alias("decomposable"))  # one row each
    none = F.lit(None).cast("double")
    if steps is None or scores is None:
        return out.select("*", *(none.alias(k) for k in ("cell1_tss", "cell4_tss", "total_gap", "split_leakage", "construction_share")))
    at = scores.where("point = 'tss'").agg(*(F.max(F.when(F.col("cell") == c, F.col("tss"))).alias(k) for c, k in (("c1", "cell1_tss"), ("c4", "cell4_tss"))))
    gap = steps.where("point = 'tss'").agg(F.max("total").alias("total_gap"), F.max("split_leakage").alias("split_leakage"), r6(F.try_divide(F.max("construction_artifact"), F.max("total"))).alias("construction_share"))
    return out.crossJoin(at).crossJoin(gap)  # one row each


def compare(summaries: DataFrame) -> DataFrame:
    """Corpora by the worse of their two baselines that learn nothing, worst first."""
    worst = F.greatest("template_rule_tss", "max_single_property_tss")
    return summaries.withColumn("rank", F.row_number().over(Window.orderBy(worst.desc(), "corpus")))  # a row for each corpus


def render(comparison: DataFrame, fields: tuple[str, ...] = ("template_rule_tss", "max_single_property_tss")) -> DataFrame:
    """Lines of a Markdown table; numbers to three places, a dash for what is missing."""
    fmt = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("—"))
    return comparison.select("rank", F.concat(F.lit("| "), F.concat_ws(" | ", "corpus", *map(fmt, fields)), F.lit(" |")).alias("line"))


def document(**parts: DataFrame) -> str:
    """Small results as one JSON document: each part a list of its rows. They have a row for each cell, corpus or day."""
    return json.dumps({k: [r.asDict(recursive=True) for r in f.collect()] for k, f in parts.items()}, default=str, indent=1)


def put(spark, path: str, text: str) -> None:
    """One small document as a text file of that name's folder, on any storage that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def table(rows: DataFrame, columns: dict[str, str], *order: str) -> list[str]:
    """Lines of a Markdown table of a small frame; ``columns``: the format of each (``.3f``, ``,``, empty for text)."""
    def cell(v, form: str) -> str:
        return "—" if v is None else format(v, form) if form else str(v)

    found = rows.select(*columns).orderBy(*order).collect() if order else rows.select(*columns).collect()
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c], f) for c, f in columns.items()) + " |" for r in found), ""]


def report(comparison: DataFrame, scores: DataFrame | None = None) -> str:
    """The comparison, and the cells if there are any, as Markdown. All parts of a report have a row for each corpus, cell or day."""
    kinds = {"rank": "", "corpus": "", "n": ",", "template_rule_tss": ".4f", "max_single_property_tss": ".4f", "degenerate_properties": "", "constant_properties": "", "cell1_tss": ".3f", "cell4_tss": ".3f", "total_gap": ".3f"}
    out = ["# Evaluation gap", "", *table(comparison, {k: f for k, f in kinds.items() if k in comparison.columns}, "rank")]
    return "\n".join(out + (cells_section(scores) if scores is not None else [])) + "\n"


def cells_section(scores: DataFrame) -> list[str]:
    kinds = {"cell": "", "point": "", "n": ",", "base_rate": ".3f", "tss": ".3f", "lo": ".3f", "hi": ".3f", "recall": ".3f", "false_alarm_rate": ".3f", "tp": ",", "fp": ",", "fn": ",", "tn": ",", "peak_tss": ".3f"}
    return ["## Cells", "", *table(scores, kinds, "cell", "point")]


def detail(title: str, corpus: DataFrame, scores: DataFrame | None = None, steps: DataFrame | None = None, rule_by_cell: DataFrame | None = None, gap: DataFrame | None = None, readiness: DataFrame | None = None, two: DataFrame | None = None, confound: DataFrame | None = None, presence: DataFrame | None = None, live_rows: DataFrame | None = None) -> str:
    """One corpus's report as Markdown: its audit, cells, attribution, the rule in every cell, live training, the sampling diagnostic and the live rows; what is not given is left out."""
    rule = {"n": ",", "accuracy": ".4f", "precision": ".4f", "recall": ".4f", "false_alarm_rate": ".4f", "tss": ".4f", "benign_template_share": ".4f", "phish_template_share": ".4f"}
    out = [f"# {title}", "", "## Before any learning", "", *table(audit.template_audit(corpus), rule), *table(audit.structural_rates(corpus), {"property": "", "benign": ".4f", "phishing": ".4f", "separation": ".4f", "verdict": ""}, "property")]
    if scores is not None:
        out += cells_section(scores)
    if steps is not None:
        out += ["## Where the score went", "", *table(steps, {k: ".3f" if k != "point" else "" for k in ("point", "split_leakage", "temporal_shift", "construction_artifact", "total")}, "point")]
        withheld = steps.where("temporal_shift is null").count() > 0  # a row for each point
        out += [f"The two middle steps are withheld: fewer than {DECOMPOSABLE:.0%} of the benign rows match the template.", ""] if withheld else table(shares(steps), {"point": "", "step": "", "value": ".3f", "share": ".3f"}, "point", "step")
    if gap is not None:
        out += ["Total gap at the TSS threshold:", "", *table(gap, {"point": ".3f", "lo": ".3f", "hi": ".3f", "excludes_zero": ""})]
    if rule_by_cell is not None:
        out += ["## The rule in every cell", "", *table(rule_by_cell, {"cell": "", "n": ",", "accuracy": ".4f", "tss": ".4f"}, "cell")]
    if readiness is not None:
        out += ["## Training on live rows", "", *table(readiness, {"ready": "", "reason": "", "n_days": ",", "n_rows": ",", "days_needed": ","})]
    if two is not None:
        out += ["Trained on the benchmark (a, b) and on live rows (c, d), tested on the benchmark (a, c) and on live rows (b, d):", "", *table(two, {k: ".3f" for k in ("a", "b", "c", "d", "gap", "recovery", "lo", "hi")} | {"significant": ""})]
    if confound is not None:
        out += ["## Sampling of the live rows", "", f"Path shape alone, against a ceiling of {CONFOUND_CEILING}:", "", *table(confound, {"available": "", "n": ",", "peak_tss": ".3f", "threshold": ".3f", "breached": ""})]
    if presence is not None:
        out += ["Share of URLs with a path:", "", *table(presence, {"benign": ".3f", "phishing": ".3f"})]
    if live_rows is not None:
        out += ["## Live rows", "", *table(live.provenance(live_rows), {"n": ",", "n_domains": ",", "n_phishing": ",", "n_days": ",", "first_day": "", "last_day": ""}), *table(live.source_counts(live_rows), {"source": "", "n": ","}, "source")]
    return "\n".join(out) + "\n"
