"""``python -m lacuna collect | audit | train | report``: the work on corpora and snapshots from the command line."""

from __future__ import annotations

import argparse
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import suffixes, urls
from .operators import audit, experiment, live, metrics, model, splits
from .sources import days, readers
from .sources.shared import materialize, sweep

LIVE = "url string, y int, source string, first_seen_utc timestamp"


def features(rows: DataFrame, rules) -> DataFrame:
    """``rows`` with the features, and with their domain where they have none."""
    kept = [c for c in rows.columns if c not in urls.FEATURES]
    domain = [] if "domain" in kept else [F.col("registrable").alias("domain")]
    return urls.with_features(rows, "url", rules).select(*kept, *domain, *urls.FEATURES)


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lacuna")
    p.add_argument("task", choices=("collect", "audit", "train", "report"))
    p.add_argument("--corpora", help="folder of the corpora's files (audit, train, report)")
    p.add_argument("--only", nargs="*", help="keys of corpora")
    p.add_argument("--live", help="folder of daily snapshots (collect, report)")
    p.add_argument("--feeds", help="folder of a day's inputs: openphish.txt, urlhaus.csv, ranking.csv, index.json (collect)")
    p.add_argument("--day", help="the day that is collected; else today")
    p.add_argument("--key", default=os.environ.get("FEED_KEY"), help="key of sealed days; else FEED_KEY in the environment. Without one days are plain")
    p.add_argument("--models", default="models", help="folder of trained models")
    p.add_argument("--out", default="results", help="folder of the report")
    p.add_argument("--suffixes", help="file of a public suffix list; else the one that comes with Spark")
    p.add_argument("--trees", type=int, default=model.TREES)
    p.add_argument("--depth", type=int, default=model.DEPTH)
    p.add_argument("--per-tree", action="store_true", help="a bootstrap sample and a class balance for each tree (train, report)")
    p.add_argument("--resamples", type=int, default=1000)
    return p.parse_args(argv)


def collect(spark: SparkSession, a: argparse.Namespace, rules) -> None:
    """A day's snapshot from files, written once, its statistics beside it; the timeline of all days is printed."""
    now = datetime.now(UTC)
    day = a.day or now.strftime("%Y-%m-%d")
    pages, tallies = readers.tallied_index(spark, f"{a.feeds}/index.json", rules=rules)
    feeds = {"openphish": readers.read_text_feed(spark, f"{a.feeds}/openphish.txt"), "urlhaus": readers.read_quoted_feed(spark, f"{a.feeds}/urlhaus.csv")}
    rows, counts = live.snapshot(day, now.strftime("%Y-%m-%d %H:%M:%S"), feeds, readers.read_ranking(spark, f"{a.feeds}/ranking.csv", 50_000), pages)
    rows = materialize(rows, "snapshot")
    written = days.write_sealed(rows, a.live, a.key) if a.key else days.write_plain(rows, a.live)
    if written:
        experiment.put(spark, f"{a.live}/_stats/{day}.json", experiment.document(counts=counts, index=tallies))
    print(experiment.document(written=spark.createDataFrame([(d,) for d in written], "day string"), timeline=live.timeline(features(live_rows(spark, a), rules), tie="first_seen_utc").orderBy("snapshot_date")))


def live_rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return live.first_seen(days.read_days(spark, a.live, LIVE, a.key), tie="first_seen_utc")


def report(spark: SparkSession, a: argparse.Namespace, chosen: list, frames: dict, parts: dict, rules) -> None:
    rows = materialize(features(live_rows(spark, a), rules), "live")
    done = []
    for c in chosen:
        trained = {n: model.load(f"{a.models}/{c.key}-{n}") for n in ("random", "disjoint")}
        test = {n: parts[c.key][n].where("part = 'test'") for n in trained}
        scores = materialize(experiment.run(trained["random"], trained["disjoint"], test["random"], test["disjoint"], rows, a.resamples), "scores")
        steps = experiment.attribution(scores, audit.template_audit(frames[c.key]))
        row = materialize(experiment.summary(c.key, c.title, frames[c.key], steps, scores), "summary")
        headline = live.headline(rows)
        by_cell = audit.template_audit(rows.withColumn("cell", F.col("source")), ["cell"])
        ready, two = splits.readiness(headline), None
        fitted = model.fit_live(headline, urls.FEATURES, trees=a.trees, depth=a.depth, per_tree=a.per_tree) if ready.head()["ready"] else None
        if fitted:
            two = experiment.recovered(trained["disjoint"], fitted[0], test["disjoint"], fitted[1].where("part = 'test'"), a.resamples)
        confound = model.confound(headline, urls.PATH_SHAPE, trees=min(a.trees, 200), depth=min(a.depth, 12))
        at = {n: model.predict(trained[n].model, f).select("y", "prob", F.col("domain").alias("grp")) for n, f in (("random", test["random"]), ("disjoint", experiment.live_frames(rows)["realistic"]))}
        gap = metrics.difference_ci(at["random"], trained["random"].thresholds["tss"], at["disjoint"], trained["disjoint"].thresholds["tss"], n_resamples=a.resamples)
        small = {k: materialize(f, k) for k, f in {"attribution": steps, "rule_by_cell": by_cell, "total_gap": gap, "readiness": ready, "confound": confound, "path_presence": model.path_presence(headline), **({"two_by_two": two} if two is not None else {})}.items()}
        experiment.put(spark, f"{a.out}/{c.key}.json", experiment.document(scores=scores, shares=experiment.shares(small["attribution"]), corpus=row, live=live.provenance(rows), sources=live.source_counts(rows), **small))
        experiment.put(spark, f"{a.out}/{c.key}.md", experiment.detail(c.title, frames[c.key], scores, small["attribution"], small["rule_by_cell"], small["total_gap"], small["readiness"], small.get("two_by_two"), small["confound"], small["path_presence"], rows))
        done.append(row)
        sweep(spark)
    whole = done[0]
    for row in done[1:]:
        whole = whole.unionByName(row)
    experiment.put(spark, f"{a.out}/comparison.md", experiment.report(experiment.compare(whole)))


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    rules = suffixes.read_rules(spark, a.suffixes) if a.suffixes else None
    if a.task == "collect":
        collect(spark, a, rules)
        return
    known = readers.corpora(a.corpora)
    chosen = [known[k] for k in a.only or known]
    frames = {c.key: readers.read_corpus(spark, c, rules) for c in chosen}
    if a.task == "audit":
        for c in chosen:
            print(experiment.document(**{c.key: experiment.summary(c.key, c.title, frames[c.key])}))
        return
    parts = {}
    for key, rows in frames.items():
        rows = features(rows.withColumn("row", F.concat_ws("|", "url", "y")), rules)
        parts[key] = {"random": splits.random_split(rows, "row"), "disjoint": splits.disjoint_split(rows)}
    if a.task == "train":
        for key, by in parts.items():
            for name, split in by.items():
                model.fit(split, urls.FEATURES, name, trees=a.trees, depth=a.depth, per_tree=a.per_tree, benchmark=key).save(f"{a.models}/{key}-{name}")
        return
    report(spark, a, chosen, frames, parts, rules)


if __name__ == "__main__":
    main()
