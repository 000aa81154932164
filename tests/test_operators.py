import datetime as dt
import gzip
import hashlib
import json
import random
import shutil
import zipfile

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from lacuna.functions import suffixes, urls
from lacuna.operators import audit, experiment, forest, live, metrics, model, splits
from lacuna.plans import registry
from lacuna.sources import days, readers
from lacuna.streaming import ingest
from lacuna.streaming import timeline as stream_of_days

FOLDER = "/root/testdata/sf0.001"


def test_template_rule_counts_each_quarter(spark):
    forms = ["https://www.shop.example/", "https://www.shop.example", "https://shop.example/cart", "http://www.shop.example/"]
    rows = spark.createDataFrame([(f, y) for y, many in ((0, (5, 2, 3, 0)), (1, (1, 0, 4, 5))) for f, k in zip(forms, many) for _ in range(k)], "url string, y int")
    r = audit.template_audit(rows).head()
    assert (r.n, r.tp, r.fp, r.fn, r.tn) == (20, 9, 3, 1, 7)
    assert (r.benign_template_share, r.phish_template_share, r.recall, r.false_alarm_rate, r.tss) == (0.7, 0.1, 0.9, 0.3, 0.6)


@pytest.mark.parametrize("p", [0.2, 0.9])
def test_one_forecast_for_all_has_no_skill(spark, p):
    rows = spark.createDataFrame([(i % 8 == 0, p) for i in range(160)], "y boolean, prob double").withColumn("y", F.col("y").cast("int"))
    low, high = metrics.score_at(rows, 0.5).head(), metrics.score_at(rows, 0.95).head()
    assert low.tss == high.tss == 0 and (high.tp, high.fp) == (0, 0) and low.recall == float(p >= 0.5)


def test_chosen_thresholds_beat_all_others(spark):
    random.seed(12)
    rows = [(int(random.random() < 0.35), round(random.betavariate(2, 3), 2)) for _ in range(700)]
    f = spark.createDataFrame(rows, "y int, prob double")
    for o in ("f1", "tss"):
        best = metrics.select_threshold(f, o).head()
        assert metrics.score_at(f, best.threshold).head()[o] == best.value
        assert all(metrics.score_at(f, t).head()[o] <= best.value for t in (0.1, 0.35, 0.6, 0.8))


def test_resampling_groups_widens_the_interval(spark):
    rows = [(100 * g + i, g % 2, float((g // 2) % 3 > 0) if g % 2 else float((g // 2) % 3 == 0), g) for g in range(24) for i in range(20)]
    f = spark.createDataFrame(rows, "row_id long, y int, prob double, grp int")
    whole, apart = metrics.bootstrap_ci(f, 0.5, "grp", 150).head(), metrics.bootstrap_ci(f, 0.5, None, 150).head()
    assert whole.lo < apart.lo < apart.hi < whole.hi


def test_row_interval_draws_over_the_whole_frame(spark):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{FOLDER}/events.parquet'")
    whole = "WITH " + registry.B.SCORED + ", " + registry._boot("x", "row_id", 20260920) + " SELECT round(quantile_cont(tss, 0.025), 6) AS lo, round(quantile_cont(tss, 0.975), 6) AS hi FROM xt"
    assert [tuple(r) for r in registry.queries()["iid_bootstrap_ci"](spark, FOLDER).select("lo", "hi").collect()] == c.sql(whole).fetchall()


def test_draws_of_resamples_equal_a_plain_loop(spark):
    """Draws are no rows of a shuffle, whether groups have few or many classes and come in one or many tiles."""
    rng = random.Random(3)
    groups = [(f"g{i:05d}", *(rng.randrange(4) for _ in range(4))) for i in range(10_057)]
    frame = spark.createDataFrame(groups, "grp string, tp long, fp long, fn long, tn long").repartition(3)
    want = {}
    for b in range(3):
        drawn = [groups[int(hashlib.md5(f"{b}-{k}-77".encode()).hexdigest()[:8], 16) % len(groups)][1:] for k in range(len(groups))]
        tp, fp, fn, tn = map(sum, zip(*drawn, strict=True))
        want[b] = tp / (tp + fn) - fp / (fp + tn)
    for settings in ({}, {"tile": 3000}, {"classes": 5}, {"classes": 5, "tile": 100_000}):
        out = metrics.resamples(frame, 3, 77, **settings)
        assert {r.b: r.tss for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert metrics.resamples(frame.where("false"), 3, 77).count() == 0


def test_counts_of_classes_resample_like_drawn_groups(spark):
    """Both intervals lie around the score, and their ends differ by less than half a standard error of 2000 resamples."""
    random.seed(5)
    rows = [(int(random.random() < 0.4), random.random() * (0.8 if g % 3 else 1.2), g) for g in range(300) for _ in range(random.randrange(1, 9))]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id int, y int, prob double, grp int").persist()
    for group in ("grp", None):
        a, b = (metrics.bootstrap_ci(frame, 0.5, group, 2000, draw=d).head() for d in ("counts", "groups"))
        x = metrics.linear_error(metrics.group_confusion(frame, 0.5, group or "row_id")).head()
        assert abs(a.lo - b.lo) < x.error / 2 > abs(a.hi - b.hi) and a.lo < x.point < a.hi
    groups = metrics.group_confusion(frame, 0.5)
    one, many = (sorted(r.tss for r in metrics.resampled_counts(groups, 400, 1, block=k).collect()) for k in (10**6, 5))
    assert len(one) == len(many) == 400 and abs(one[200] - many[200]) < x.error / 2
    same = lambda g: sorted(map(tuple, metrics.resampled_counts(g, 20, 1).collect()))
    assert same(groups) == same(groups.repartition(7))
    by = groups.withColumn("of", (F.col("grp") % 2).cast("string"))
    assert sorted(map(tuple, metrics.resampled_counts(by, 50, 1, "of").groupBy("of").count().collect())) == [("0", 50), ("1", 50)]
    assert metrics.bootstrap_ci(frame.where("false"), 0.5, None, 10).head().lo is None


def test_all_cells_at_once_equal_each_by_itself(spark):
    random.seed(6)
    rows = [(c, int(random.random() < 0.5), random.random(), i % 20) for c in ("a", "b") for i in range(300)]
    frame = spark.createDataFrame(rows, "cell string, y int, prob double, grp int").persist()
    at = {"a": {"f1": 0.3, "tss": 0.6}, "b": {"f1": 0.4, "tss": 0.5}}
    for r in experiment.evaluated_all(frame, at, 40).collect():
        alone = frame.where(F.col("cell") == r.cell)
        want, peak = metrics.score_at(alone, at[r.cell][r.point]).head().asDict(), metrics.select_threshold(alone, "tss").head()
        assert {k: r[k] for k in want} == want and r.peak_tss == round(peak.value, 6) and r.lo <= r.tss <= r.hi


@pytest.mark.parametrize("name", ["rf_train_predict", "rf_importance", "confound_diagnostic"])
def test_forests_are_registered_whole(spark, monkeypatch, name):
    fits = []

    class Fitted(Exception):
        pass

    def fit(self, rows):
        fits.append((len(self.getStages()[0].getInputCols()), self.getStages()[1].getNumTrees(), self.getStages()[1].getMaxDepth()))
        raise Fitted

    monkeypatch.setattr(registry.model.Pipeline, "fit", fit)
    folds = []
    monkeypatch.setattr(registry.model.F, "pmod", lambda a, b, pmod=F.pmod: folds.append(str(b)) or pmod(a, b))
    with pytest.raises(Fitted):
        registry.queries()[name](spark, FOLDER)
    wide = len(spark.read.parquet(f"{FOLDER}/embeddings.parquet").head().embedding)
    assert fits == [(len(registry.U.PATH_SHAPE), 200, 12) if name == "confound_diagnostic" else (wide, 300, 20)]
    assert folds == (["Column<'5'>"] if name == "confound_diagnostic" else folds)


def test_trees_grown_by_tasks(spark, monkeypatch):
    """The driver holds no tree; a forest with its widest nodes split by histograms separates like one grown by tasks alone and like Spark's."""
    rng = random.Random(11)
    rows = [(i, y := int(i % 5 == 0), rng.gauss(1.5 * y, 1), rng.gauss(0, 1), rng.gauss(-y, 1), "x") for i in range(4000)]
    frame = spark.createDataFrame(rows, "row_id int, y int, f0 double, f1 double, f2 double, domain string").repartition(5)
    train, test = frame.where("row_id % 4 > 0"), frame.where("row_id % 4 = 0")
    names = ["f0", "f1", "f2"]
    peak = lambda m: metrics.select_threshold(model.predict(m, test), "tss").head().value
    native = peak(model.train(train, names, trees=20, depth=10))
    monkeypatch.setattr(model.RandomForestClassifier, "_fit", lambda *a: pytest.fail("trees in the driver"))
    one, again = (model.train_wide(train, names, trees=20, depth=10) for _ in range(2))
    score = lambda m: {r.row_id: r.prob for r in model.predict(m, test).collect()}
    assert score(one) == pytest.approx(score(again)) and len(score(one)) == 1000 and abs(peak(one) - native) < 0.05
    assert [f for f, _ in model.ranked(one)] == ["f0", "f2", "f1"] and abs(sum(w for _, w in model.ranked(one)) - 1) < 1e-9
    assert model.confound(frame, names, "row_id", trees=3, depth=3).head().available
    monkeypatch.setattr(forest, "LOCAL", 300)
    monkeypatch.setattr(forest, "BLOCK", 500)
    split = model.train_wide(train, names, trees=20, depth=10)
    assert all(len(t) > 3 for t in split.stages[-1].top.values()) and abs(peak(split) - native) < 0.05
    assert spark.read.parquet(split.stages[-1].path).count() == sum(len(t) + 1 - len(split.stages[-1].leaves[k]) for k, t in split.stages[-1].top.items())
    assert model.predict(model.train_wide(frame.select("y", F.lit(1.0).alias("f0")), ["f0"], trees=3), frame.withColumn("f0", F.lit(None))).agg(F.countDistinct("prob")).head()[0] == 1


def test_a_forest_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """The same rows in other parts and another order have the same cuts and scores, with more values than stand for a block, and more blocks than one."""
    monkeypatch.setattr(forest, "BLOCK", 2000)
    rng = random.Random(5)
    rows = [(y := i % 2, rng.gauss(y, 1) if i % 9 else None, float(rng.randrange(9)), None, rng.gauss(0, 1)) for i in range(6000)]
    frame = spark.createDataFrame(rows + rows[:500], "y int, f0 double, f1 double, f2 double, f3 double")
    names = ["f0", "f1", "f2", "f3"]
    found = [model.train_wide(f, names, trees=3, depth=4) for f in (frame.repartition(3), frame.orderBy(F.desc("f0")), frame.repartition(7, "f1"))]
    cuts = [[c.tolist() for c in m.stages[-1].cuts] for m in found]
    assert cuts[0] == cuts[1] == cuts[2] and [len(c) for c in cuts[0]] == [31, 9, 0, 31]
    for k in (0, 3):
        values = sorted(r[k + 1] for r in rows + rows[:500] if r[k + 1] is not None)
        assert all(abs(sum(v <= c for v in values) / len(values) - i / 32) < 0.002 for i, c in enumerate(cuts[0][k], 1))
    scores = [sorted(r.prob for r in model.predict(m, frame).collect()) for m in found]
    assert scores[0] == pytest.approx(scores[1]) and scores[0] == pytest.approx(scores[2])


def test_streamed_files_and_state_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 100)
    asked = []

    def run(stream, out, checkpoint, parts):
        sizes = spark.read.parquet(out.removesuffix("/out") + "/in").groupBy(F.input_file_name()).count().collect()
        asked.append((parts, len(sizes), max(r["count"] for r in sizes)))
        raise InterruptedError

    monkeypatch.setattr(registry.stream_of_days, "run_timeline", run)
    with pytest.raises(InterruptedError):
        registry.queries()["stream_timeline"](spark, FOLDER)
    assert asked[0][:2] == (18, 18) and asked[0][2] < 160
    monkeypatch.undo()
    monkeypatch.setattr(registry, "FILE_ROWS", 100)
    want = registry.queries()["timeline"](spark, FOLDER).collect()
    assert sorted(map(tuple, registry.queries()["stream_timeline"](spark, FOLDER).collect())) == sorted(map(tuple, want)) and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_stream_of_more_files_has_no_more_batches(spark, monkeypatch):
    """Each micro-batch has a cost of its own: sightings written as 30 files make three, not 15."""
    dealt, batches, merged = DataFrame.repartition, [], stream_of_days.merged
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *keys: dealt(self, 30, *keys))
    monkeypatch.setattr(stream_of_days, "merged", lambda path: lambda delta, batch: (batches.append(batch), merged(path)(delta, batch)))
    want = sorted(map(tuple, registry.queries()["timeline"](spark, FOLDER).collect()))
    assert sorted(map(tuple, registry.queries()["stream_timeline"](spark, FOLDER).collect())) == want and batches == [0, 1, 2]


def test_disjoint_split_shares_no_group_and_random_split_does(spark):
    rows = spark.createDataFrame([(i, d % 2, f"d{d}") for d in range(200) for i in range(d * 10, d * 10 + d % 7 + 1)], "row_id long, y int, domain string")
    s = splits.disjoint_split(rows)
    assert splits.leaks(s).count() == 0 and s.count() == rows.count()
    assert splits.leaks(splits.random_split(rows, "row_id")).count() > 0
    assert {r.part for r in splits.sizes(s).collect()} == {"train", "val", "test"}


def sightings(n=500, seed=8):
    """Random rows (page_id, url, y, source, snapshot_date, domain) with URLs and domains that come again and again."""
    rng = random.Random(seed)
    return [(i, f"http://d{u % 17}.com/{u}", u % 3 % 2, rng.choice(live.STREAMS), dt.date(2023, 12, 20) + dt.timedelta(rng.randrange(40)), f"d{u % 17}.com" if u % 29 else None) for i, u in ((i, rng.randrange(90)) for i in range(n))]


SIGHTING = "page_id int, url string, y int, source string, snapshot_date date, domain string"


def timeline_by_brute_force(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        first.setdefault(r[1], r)
    out = []
    for day in sorted({r[4] for r in first.values()}):
        upto, new = [r for r in first.values() if r[4] <= day], [r for r in first.values() if r[4] == day]
        out.append((day, len(new), sum(r[2] for r in new), len(upto), sum(r[2] for r in upto), len({r[5] for r in upto} - {None})))
    return out


def test_timeline_equals_a_count(spark):
    rows = sightings()
    got = live.timeline(spark.createDataFrame(rows, SIGHTING)).orderBy("snapshot_date").collect()
    assert [tuple(r) for r in got] == timeline_by_brute_force(rows)


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_a_stream_keeps_the_timeline_in_any_order_of_arrival(spark, tmp_path, order):
    """Files arrive in two runs, one file a batch; the second run goes on from the first."""
    rows = sightings(200, 3)
    rows += rows[:20]
    if order == "shuffled":
        random.Random(1).shuffle(rows)
    else:
        rows.sort(key=lambda r: r[4], reverse=order == "descending")
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    parts = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SIGHTING).coalesce(1).write.mode("append").parquet(source)
        if k in (1, len(parts) - 1):
            stream_of_days.run_timeline(ingest.snapshot_stream(spark, source, SIGHTING), out, state)
            seen = [r for p in parts[: k + 1] for r in p]
            assert [tuple(r) for r in stream_of_days.timeline(spark, out).orderBy("snapshot_date").collect()] == timeline_by_brute_force(seen)
    assert len(stream_of_days.versions(spark, out)) <= 2
    # A batch that is repeated writes the same version again.
    last = stream_of_days.versions(spark, out)[-1]
    stream_of_days.merged(out)(spark.createDataFrame([], stream_of_days.CHANGE), last + 1)
    stream_of_days.merged(out)(spark.createDataFrame([], stream_of_days.CHANGE), last + 1)
    assert [tuple(r) for r in stream_of_days.timeline(spark, out).orderBy("snapshot_date").collect()] == timeline_by_brute_force(rows)


def test_a_stream_keeps_its_keys_without_python_and_repeats_a_broken_batch(spark, tmp_path, monkeypatch):
    """Nothing runs in Python for each key; a batch that breaks off between keys and totals is repeated; a null URL is not the empty one."""
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda *a, **k: pytest.fail("Python for each key"))
    odd = [(1000 + i, u, 1, live.STREAMS[0], dt.date(2024, 2, 9 - i), "odd.com") for i, u in enumerate([None, "", None, ""])]
    rows = odd[:2] + sightings(200, 5) + odd[2:]
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    whole, broken = stream_of_days.merged, [1]

    def merged(path):
        def merge(delta, batch):
            if batch in broken:
                broken.clear()
                raise InterruptedError
            whole(path)(delta, batch)

        return merge

    monkeypatch.setattr(stream_of_days, "merged", merged)
    for part in (rows[:100], rows[100:150], rows[150:]):
        spark.createDataFrame(part, SIGHTING).coalesce(1).write.mode("append").parquet(source)
    run = lambda: stream_of_days.run_timeline(ingest.snapshot_stream(spark, source, SIGHTING), out, state)
    with pytest.raises(StreamingQueryException, match="InterruptedError"):
        run()
    assert stream_of_days.versions(spark, f"{state}/known") == [0, 1] and stream_of_days.versions(spark, out) == [0]
    run()
    assert [tuple(r) for r in stream_of_days.timeline(spark, out).orderBy("snapshot_date").collect()] == timeline_by_brute_force(rows)
    assert stream_of_days.versions(spark, f"{state}/known") == [1, 2]
    # What was known is gone: the next batch does not begin anew without a word.
    shutil.rmtree(tmp_path / "state" / "known")
    spark.createDataFrame(rows[:5], SIGHTING).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException, match="before batch 3"):
        run()


def test_sealing_hides_and_returns(spark):
    rows = spark.createDataFrame([(1, "http://secret.example"), (2, "http://other.example")], "i int, url string")
    sealed = readers.seal(rows, "0123456789abcdef", ["url"])
    assert all(b"secret" not in bytes(r.token) for r in sealed.collect())
    assert sorted(map(tuple, readers.unseal(sealed, "0123456789abcdef", "url string").collect())) == [(1, "http://secret.example"), (2, "http://other.example")]


def test_a_day_is_written_once(spark, tmp_path):
    day = lambda d, u: spark.createDataFrame([(u, dt.date(2024, 1, d))], "url string, snapshot_date date")
    path = str(tmp_path / "t")
    assert [readers.write_snapshot(day(1, "a"), path), readers.write_snapshot(day(1, "b"), path), readers.write_snapshot(day(2, "c"), path)] == [1, 0, 1]
    assert {r.url for r in spark.read.parquet(path).collect()} == {"a", "c"}


@pytest.mark.parametrize("name", ["template_audit", "structural_rates", "url_parse", "timeline", "threshold_sweep", "temporal_split_sizes", "attribution_waterfall", "cluster_bootstrap_ci", "cluster_bootstrap_counts", "iid_bootstrap_counts", "cumulative_domains", "stream_timeline", "index_tallies", "sealed_days", "sparse_index_records", "sparse_index_pages", "random_pages"])
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "orders", "events", "lineitem"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = registry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rel = c.sql(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})")
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r) for r in rel.fetchall()), key=key)
    have = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sweep_ranges_hold_however_scores_are_spread(spark):
    random.seed(3)
    rows = [(int(random.random() < 0.5), 1 - 10.0 ** -random.uniform(0, 9)) for _ in range(3000)]
    got = {r.prob: (r.tp, r.fp, r.fn, r.tn) for r in metrics.sweep(spark.createDataFrame(rows, "y int, prob double")).collect()}
    for t in random.sample(sorted(got), 40):
        at = [sum(a == y and (p >= t) == hit for a, p in rows) for y, hit in ((1, True), (0, True), (1, False), (0, False))]
        assert got[t] == tuple(at)


def test_features_move_no_rows(spark):
    rows = urls.with_features(spark.createDataFrame([("http://a.b.example.com.pl/x",), ("http://shop.tk",), ("http://x.blogspot.co.nz",)], "url string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert {r.registrable: (r.suffix, r.tld_is_abused) for r in rows.collect()} == {"example.com.pl": ("com.pl", 0.0), "shop.tk": ("tk", 1.0), "blogspot.co.nz": ("co.nz", 0.0)}


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\n\nzz\n*.yy\n!city.yy\n// ===BEGIN PRIVATE DOMAINS===\nhost.zz\n")
    rules = suffixes.read_rules(spark, str(tmp_path / "rules.dat"))
    hosts = {"a.host.zz": "host.zz", "a.b.c.yy": "b.c.yy", "x.city.yy": "city.yy", "c.yy": "c.yy", "yy": "yy", "other": "other", "": ""}
    got = suffixes.with_suffix(spark.createDataFrame([(h,) for h in hosts], "host string"), "host", rules).collect()
    assert (rules.depth, rules.rows) == (2, 3) and {r.host: r.registrable for r in got} == hosts


def test_corpora_are_read_as_published(spark, tmp_path):
    known = readers.corpora(str(tmp_path))
    with zipfile.ZipFile(known["phiusiil"].path, "w") as z:
        z.writestr("inside.csv", '\ufeffFILENAME,URL,Length,label\na.txt,https://www.one.com,3,1\nb.txt,"http://two.com/a,b",3,0\n')
    wide = "url,length,status\nhttp://three.com,1, Phishing\nhttp://four.org/x,2,legitimate\n,3,phishing\n"
    with gzip.open(known["hannousse"].path, "wt") as f:
        f.write(wide)
    with gzip.open(known["kaitholikkal"].path, "wb") as f:
        f.write(b"url,type\nhttp://five.net,legitimate\nhttp://six.net/\xff,phishing\nhttp://bad.net,phishing,too,many\nhttp://none.net,\n")
    (tmp_path / "faizann.csv").write_text("url,label\nseven.com/p,bad\neight.com,good\n")
    read = {k: sorted((r.y, r.domain) for r in readers.read_corpus(spark, c).collect()) for k, c in known.items()}
    assert read == {"phiusiil": [(0, "one.com"), (1, "two.com")], "hannousse": [(0, "four.org"), (1, "three.com")], "kaitholikkal": [(0, "five.net"), (1, "six.net")], "faizann": [(0, "eight.com"), (1, "seven.com")]}
    checked = {r.key: r for r in readers.verified(spark, list(known.values())).collect()}
    assert checked["hannousse"].actual == hashlib.sha256(wide.encode()).hexdigest() and checked["hannousse"].match is False and not checked["phiusiil"].checked


def test_feeds_and_indexes(spark, tmp_path):
    (tmp_path / "feed.txt").write_text(" http://a.com \nno url\nhttps://b.com\n\n")
    assert sorted(r.url for r in readers.read_text_feed(spark, str(tmp_path / "feed.txt")).collect()) == ["http://a.com", "https://b.com"]
    (tmp_path / "q.csv").write_text("# id\n" + "".join(f'"{i}","x","http://h{i}.com/?a,b","y"\n' for i in range(9)) + '"9","x","none","y"\n')
    assert [r.url for r in readers.read_quoted_feed(spark, str(tmp_path / "q.csv"), 3).collect()] == [f"http://h{i}.com/?a,b" for i in range(3)]
    (tmp_path / "rank.csv").write_text("1,a.com\n2,b.com\n3,c.com\n")
    ranking = readers.read_ranking(spark, str(tmp_path / "rank.csv"), 2)
    assert ranking.count() == 2 and [r.url for r in readers.templated(ranking, 1).collect()] == ["https://www.a.com"]
    (tmp_path / "a.json").write_text('[{"id": "CC-MAIN-2020-10"}, {"id": "CC-MAIN-2024-10"}]')
    (tmp_path / "a.html").write_text("CC-MAIN-2021-04 and CC-MAIN-2023-50\n or CC-MAIN-2022-05")
    assert [readers.latest_collection(spark, str(tmp_path / n)).head().collection for n in ("a.json", "a.html")] == ["CC-MAIN-2020-10", "CC-MAIN-2023-50"]
    records = [(b, f"http://{d}.com/{i}", "200" if i else "404", "text/html") for b in range(12) for d in ("big", f"d{b}", f"e{b}", f"f{b}") for i in range(3)]
    (tmp_path / "i.json").write_text("\n".join(json.dumps(dict(zip(("block", "url", "status", "mime"), r))) for r in [*records, (0, "http://r.com/robots.txt/", "200", "text/html"), (0, "http://r.com/x", "200", "image/png")]))
    index = readers.read_index(spark, str(tmp_path / "i.json"), per_domain=1, domains=5).collect()
    assert len(index) == len({r.domain for r in index}) == 5 and all(not r.url.endswith("/0") for r in index)
    frame = spark.createDataFrame(records, "block int, url string, status string, mime string")
    some = readers.random_urls(frame, 100, per_block=2, max_blocks=6).collect()
    per = {b: sum(r.block == b for r in some) for b in {r.block for r in some}}
    assert len({r.domain for r in some}) == len(some) and len(per) == 6 and max(per.values()) == 2 and len(readers.random_urls(frame, 4).collect()) == 4


def test_an_experiment_from_split_to_report(spark, tmp_path):
    random.seed(9)
    rows = [(i, y, f"d{i % 60}", random.gauss(2 * y, 1), random.gauss(0, 1), dt.date(2024, 1, 1 + i % 20), ["openphish", "commoncrawl", "tranco_templated", "urlhaus"][random.choice([0, 3]) if y else random.choice([1, 2])], f"http://h{i}.com/x") for i, y in ((i, int(random.random() < 0.5)) for i in range(600))]
    frame = spark.createDataFrame(rows, "row_id long, y int, domain string, f0 double, f1 double, snapshot_date date, source string, url string").persist()
    parts = {"random": splits.random_split(frame, "row_id"), "disjoint": splits.disjoint_split(frame)}
    first = {k: model.fit(p, ["f0", "f1"], k, trees=4, depth=4, corpus="made up") for k, p in parts.items()}
    first["random"].save(str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    test = {k: p.where("part = 'test'") for k, p in parts.items()}
    score = lambda m: sorted((r.row_id, r.prob) for r in model.predict(m.model, test["random"]).select("row_id", "prob").collect())
    assert score(again) == score(first["random"]) and again.thresholds == first["random"].thresholds
    assert again.metadata["corpus"] == "made up" and [f["name"] for f in again.metadata["top_features"]] == ["f0", "f1"] and set(again.metadata["split_sizes"]) == {"train", "val", "test"}
    cells = experiment.run(again, first["disjoint"], test["random"], test["disjoint"], frame, 60).persist()
    got = {(r.cell, r.point): r for r in cells.collect()}
    assert len(got) == 10 and all(r.lo <= r.tss <= r.hi and r.peak_tss >= r.tss for r in got.values()) and all(got[c, "tss"].tss > 0.4 for c in ("c1", "c2", "c3", "c4"))
    steps = experiment.attribution(cells, spark.range(1).select(F.lit(1.0).alias("benign_template_share")))
    row = experiment.summary("made", "Made up", frame.select("url", "y"), steps, cells).head()
    assert row.cell1_tss == got["c1", "tss"].tss and row.total_gap == round(row.cell1_tss - row.cell4_tss, 6)
    text = experiment.report(experiment.compare(experiment.summary("made", "Made up", frame.select("url", "y"), steps, cells)), cells)
    assert "| made |" in text and "| c4 | tss |" in text and json.loads(experiment.document(cells=cells))["cells"][0]["n"] > 0
    live_model, split = model.fit_live(frame, ["f0", "f1"], trees=4, depth=4)
    two = experiment.recovered(first["disjoint"], live_model, test["disjoint"], split.where("part = 'test'"), 60).head()
    assert two.lo <= two.recovery <= two.hi and abs(two.gap - (two.a - two.b)) < 2e-6 and live_model.metadata["live_span"]["train"][0] == "2024-01-01"
    assert model.fit_live(frame.where("snapshot_date < '2024-01-03'"), ["f0"]) is None


def test_the_diagnostic_needs_two_labels_and_five_groups(spark):
    rows = spark.createDataFrame([(i % 2, f"d{i % 4}", float(i)) for i in range(40)], "y int, domain string, path_length double")
    for f in (rows, rows.where("y = 1")):
        assert tuple(model.confound(f, ["path_length"]).head()) == (False, f.count(), None, None, None)
    more = spark.createDataFrame([(i % 2, f"d{i % 30}", float(i % 2)) for i in range(200)], "y int, domain string, path_length double")
    r = model.confound(more, ["path_length"], trees=2, depth=2).head()
    assert r.available and r.n == 200 and r.peak_tss > 0.9 and r.breached
    assert tuple(model.path_presence(spark.createDataFrame([("http://a/x", 0), ("b.com//", 0), ("c.com", 1), ("https://d/?u=e/f", 1)], "url string, y int")).head()) == (0.5, 0.0)


def test_sealed_tables_are_recorded(spark, tmp_path):
    sealed = readers.seal(spark.createDataFrame([("u",)], "url string"), "0123456789abcdef", ["url"])
    for day in ("2024-01-01", "2024-01-02"):
        readers.record_sealed(sealed, str(tmp_path / "manifest"), day)
    got = spark.read.parquet(str(tmp_path / "manifest")).collect()
    assert sorted(r.name for r in got) == ["2024-01-01", "2024-01-02"] and all(len(r.sha256) == 64 for r in got)


def test_the_command_line_from_collection_to_report(spark, tmp_path, capsys):
    from lacuna.__main__ import main

    rng = random.Random(2)
    corpora, feeds, daily = tmp_path / "corpora", tmp_path / "feeds", str(tmp_path / "live")
    corpora.mkdir(), feeds.mkdir()
    lines = [f"d{i % 70}.com/{'login/' * (i % 3)}p{i}{'.php' if rng.random() < 0.7 else ''},bad" for i in range(150)] + [f"www.e{i % 70}.org/{rng.randrange(999)},good" for i in range(150)]
    (corpora / "faizann.csv").write_text("url,label\n" + "\n".join(lines) + "\n")
    (tmp_path / "rules.dat").write_text("com\norg\n")
    common = ["--corpora", str(corpora), "--only", "faizann", "--suffixes", str(tmp_path / "rules.dat")]
    main(["audit", *common])
    assert json.loads(capsys.readouterr().out)["faizann"][0]["n"] == 300
    for day in ("2024-01-01", "2024-01-02"):
        (feeds / "openphish.txt").write_text("".join(f"http://phish{rng.randrange(90)}.com/login/{i}.php\n" for i in range(40)))
        (feeds / "urlhaus.csv").write_text("# id\n" + "".join(f'"{i}","x","http://mal{i}.com/x.exe","y"\n' for i in range(20)))
        (feeds / "ranking.csv").write_text("".join(f"{i},site{i}.org\n" for i in range(1, 400)))
        (feeds / "index.json").write_text("\n".join(json.dumps({"url": f"https://www.site{i % 50}.org/a{i}", "status": "200", "mime": "text/html"}) for i in range(120)) + "\n{broken")
        for _ in range(2):  # the second time the day stays as it is
            main(["collect", "--feeds", str(feeds), "--live", daily, "--day", day, "--key", "0123456789abcdef"])
    assert [r.day.isoformat() for r in days.data_files(spark, daily).collect()] == ["2024-01-01", "2024-01-02"]
    stats = json.loads((spark.read.text(f"{daily}/_stats/2024-01-02.json", wholetext=True)).head()[0])
    assert {r["reason"]: r["n"] for r in stats["index"]}["damaged"] == 1 and {r["name"]: r["n"] for r in stats["counts"]}["tranco_templated"] == 99
    small = ["--models", str(tmp_path / "m"), "--trees", "2", "--depth", "3", "--resamples", "20"]
    main(["train", *common, *small])
    main(["report", *common, *small, "--live", daily, "--key", "0123456789abcdef", "--out", str(tmp_path / "out")])
    text = spark.read.text(f"{tmp_path}/out/faizann.md", wholetext=True).head()[0]
    assert all(part in text for part in ("## Before any learning", "| c4 | tss |", "## Where the score went", "## The rule in every cell", "too few days", "## Sampling of the live rows", "## Live rows"))
    whole = json.loads(spark.read.text(f"{tmp_path}/out/faizann.json", wholetext=True).head()[0])
    assert len(whole["scores"]) == 10 and whole["readiness"][0]["reason"] == "too few days"
    assert "| 1 | faizann |" in spark.read.text(f"{tmp_path}/out/comparison.md", wholetext=True).head()[0]


def test_the_registered_experiment_has_all_cells(spark, monkeypatch):
    monkeypatch.setattr(registry, "EXPERIMENT", {"trees": 2, "depth": 3})
    got = registry.queries()["experiment_cells"](spark, FOLDER).collect()
    assert sorted((r.cell, r.point) for r in got) == [(c, p) for c in ("c1", "c2", "c3", "c4", "robustness") for p in ("f1", "tss")] and all(r.n > 0 and r.lo <= r.hi for r in got)


def test_the_experiment_writes_its_features_once_for_both_splits(spark, monkeypatch):
    written = []
    monkeypatch.setattr(registry, "EXPERIMENT", {"trees": 2, "depth": 3})
    for module in (registry, splits):
        monkeypatch.setattr(module, "materialize", lambda df, name, of=module.materialize: written.append((name, set(urls.FEATURES) <= set(df.columns))) or of(df, name))
    registry.queries()["experiment_cells"](spark, FOLDER)
    assert sorted(name for name, wide in written if wide) == ["features", "live"]
    corpus = registry.B.corpus(spark, FOLDER)
    dealt = {"random": splits.random_split(corpus, "row_id"), "disjoint": splits.disjoint_split(corpus)}
    for k, part in registry._experiment_parts(spark, FOLDER).items():
        assert sorted(map(tuple, part.select("row_id", "y", "domain", "part").collect())) == sorted(map(tuple, dealt[k].select("row_id", "y", "domain", "part").collect()))


def test_each_tree_has_a_balance_of_its_own(spark, tmp_path):
    random.seed(7)
    rows = [(i, int(i % 7 == 0), random.gauss(2 * (i % 7 == 0), 1), random.gauss(0, 1), 5.0, "abc"[i % 3]) for i in range(700)]
    frame = spark.createDataFrame(rows, "row_id long, y int, f0 double, f1 double, same double, domain string")
    data = frame.withColumn("_row", F.col("row_id")).cache()
    balance = model.tree_balance(data, "y", 6, 3)
    samples = []
    for t in range(6):
        drawn = model.bootstrap(data, F.lit(t), "y", 3)
        weight = drawn.select("y", (F.col("_n") * F.when(F.col("y") == 1, balance[t][1]).otherwise(balance[t][0])).alias("w")).groupBy("y").agg(F.sum("w").alias("w")).collect()
        assert abs(weight[0].w - weight[1].w) < 1e-6
        samples.append([r["_n"] for r in drawn.orderBy("row_id").collect()])
    assert len({tuple(x) for x in samples}) == 6 and all(0.85 < sum(x) / 700 < 1.15 and 0.3 < x.count(0) / 700 < 0.44 for x in samples) and len({b[1] for b in balance.values()}) == 6
    names = ["f0", "f1", "same"]
    one, again = (model.train_balanced(frame, names, trees=5, depth=4, seed=3) for _ in range(2))
    score = lambda m: [round(r.prob, 12) for r in model.predict(m, frame).orderBy("row_id").collect()]
    assert score(one) == score(again) and one.stages[-1].getNumTrees == 5 and model.predict(one, frame).columns == [*frame.columns, "prob"]
    # The average of the trees' probabilities.
    got = one.transform(frame).limit(20).collect()
    for r in got:
        alone = [t.predictProbability(r["_features"])[1] for t in one.stages[-1].trees]
        assert abs(r.probability[1] - sum(alone) / 5) < 1e-9
    assert metrics.select_threshold(model.predict(one, frame), "tss").head().value > 0.6 and [f for f, _ in model.ranked(one)][0] == "f0"
    split = splits.random_split(frame, "row_id")
    trained = model.fit(split, names, "random", trees=3, depth=3, per_tree=True)
    trained.save(str(tmp_path / "m"))
    assert score(model.load(str(tmp_path / "m")).model) == score(trained.model) and trained.metadata["hyperparameters"]["class_weight"] == "balanced for each tree"


def test_splits_are_the_same_with_and_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 2, "hot" if i % 3 == 0 else f"d{rng.randrange(80)}" if i % 50 else None, dt.date(2024, 1, 1 + i % 20)) for i in range(900)]
    frame = spark.createDataFrame(rows, "row_id int, y int, domain string, snapshot_date date")
    both = lambda: [sorted(map(tuple, f(frame).select("row_id", "part").collect())) for f in (splits.disjoint_split, splits.temporal_split)]
    small = both()
    assert len(small[0]) == 900  # rows without a group are a group
    monkeypatch.setattr(splits, "MOST_BROADCAST", 0)
    assert both() == small
