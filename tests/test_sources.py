"""Crawl indexes in blocks, days that are written once, sealed files and tallies, each against a plain count."""

import glob
import gzip
import os
import random
import threading
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from lacuna.operators import order
from lacuna.sources import blocks, days, readers, shared

ROWS = "url string, y int, snapshot_date date"
KEY = "an example key.."


def test_asof_equals_a_search(spark):
    rng = random.Random(4)
    right = sorted({f"{rng.randrange(500):03}" for _ in range(80)})
    left = [f"{rng.randrange(500):03}" for _ in range(300)] + [None, "", "~"]
    r = spark.createDataFrame([(k, i) for i, k in enumerate(right)], "k string, i long").repartition(4)
    frame = spark.createDataFrame([(k,) for k in left], "k string").repartition(4)
    for strict in (True, False):
        got = sorted(((x.k, x.at.i if x.at else None) for x in order.asof(frame, r, "k", "at", strict).collect()), key=str)
        place = lambda k: (bisect_left(right, k) - 1 if strict or k not in right else right.index(k)) if k is not None else -1  # noqa: E731, B023
        assert got == sorted(((k, place(k) if place(k) >= 0 else None) for k in left), key=str)


def test_places_in_an_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 101).alias("k"), "id").repartition(5)
    got = order.ranked(shared.materialize(rows, "rows"), [F.col("k").desc(), F.col("id")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted(((i * 37 % 101, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(9)
    hosts = ["com,example", "com,example,www", "com,example2", "com,examples", "org,a", "org,a,b", "org,zz", "net,only"]
    rows = [(f"{h})/p{rng.randrange(10**6)}", f"{i:014d}", f"http://x/{i}", "200" if i % 3 else "404", "text/html") for i, h in enumerate(rng.choices(hosts, [9, 4, 5, 1, 30, 2, 9, 1], k=900))]
    path = shared.shared_dir(spark, "index")
    blocks.write_blocks(spark.createDataFrame(rows, "urlkey string, timestamp string, url string, status string, mime string").repartition(4), path, per_block=17)
    return path, sorted(rows)


def below(rows, prefix):
    return [r for r in rows if r[0].startswith((prefix + ")", prefix + ","))]


def test_records_of_prefixes_by_ranged_reads(spark, index):
    path, rows = index
    asked = ["com,example", "com,example,www", "org,a", "org", "net,only", "aaa,before", "zzz,after", "com,exampl", "org,a,nothing"]
    prefixes = spark.createDataFrame([(p,) for p in asked + asked[:2]], "prefix string")
    got = blocks.domain_records(spark, path, prefixes)
    assert sorted(map(tuple, got.drop("block", "line_no").collect())) == sorted((p, *r) for p in asked for r in below(rows, p))
    assert got.columns == ["prefix", "urlkey", "timestamp", "url", "status", "mime", "block", "line_no"]
    first = blocks.domain_records(spark, path, prefixes, limit=5)
    assert sorted(map(tuple, first.drop("block", "line_no").collect())) == sorted((p, *r) for p in asked for r in below(rows, p)[:5])
    pages = blocks.pages_of(spark, path, prefixes, per_domain=2)
    assert sorted(map(tuple, pages.collect())) == sorted((p, r[2]) for p in asked for r in [r for r in below(rows, p)[:8] if r[3] == "200"][:2])


def test_only_the_bytes_of_blocks_that_may_hold_records_are_read(spark, index):
    """All other bytes of a copy of the index are destroyed, and no lookup sees it."""
    path, rows = index
    found = blocks.blocks_for(blocks.read_sparse(spark, path), spark.createDataFrame([("com,example2",), ("net,only",)], "prefix string")).select("shard", "offset", "length").distinct().collect()
    all_ = blocks.read_sparse(spark, path).agg(F.sum("length")).head()[0]
    assert sum(r.length for r in found) < all_ / 2
    copy = shared.shared_dir(spark, "copy").removeprefix("file://")
    os.makedirs(f"{copy}/{blocks.INDEX}")
    source = path.removeprefix("file://")
    for name in glob.glob(f"{source}/{blocks.INDEX}/part-*"):
        open(f"{copy}/{blocks.INDEX}/{os.path.basename(name)}", "wb").write(open(name, "rb").read())
    for name in glob.glob(f"{source}/cdx-*"):
        data, out = open(name, "rb").read(), bytearray(os.path.getsize(name))
        for r in found:
            if r.shard == os.path.basename(name):
                out[r.offset : r.offset + r.length] = data[r.offset : r.offset + r.length]
        open(f"{copy}/{os.path.basename(name)}", "wb").write(bytes(out))
    got = blocks.domain_records(spark, copy, spark.createDataFrame([("com,example2",), ("net,only",)], "prefix string"))
    assert got.count() == len(below(rows, "com,example2")) + len(below(rows, "net,only"))


def test_one_block_is_text_at_a_time(spark, monkeypatch):
    """However many neighbouring blocks are read together, a task hands on the lines of one block before it opens the next."""
    path = shared.shared_dir(spark, "many")
    rows = [(f"org,a)/p{i:05d}", f"{i:014d}", f"http://x/{i}", "200", "text/html") for i in range(400)]
    blocks.write_blocks(spark.createDataFrame(rows, "urlkey string, timestamp string, url string, status string, mime string").coalesce(1), path, per_block=20)
    tasks = []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, f, schema: tasks.append((self, f)))
    blocks.read_blocks(blocks.blocks_for(blocks.read_sparse(spark, path), spark.createDataFrame([("org,a",)], "prefix string")), path)
    monkeypatch.undo()
    found, read = tasks[-1]
    got = list(read(iter([found.toPandas()])))
    assert sum(map(len, got)) == 400 and max(map(len, got)) <= 20


def test_an_empty_index_and_damaged_lines(spark):
    path = shared.shared_dir(spark, "odd").removeprefix("file://")
    lines = ['com,a)/1 2024 {"url": "http://a/1", "status": "200", "mime": "text/html"}', "com,a)/2 2024 {damaged", "com,a)/3 2024", "no key"]
    data = gzip.compress("\n".join(lines).encode() + b"\n\xff\xfe broken bytes\n")
    os.makedirs(path)
    open(f"{path}/cdx-0.gz", "wb").write(data)
    open(f"{path}/{blocks.INDEX}", "w").write(f"com,a)/1 2024\tcdx-0.gz\t0\t{len(data)}\t1\na line without tabs\n")
    prefixes = spark.createDataFrame([("com,a",)], "prefix string")
    assert [r.url for r in blocks.domain_records(spark, path, prefixes).collect()] == ["http://a/1"]
    assert blocks.domain_records(spark, path, prefixes.where("false")).count() == 0
    open(f"{path}/{blocks.INDEX}", "w").write("")
    assert blocks.domain_records(spark, path, prefixes).count() == 0


# --- days --------------------------------------------------------------------------------------------------------


def snapshot(spark, word, dates=("2024-01-01", "2024-01-02")):
    rows = [(f"http://{word}{i}.example/{i}", i % 2, d) for d in dates for i in range(50)]
    return spark.createDataFrame(rows, "url string, y int, d string").select("url", "y", F.col("d").cast("date").alias("snapshot_date"))


def test_of_two_writers_at_once_one_writes_a_day(spark):
    path = shared.shared_dir(spark, "days")
    ready, got = threading.Barrier(2), {}

    def write(word):
        rows = snapshot(spark, word).cache()
        rows.count()
        ready.wait()
        got[word] = days.write_table(rows, path)

    writers = [threading.Thread(target=write, args=(w,)) for w in ("left", "right")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(got["left"] + got["right"]) == ["2024-01-01", "2024-01-02"]
    held = spark.read.parquet(path).groupBy("snapshot_date").agg(F.count("*").alias("n"), F.countDistinct(F.regexp_extract("url", "//([a-z]+)", 1)).alias("writers")).collect()
    assert [(r.n, r.writers) for r in held] == [(50, 1), (50, 1)]


def test_a_day_stays_and_a_failed_day_can_be_written_again(spark):
    path = shared.shared_dir(spark, "days")
    assert readers.write_snapshot(snapshot(spark, "first", ["2024-01-01"]), path) == 50
    assert readers.write_snapshot(snapshot(spark, "second"), path) == 50
    assert {(str(r.snapshot_date), r.w) for r in spark.read.parquet(path).select("snapshot_date", F.regexp_extract("url", "//([a-z]+)", 1).alias("w")).collect()} == {("2024-01-01", "first"), ("2024-01-02", "second")}
    bad = snapshot(spark, "bad", ["2024-01-03"]).withColumn("url", F.raise_error(F.lit("no url")).cast("string"))
    with pytest.raises(Exception, match="no url"):
        days.write_table(bad, path)
    assert days.abandoned(spark, path, lambda d: f"snapshot_date={d}") == []
    assert days.claimed(spark, path, "2024-01-04") and days.abandoned(spark, path, lambda d: f"snapshot_date={d}") == ["2024-01-04"]
    assert days.write_table(snapshot(spark, "third", ["2024-01-03", "2024-01-04"]), path) == ["2024-01-03"]
    days.release(spark, path, "2024-01-04")
    assert days.write_table(snapshot(spark, "third", ["2024-01-04"]), path) == ["2024-01-04"]


def files(path, kind):
    return sorted(glob.glob(f"{path.removeprefix('file://')}/*{kind}/part-*"))


def test_sealed_days_show_nothing_and_come_back(spark):
    path, manifest = shared.shared_dir(spark, "sealed"), shared.shared_dir(spark, "manifest")
    rows = snapshot(spark, "secret").union(spark.createDataFrame([(None, None, None), ("line\nend, \"quoted\"", 1, None)], ROWS).withColumn("snapshot_date", F.lit("2024-01-02").cast("date")))
    assert days.write_sealed(rows, path, KEY, block_rows=20, manifest=manifest) == ["2024-01-01", "2024-01-02"]
    assert days.write_plain(snapshot(spark, "open", ["2024-01-03"]), path) == ["2024-01-03"]
    for f in files(path, days.SEALED):
        assert b"http" not in open(f, "rb").read() and b"secret" not in open(f, "rb").read()
    back = days.read_days(spark, path, "url string, y int", KEY)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.unionByName(snapshot(spark, "open", ["2024-01-03"])).collect()))
    assert [tuple(r) for r in days.data_files(spark, path).select("name", "sealed").collect()] == [("2024-01-01.jsonl.gz.enc", True), ("2024-01-02.jsonl.gz.enc", True), ("2024-01-03.csv.gz", False)]
    # Equal rows in another order have the same plain hash, under other bytes.
    again, twin = shared.shared_dir(spark, "sealed"), shared.shared_dir(spark, "manifest")
    days.write_sealed(rows.repartition(7), again, KEY, block_rows=20, manifest=twin)
    hashes = lambda m: sorted(map(tuple, spark.read.parquet(m).select("day", "sha256").collect()))
    assert hashes(manifest) == hashes(twin) and [open(f, "rb").read() for f in files(path, days.SEALED)] != [open(f, "rb").read() for f in files(again, days.SEALED)]
    with pytest.raises(ValueError, match="key"):
        days.read_days(spark, path, "url string, y int")


@pytest.mark.parametrize("harm", ["byte", "hash", "missing", "day"])
def test_a_changed_sealed_file_raises(spark, harm):
    path = shared.shared_dir(spark, "harmed")
    days.write_sealed(snapshot(spark, "secret"), path, KEY, block_rows=20)
    lines = spark.read.text(f"{path}/*{days.SEALED}").select("value", F.col("_metadata.file_path").alias("_file")).collect()
    rows = [[r.value, r._file] for r in lines]
    at = next(i for i, r in enumerate(rows) if r[0].startswith("2024-01-01:1:"))
    head, token = rows[at][0].rsplit(":", 1)
    if harm == "byte":
        rows[at][0] = head + ":" + token[:30] + ("A" if token[30] != "A" else "B") + token[31:]
    elif harm == "hash":
        rows[at][0] = head[:-1] + ("0" if head[-1] != "0" else "1") + ":" + token
    elif harm == "missing":
        del rows[at]
    else:
        rows[at][1] = next(f for v, f in rows if v.startswith("2024-01-02"))
    assert days.sealed_rows(spark.createDataFrame([(r.value, r._file) for r in lines], "value string, _file string"), KEY, "url string, y int").count() == 100
    with pytest.raises(Exception):  # noqa: B017
        days.sealed_rows(spark.createDataFrame(rows, "value string, _file string"), KEY, "url string, y int").collect()


# --- tallies -----------------------------------------------------------------------------------------------------


def test_what_is_kept_and_what_is_refused_is_all_there_is(spark):
    path = shared.shared_dir(spark, "lines").removeprefix("file://")
    os.makedirs(path)
    good = [f'{{"url": "http://d{i % 7}.com/{i}", "status": "200", "mime": "text/html"}}' for i in range(100)]
    odd = ['{"url": "http://d1.com/x", "status": "503", "mime": "text/html"}', '{"url": "http://d1.com/y", "status": "200", "mime": "image/png"}', '{"url": "http://d1.com/robots.txt", "status": "200", "mime": "text/html"}', '{"url": "http://d1', "not json at all", '{"url": "http://d2.com/z"}']
    open(f"{path}/a.json", "w").write("\n".join(good + odd))
    kept, tallies = readers.tallied_index(spark, path, per_domain=6, domains=3)
    got = {r.reason: r.n for r in tallies.collect()}
    assert got["damaged"] == 2 and got["not_200"] == 2 and got["not_html"] == 1 and got["no_page"] == 1
    assert got["kept"] == kept.count() == 18 and sum(got.values()) == 106 and kept.select("domain").distinct().count() == 3
    open(f"{path}/a.json", "w").write("")
    kept, tallies = readers.tallied_index(spark, path)
    assert kept.count() == 0 and {r.n for r in tallies.collect()} == {0}
