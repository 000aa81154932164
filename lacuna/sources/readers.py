"""Corpora, feeds and snapshots from files; explicit schemas, no inference."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.suffixes import Rules, with_suffix
from ..functions.urls import with_parts
from .shared import materialize, opened


@dataclass(frozen=True)
class Corpus:
    """A labelled CSV: its columns, and when a row counts as positive."""

    key: str
    title: str
    path: str
    columns: tuple[str, ...]  # of the file, in order
    url: str
    label: str
    positive: str  # one of POLARITY
    drop_bad_lines: bool = False
    sha256: str | None = None  # of the published bytes, before they were compressed


#: The label rules of the four corpus forms.
POLARITY = {
    "zero_is_positive": lambda c: c.cast("int") == 0,
    "status_phishing": lambda c: F.lower(F.trim(c)) == "phishing",
    "not_legitimate": lambda c: c != "legitimate",
    "bad": lambda c: c == "bad",
}


def labelled(df: DataFrame, url: str, label: str, rule: str | object) -> DataFrame:
    """(url, y) with nulls dropped; y is 1 for positives."""
    positive: Column = (POLARITY[rule] if isinstance(rule, str) else rule)(F.col(label))
    return df.na.drop(subset=[url, label]).select(F.col(url).alias("url"), positive.cast("int").alias("y"))


def corpora(folder: str) -> dict[str, Corpus]:
    """The corpora, by key, as files of ``folder``; of a wider file the columns up to the last one that is read."""
    # Columns, hashes and labels as their publishers have them.
    return {
        c.key: c
        for c in (
            Corpus("phiusiil", "PhiUSIIL Phishing URL Dataset", f"{folder}/phiusiil.zip", (), "URL", "label", "zero_is_positive"),
            Corpus("hannousse", "Web page phishing detection", f"{folder}/hannousse_dataset_B_05_2020.csv.gz", (), "url", "status", "status_phishing", sha256="21093e2902e5441c86a6daf95e86e7c332046e477fdf109a579d7bd81e586d6c"),
            Corpus("kaitholikkal", "Phishing URL dataset", f"{folder}/kaitholikkal_url_dataset.csv.gz", ("url", "type"), "url", "type", "not_legitimate", True, "accb2dfbfd3329a8b5cb1b85dcad90314a660c272be755cb45d0f6865014b466"),
            Corpus("faizann", "Malicious URL corpus", f"{folder}/faizann.csv", ("url", "label"), "url", "label", "bad", True),
        )
    }


def unzipped(spark: SparkSession, path: str) -> str:
    """The CSV files of the ZIP archives at ``path`` written beside them as text; returns the folder. An archive goes through one task."""
    from io import BytesIO, TextIOWrapper
    from zipfile import ZipFile

    def lines(batches):
        for batch in batches:
            for content in batch["content"]:
                with ZipFile(BytesIO(content)) as archive:
                    for name in sorted(n for n in archive.namelist() if n.lower().endswith(".csv")):
                        with archive.open(name) as raw:
                            text = TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="\n")
                            while some := text.readlines(1 << 20):
                                yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in some]})

    out = f"{path}.csv"
    spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string").write.mode("overwrite").text(out)
    return out


def read_corpus(spark: SparkSession, corpus: Corpus, rules: Rules | None = None) -> DataFrame:
    """(url, y, domain); only the two named columns are parsed. Bytes that are no UTF-8 are replaced.

    Where ``drop_bad_lines``, lines with more or fewer fields than the header are left out.
    """
    path = unzipped(spark, corpus.path) if corpus.path.endswith(".zip") else corpus.path
    reader = spark.read.option("header", True).option("escape", '"')
    if corpus.drop_bad_lines:
        reader = reader.option("mode", "DROPMALFORMED").option("enforceSchema", False)
    if corpus.columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in corpus.columns))
    raw = reader.csv(path)
    raw = raw.select(*(F.col(f"`{c}`") for c in ((corpus.columns or (corpus.url, corpus.label)))))
    out = with_suffix(with_parts(labelled(raw, corpus.url, corpus.label, corpus.positive)), "host", rules)
    return out.select("url", "y", F.col("registrable").alias("domain"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files as they are published: of compressed ones, what they hold.

    A hash is worked out in the order of the bytes, so a file is one task's, which reads it piece by piece.
    """
    import gzip
    import hashlib

    def digest(batches):
        for batch in batches:
            rows = []
            for name in batch["path"]:
                total, n = hashlib.sha256(), 0
                fs, at = opened(name)
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw as plain:
                    while some := plain.read(1 << 20):
                        total.update(some)
                        n += len(some)
                rows.append((name, n, total.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are not read here
    return files.repartition(F.col("path")).mapInPandas(digest, "path string, length long, sha256 string")


def verified(spark: SparkSession, corpora_: list[Corpus]) -> DataFrame:
    """(key, checked, expected, actual, match): a difference is reported, not raised; without a published hash nothing is checked."""
    rows = spark.createDataFrame([(c.key, c.path.rsplit("/", 1)[-1], c.sha256) for c in corpora_], "key string, file string, expected string")
    known = [c.path for c in corpora_ if c.sha256]
    found = checksums(spark, known).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("sha256").alias("actual")) if known else spark.createDataFrame([], "file string, actual string")
    return rows.join(F.broadcast(found), "file", "left").select("key", F.col("actual").isNotNull().alias("checked"), "expected", "actual", (F.col("actual") == F.col("expected")).alias("match"))


def read_text_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url").startswith("http"))


def read_quoted_feed(spark: SparkSession, path: str, limit: int = 2000, field: int = 2) -> DataFrame:
    """Quoted CSV with # comments; the first ``limit`` URLs in the order of the file, which is the feature of the feed."""
    lines = spark.read.option("comment", "#").option("quote", '"').csv(path)
    at = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    url = F.trim(lines[lines.columns[field]])
    rows = lines.select(url.alias("url"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(at))).alias("at"))
    return rows.where(F.col("url").startswith("http")).orderBy("at").limit(limit).select("url")  # TakeOrdered


def read_ranking(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(rank, domain) of the first n of a CSV without header."""
    return spark.read.schema("rank int, domain string").csv(path).where(F.col("rank") <= n)


def latest_collection(spark: SparkSession, path: str) -> DataFrame:
    """The first id of a JSON list of crawls, or else the largest crawl name that stands in the page. A page is one small document."""
    page = spark.read.text(path, wholetext=True)
    first = F.get(F.from_json("value", "array<struct<id:string>>"), F.lit(0))["id"]
    return page.agg(F.coalesce(F.min(first), F.max(F.array_max(F.regexp_extract_all("value", F.lit(r"(CC-MAIN-\d{4}-\d{2})"), 1)))).alias("collection"))


def refusals() -> dict[str, Column]:
    """Why an index record is refused, in the order in which the reasons are looked at."""
    return {
        "not_200": ~F.coalesce(F.col("status") == "200", F.lit(False)),
        "not_html": ~F.coalesce(F.contains("mime", F.lit("html")), F.lit(False)),
        "no_page": F.coalesce(F.regexp_replace("url", "/+$", "").rlike(r"(robots\.txt|sitemap\.xml)$"), F.lit(False)),
    }


def page() -> Column:
    """Whether an index record (url, status, mime) is a fetched HTML page and no robots or sitemap file."""
    return ~reduce(Column.__or__, refusals().values())


def fetched_pages(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Index records (url, status, mime, ...) of fetched HTML pages that are no robots or sitemap files, with their domain."""
    rows = rows.where(page())
    kept = rows.columns
    return with_suffix(with_parts(rows), "host", rules).select(*kept, F.col("registrable").alias("domain"))


def read_index(spark: SparkSession, path: str, per_domain: int = 25, domains: int = 40, rules: Rules | None = None, seed: int = 20260920) -> DataFrame:
    """Index records (NDJSON) of fetched pages, at most so many domains and of each so many."""
    return tallied_index(spark, path, per_domain, domains, rules, seed)[0]


def tallied_index(spark: SparkSession, path: str, per_domain: int = 25, domains: int = 40, rules: Rules | None = None, seed: int = 20260920) -> tuple[DataFrame, DataFrame]:
    """(url, domain) of :func:`read_index`, and (reason, n): the records kept and those refused for each reason, all records of the input.

    Lines are read once: damaged ones, and those that a filter refuses, are counted while the rest is written. Quotas
    then count what is written. Domains are taken in a shuffled order.
    """
    from ..operators.live import top_per_group

    # In a session of its own: one that has observed can no longer be sent along with what captures it, as forests do.
    raw = spark.newSession().read.schema("url string, status string, mime string, _damaged string").option("columnNameOfCorruptRecord", "_damaged").json(path)
    reason = F.when(F.col("_damaged").isNotNull(), "damaged")
    for name, refused in refusals().items():
        reason = reason.when(refused, name)
    seen = Observation()
    counts = [F.count_if(F.col("_why") == name).alias(name) for name in ("damaged", *refusals())]
    rows = raw.withColumn("_why", reason).observe(seen, *counts).where(F.col("_why").isNull()).drop("_why", "_damaged")
    rows = materialize(with_suffix(with_parts(rows), "host", rules).select("url", F.col("registrable").alias("domain")), "index", spark)
    shuffled = F.md5(F.concat(F.coalesce("domain", F.lit("")), F.lit(f"-{seed}")))
    sizes = materialize(rows.groupBy("domain").agg(F.count("*").alias("n")), "sizes")
    first = sizes.orderBy(shuffled, "domain").limit(domains).select(F.col("domain").alias("_first"))
    chosen = sizes.join(F.broadcast(first), F.col("domain").eqNullSafe(F.col("_first")), "left")  # `domains` rows
    is_first = F.col("_first").isNotNull()
    over = chosen.agg(F.sum(F.when(is_first, 0).otherwise(F.col("n"))).alias("over_domains"), F.sum(F.when(is_first, F.greatest(F.col("n") - per_domain, F.lit(0))).otherwise(0)).alias("over_per_domain"), F.sum(F.when(is_first, F.least(F.col("n"), F.lit(per_domain))).otherwise(0)).alias("kept"))
    quotas = over.select(F.explode(F.array(*(F.struct(F.lit(c).alias("reason"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in over.columns))).alias("x")).select("x.*")
    tallies = spark.createDataFrame(list(seen.get.items()), "reason string, n long").unionByName(quotas)
    kept = top_per_group(rows.join(F.broadcast(first), F.col("domain") == F.col("_first"), "left_semi"), "domain", ["url"], per_domain).drop("rank")
    return kept, tallies


def random_urls(records: DataFrame, n: int, per_block: int = 5, max_blocks: int = 400, seed: int = 20260920, rules: Rules | None = None) -> DataFrame:
    """(block, url, domain): at most ``n`` pages of ``max_blocks`` blocks of a crawl index in a shuffled order, one for each domain.

    ``records``: block, url, status, mime. A domain is taken in the first of its blocks; of a block's domains
    ``per_block`` are taken, in shuffled order too.
    """
    from ..operators.live import top_per_group

    order = lambda *c: F.md5(F.concat_ws("-", *c, F.lit(seed)))
    blocks = records.select("block").distinct().orderBy(order("block"), "block").limit(max_blocks)
    rows = fetched_pages(records.join(blocks, "block", "left_semi"), rules)
    rows = rows.withColumn("at", F.struct(order("block").alias("b"), F.col("block"), order("url").alias("u"), F.col("url")))
    one = rows.groupBy("domain").agg(F.min_by(F.struct("block", "url", "at"), "at").alias("x")).select("domain", "x.*")
    return top_per_group(one, "block", ["at"], per_block).orderBy("at").limit(n).select("block", "url", "domain")


def prefix_scan(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows of a sorted key below a prefix: a range predicate that Parquet's statistics can prune by."""
    return rows.where((F.col(key) >= prefix) & (F.col(key) < prefix + "~"))


def templated(ranking: DataFrame, n: int) -> DataFrame:
    return ranking.orderBy("rank").limit(n).select(F.concat(F.lit("https://www."), "domain").alias("url"))


SNAPSHOT = "url string, y int, source string, first_seen_utc timestamp"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV files; the date is the file's name."""
    day = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).cast("date")
    return spark.read.option("header", True).option("pathGlobFilter", "*.csv*").schema(SNAPSHOT).csv(path).withColumn("snapshot_date", day)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of snapshots; fields that a day lacks are null."""
    schema = "date string, openphish int, urlhaus int, urlhaus_error string, cc_errors map<string,int>, cc_via string, cc_cdn_error string, benign_realistic int, benign_templated int, rows int"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_snapshot(rows: DataFrame, path: str) -> int:
    """Write the days that the table does not hold; returns the rows written.

    A day is written once: the first writer claims it, and of two writers that both found no such day one writes it.
    """
    from .days import write_table

    rows = materialize(rows, "snapshot")  # what is counted is what is written
    days = write_table(rows, path)
    return rows.where(F.col("snapshot_date").cast("string").isin(days)).count() if days else 0


def record_sealed(sealed: DataFrame, manifest: str, name: str) -> None:
    """Append (sha256, name) of a sealed table to a manifest: the hash of its values' hashes in order."""
    whole = sealed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))  # a day's table
    whole.select("sha256", F.lit(name).alias("name")).write.mode("append").parquet(manifest)


def seal(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row's named columns as one encrypted JSON value (AES-GCM), with the hash of what is stored."""
    token = F.aes_encrypt(F.encode(F.to_json(F.struct(*columns)), "UTF-8"), F.lit(key), F.lit("GCM"))
    return rows.select(*(c for c in rows.columns if c not in columns), token.alias("token")).withColumn("sha256", F.sha2("token", 256))


def unseal(sealed: DataFrame, key: str, schema: str) -> DataFrame:
    plain = F.from_json(F.decode(F.aes_decrypt("token", F.lit(key), F.lit("GCM")), "UTF-8"), schema)
    return sealed.withColumn("_x", plain).select(*(c for c in sealed.columns if c not in ("token", "sha256")), "_x.*")
