"""The tables that play the roles of the reference's frames, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ["commoncrawl", "openphish", "tranco_templated", "urlhaus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a live frame; the host is the group."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)
    return p.select("page_id", "url", (F.col("page_id") % 2).cast("int").alias("y"), F.get(F.array(*map(F.lit, SOURCES)), (F.col("page_id") % 4).cast("int")).alias("source"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 20).cast("int")).alias("snapshot_date"), host.alias("domain"))


URLS = """u AS (SELECT page_id, url, (page_id % 2)::INT AS y, ['commoncrawl', 'openphish', 'tranco_templated', 'urlhaus'][(page_id % 4 + 1)::INT] AS source,
 DATE '2024-01-01' + (page_id % 20)::INT AS snapshot_date, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS domain FROM pages)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a labelled corpus with many groups: each customer is a shop with a domain of its own."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tld = F.get(F.array(*map(F.lit, ("com", "net", "org", "co.uk", "xyz"))), (c % 5).cast("int"))
    domain = F.concat(F.lit("shop"), c.cast("string"), F.lit("."), tld)
    path = F.when(k % 7 == 0, F.lit("")).when(k % 7 < 3, F.lit("/")).when(k % 7 < 5, F.concat(F.lit("/login/"), k.cast("string"), F.lit(".php"))).otherwise(F.concat(F.lit("/a-b/paypal_"), k.cast("string"), F.lit("//x.zip")))
    query = F.when(k % 11 < 3, F.concat(F.lit("?id="), k.cast("string"), F.lit("&v=%2F"))).otherwise("")
    url = F.concat(F.when(c % 3 == 0, "http://").otherwise("https://"), F.when(k % 2 == 0, "www.").when(k % 13 == 0, "secure.amazon.").otherwise(""), domain, F.when(k % 17 == 0, ":8080").otherwise(""), path, query, F.when(k % 19 == 0, "#Top").otherwise(""))
    return o.select(F.col("o_orderkey").alias("row_id"), url.alias("url"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), domain.alias("domain"))


CORPUS = """k AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, 'shop' || o_custkey || '.' || ['com', 'net', 'org', 'co.uk', 'xyz'][(o_custkey % 5 + 1)::INT] AS domain FROM orders),
c AS (SELECT k AS row_id, (CASE WHEN c % 3 = 0 THEN 'http://' ELSE 'https://' END) || (CASE WHEN k % 2 = 0 THEN 'www.' WHEN k % 13 = 0 THEN 'secure.amazon.' ELSE '' END) || domain || (CASE WHEN k % 17 = 0 THEN ':8080' ELSE '' END)
 || (CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 < 3 THEN '/' WHEN k % 7 < 5 THEN '/login/' || k || '.php' ELSE '/a-b/paypal_' || k || '//x.zip' END) || (CASE WHEN k % 11 < 3 THEN '?id=' || k || '&v=%2F' ELSE '' END)
 || (CASE WHEN k % 19 = 0 THEN '#Top' ELSE '' END) AS url, (s = 'F')::INT AS y, domain FROM k)"""

#: Parts of the corpus URLs in SQL.
PARTS = CORPUS + """,
p AS (SELECT row_id, url AS u, y, domain, regexp_extract(url, '^([^:]+)://', 1) AS scheme, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
 regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM c),
h AS (SELECT *, regexp_extract(netloc, '^[^:]*') AS host, CASE WHEN netloc LIKE '%:%' THEN regexp_extract(netloc, ':(.*)$', 1)::INT END AS port FROM p),
d AS (SELECT *, CASE WHEN host LIKE '%.co.uk' THEN 'co.uk' ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM h),
f AS (SELECT *, regexp_extract(left(host, length(host) - length(suffix) - 1), '([^.]*)$', 1) AS label FROM d),
x AS (SELECT *, label || '.' || suffix AS registrable, CASE WHEN length(host) > length(label) + length(suffix) + 1 THEN left(host, length(host) - length(label) - length(suffix) - 2) ELSE '' END AS subdomain FROM f)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a scored frame."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), (F.col("event_type") == "error").cast("int").alias("y"), F.least(F.col("value") / 50, F.lit(1.0)).alias("prob"), F.col("user_id").alias("grp"), F.col("ts").cast("date").alias("day"))


SCORED = "s AS (SELECT event_id AS row_id, (event_type = 'error')::INT AS y, least(value / 50, 1.0) AS prob, user_id AS grp, ts::DATE AS day FROM events)"


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a temporal frame: months as days, orders as groups."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_orderkey").alias("domain"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("snapshot_date"))


DATED = "l AS (SELECT (l_returnflag = 'R')::INT AS y, l_orderkey AS domain, date_trunc('month', l_shipdate)::DATE AS snapshot_date FROM lineitem)"
