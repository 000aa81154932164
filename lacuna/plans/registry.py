"""All queries of the reference's own operators, with the SQL that checks them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import audit, experiment, live, metrics, model, splits
from ..sources import blocks, days, readers
from ..sources.shared import materialize, removed_at_exit, shared_dir
from ..streaming import ingest
from ..streaming import timeline as stream_of_days
from . import bindings as B

#: Trees and depth of the registered experiment and of the forest with a balance for each tree; the operators' own defaults are larger.
EXPERIMENT = {"trees": 20, "depth": 8}
#: Rows of a file of the streamed sightings.
FILE_ROWS = 250_000
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

THRESHOLD, RESAMPLES = 0.5, 1000
RATIOS = """coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0.0) AS far, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy"""
SCORES = "round(recall, 6) AS recall, round(far, 6) AS false_alarm_rate, round(precision, 6) AS precision, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(recall - far, 6) AS tss"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- audits ----------------------------------------------------------------------------------------------------

_AUDIT = """a AS (SELECT {by} count(*) AS n, count(*) FILTER (NOT m AND y = 1) AS tp, count(*) FILTER (NOT m AND y = 0) AS fp, count(*) FILTER (m AND y = 1) AS fn, count(*) FILTER (m AND y = 0) AS tn
 FROM (SELECT *, regexp_full_match(url, 'https://www\\.[^/?#]+/?') AS m FROM {t}) {group}), r AS (SELECT *, """ + RATIOS + """ FROM a)
SELECT {by} n, tp, fp, fn, tn, round(coalesce(tn / nullif(tn + fp, 0), 0.0), 6) AS benign_template_share, round(coalesce(fn / nullif(fn + tp, 0), 0.0), 6) AS phish_template_share,
 round(recall, 6) AS recall, round(far, 6) AS false_alarm_rate, round(precision, 6) AS precision, round(accuracy, 6) AS accuracy, round(recall - far, 6) AS tss FROM r"""


@query("WITH " + B.CORPUS + ", " + _AUDIT.format(by="", t="c", group=""))
def template_audit(s: SparkSession, d: str) -> DataFrame:
    return audit.template_audit(B.corpus(s, d))


@query("WITH " + B.URLS + ", " + _AUDIT.format(by="source,", t="u", group="GROUP BY source"))
def template_rule_by_cell(s: SparkSession, d: str) -> DataFrame:
    return audit.template_audit(B.urls(s, d), ["source"])


_RATES = B.PARTS + """, q AS (SELECT y, (scheme = 'https')::INT::DOUBLE AS is_https, starts_with(host, 'www.')::INT::DOUBLE AS has_www, (length(rtrim(path, '/')) > 0)::INT::DOUBLE AS has_path, (query <> '')::INT::DOUBLE AS has_query FROM p JOIN h USING (row_id, y, scheme, path, query)),
m AS (SELECT property, avg(v) FILTER (y = 0) AS b, avg(v) FILTER (y = 1) AS f FROM (UNPIVOT q ON is_https, has_www, has_path, has_query INTO NAME property VALUE v) GROUP BY property),
r AS (SELECT property, round(b, 6) AS benign, round(f, 6) AS phishing, round(abs(b - f), 6) AS separation,
 CASE WHEN greatest(b, f) <= 0.01 OR least(b, f) >= 0.99 THEN 'constant' WHEN b IN (0.0, 1.0) AND abs(b - f) >= 0.05 THEN 'degenerate' WHEN abs(b - f) >= 0.7 THEN 'high_separation' WHEN abs(b - f) >= 0.35 THEN 'elevated' ELSE 'ok' END AS verdict FROM m)"""
_RATES = _RATES.replace("FROM p JOIN h USING (row_id, y, scheme, path, query)", "FROM h")


@query("WITH " + _RATES + " SELECT * FROM r")
def structural_rates(s: SparkSession, d: str) -> DataFrame:
    return audit.structural_rates(B.corpus(s, d))


@query("WITH " + _RATES + """ SELECT coalesce(string_agg(property, ',' ORDER BY property) FILTER (verdict IN ('degenerate', 'high_separation')), '') AS degenerate,
 coalesce(string_agg(property, ',' ORDER BY property) FILTER (verdict = 'constant'), '') AS constant, round(max(separation), 6) AS max_single_property_tss FROM r""")
def structural_verdicts(s: SparkSession, d: str) -> DataFrame:
    return audit.verdict_summary(audit.structural_rates(B.corpus(s, d)))


# --- URL parts and features --------------------------------------------------------------------------------------


@query("WITH " + B.PARTS + " SELECT row_id, scheme, host, port, path, query, fragment, subdomain, label, suffix, registrable FROM x")
def url_parse(s: SparkSession, d: str) -> DataFrame:
    return U.with_suffix(U.with_parts(B.corpus(s, d))).select("row_id", "scheme", "host", "port", "path", "query", "fragment", "subdomain", "label", "suffix", "registrable")


def _features(names: list[str]):
    def run(s: SparkSession, d: str) -> DataFrame:
        return U.with_features(B.corpus(s, d)).select("row_id", *(F.round(c, 6).alias(c) for c in names))

    return run


_NONEMPTY = "len(list_filter(string_split({}, '{}'), lambda s: s <> ''))"
_COUNT = "(length(u) - length(replace(u, '{}', '')))"
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"
_IN = "len(list_filter({}, lambda t: list_contains([{}], t)))"
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_EXT = "lower(regexp_extract(coalesce(list_last(list_filter(string_split(path, '/'), lambda s: s <> '')), ''), '([^.]*)$', 1))"
_ENTROPY = "coalesce(list_aggregate(string_split({}, ''), 'entropy'), 0)"
_EXPR = {
    "url_length": "length(u)", "domain_length": "length(host)", "subdomain_length": "length(subdomain)", "path_length": "length(path)", "query_length": "length(query)", "fragment_length": "length(fragment)",
    "path_depth": _NONEMPTY.format("path", "/"), "n_query_params": _NONEMPTY.format("query", "&"),
    "digit_ratio": "length(regexp_replace(u, '[^0-9]', '', 'g')) / length(u)", "letter_ratio": "length(regexp_replace(u, '[^a-zA-Z]', '', 'g')) / length(u)", "special_ratio": "length(regexp_replace(u, '[a-zA-Z0-9]', '', 'g')) / length(u)",
    "upper_ratio": "length(regexp_replace(u, '[^A-Z]', '', 'g')) / length(u)", "entropy_url": _ENTROPY.format("u"),
    **{f"n_{k}": _COUNT.format(c) for k, c in (("dots", "."), ("hyphens", "-"), ("underscores", "_"), ("slashes", "/"), ("equals", "="), ("ampersands", "&"), ("at", "@"), ("tilde", "~"), ("plus", "+"), ("commas", ","))},
    "n_hex_escapes": "len(regexp_extract_all(u, '%[0-9a-fA-F]{2}'))", "entropy_domain": _ENTROPY.format("label"), "domain_digit_ratio": "length(regexp_replace(label, '[^0-9]', '', 'g')) / greatest(length(label), 1)",
    "domain_hyphen_count": "length(label) - length(replace(label, '-', ''))", "domain_vowel_ratio": "coalesce(length(regexp_replace(label, '[^aeiou]', '', 'g')) / nullif(length(regexp_replace(label, '[^a-zA-Z]', '', 'g')), 0), 0)",
    "domain_max_consonant_run": "coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda r: length(r))), 0)",
    "domain_max_repeat_run": "list_max(list_transform(range(1, length(label) + 1), lambda i: length(label[i:]) - length(ltrim(label[i:], label[i]))))",
    "domain_digit_group_count": "len(regexp_extract_all(label, '[0-9]+'))", "domain_token_count": f"len({_TOK.format('registrable')})", "domain_longest_token": f"list_max(list_transform({_TOK.format('registrable')}, lambda t: length(t)))",
    "n_subdomains": _NONEMPTY.format("subdomain", "."), "has_www": "(subdomain = 'www' OR starts_with(subdomain, 'www.'))::INT", "is_ip_domain": "regexp_full_match(host, '[0-9]{1,3}(\\.[0-9]{1,3}){3}')::INT", "has_punycode": "contains(host, 'xn--')::INT",
    "tld_length": "length(suffix)", "tld_is_common": f"(suffix IN ({_LIST(U.COMMON_TLDS)}))::INT", "tld_is_abused": f"(regexp_extract(suffix, '([^.]*)$', 1) IN ({_LIST(U.ABUSED_TLDS)}))::INT", "is_shortener": f"(registrable IN ({_LIST(U.SHORTENERS)}))::INT",
    "is_https": "(scheme = 'https')::INT", "has_port": "(port IS NOT NULL)::INT", "has_nonstandard_port": "coalesce((port NOT IN (80, 443))::INT, 0)", "has_userinfo": "0",
    "has_at_symbol": "contains(u, '@')::INT", "double_slash_in_path": "contains(path, '//')::INT", "suspicious_keyword_count": _IN.format(_TOK.format("u"), _LIST(U.KEYWORDS)), "brand_token_count": _IN.format(_TOK.format("u"), _LIST(U.BRANDS)),
    "brand_outside_domain": f"CASE WHEN {_IN.format(_TOK.format('registrable'), _LIST(U.BRANDS))} > 0 THEN 0 ELSE {_IN.format(_TOK.format('''subdomain || ' ' || path || ' ' || query'''), _LIST(U.BRANDS))} END",
    "has_script_ext": f"({_EXT} IN ({_LIST(U.SCRIPT_ENDINGS)}))::INT", "has_archive_ext": f"({_EXT} IN ({_LIST(U.ARCHIVE_ENDINGS)}))::INT",
}

for _name, _columns in {"url_lengths": U.LENGTHS, "url_char_ratios": U.RATIOS[:4], "url_entropy": ["entropy_url", "entropy_domain"], "url_char_counts": U.COUNTS, "url_domain_shape": U.SHAPE[1:], "url_flags": U.FLAGS, "url_tokens": U.WORDS, "path_shape_features": U.PATH_SHAPE}.items():
    _QUERIES[_name] = _features(_columns)
    _SQL[_name] = "WITH " + B.PARTS + " SELECT row_id, " + ", ".join(f"round(({_EXPR[c]})::DOUBLE, 6) AS {c}" for c in _columns) + " FROM x"


@query("WITH " + B.PARTS + " SELECT registrable, count(*) AS n, count(DISTINCT host) AS hosts FROM x GROUP BY registrable")
def registrable_domain(s: SparkSession, d: str) -> DataFrame:
    return U.with_suffix(U.with_parts(B.corpus(s, d))).groupBy("registrable").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


@query("WITH " + B.PARTS + " SELECT DISTINCT domain, array_to_string(list_reverse(string_split(domain, '.')), ',') AS surt FROM x")
def surt_key(s: SparkSession, d: str) -> DataFrame:
    return B.corpus(s, d).select("domain").distinct().withColumn("surt", U.surt(F.col("domain")))


@query("WITH " + B.CORPUS + ", k2 AS (SELECT DISTINCT domain, array_to_string(list_reverse(string_split(domain, '.')), ',') AS surt FROM c) SELECT domain, surt FROM k2 WHERE surt >= 'net,shop1' AND surt < 'net,shop1~'")
def range_scan(s: SparkSession, d: str) -> DataFrame:
    return readers.prefix_scan(surt_key(s, d), "surt", "net,shop1")


@query("SELECT 'zero_is_positive' AS rule, count(*) AS n, sum((quality = 0)::INT)::BIGINT AS positives FROM labels WHERE quality IS NOT NULL UNION ALL SELECT 'status_phishing', count(*), sum((lower(trim(event_type)) = 'phishing')::INT)::BIGINT FROM events UNION ALL SELECT 'not_legitimate', count(*), sum((event_type <> 'legitimate')::INT)::BIGINT FROM events UNION ALL SELECT 'bad', count(*), sum((event_type = 'bad')::INT)::BIGINT FROM events")
def label_normalise(s: SparkSession, d: str) -> DataFrame:
    e, q = B.table(s, d, "events"), B.table(s, d, "labels")
    one = lambda f, u, c, r: readers.labelled(f, u, c, r).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("positives")).select(F.lit(r).alias("rule"), "n", "positives")
    return reduce(DataFrame.unionByName, (one(q, "doc_id", "quality", "zero_is_positive"), *(one(e, "event_id", "event_type", r) for r in ("status_phishing", "not_legitimate", "bad"))))


# --- live frames ---------------------------------------------------------------------------------------------------

_CORPUS_LIVE = "v AS (SELECT o_orderkey AS page_id, 'https://shop' || o_custkey || '.com' AS url, (o_custkey % 2)::INT AS y, ['openphish', 'urlhaus', 'commoncrawl', 'tranco_templated'][(o_orderkey % 4 + 1)::INT] AS source, o_orderdate::DATE AS snapshot_date, 'shop' || (o_custkey % 700) AS domain FROM orders)"


def _visits(s: SparkSession, d: str) -> DataFrame:
    """Orders as sightings of a shop's URL: many for each URL and some on one day."""
    o = B.table(s, d, "orders")
    c = F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://shop"), c.cast("string"), F.lit(".com")).alias("url"), (c % 2).cast("int").alias("y"), F.get(F.array(*map(F.lit, live.STREAMS)), (F.col("o_orderkey") % 4).cast("int")).alias("source"), F.col("o_orderdate").cast("date").alias("snapshot_date"), F.concat(F.lit("shop"), (c % 700).cast("string")).alias("domain"))


_FIRST = _CORPUS_LIVE + ", n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY url ORDER BY snapshot_date, page_id) = 1)"


@query("WITH " + _FIRST + " SELECT * FROM n")
def first_seen_dedup(s: SparkSession, d: str) -> DataFrame:
    return live.first_seen(_visits(s, d))


@query("WITH " + _CORPUS_LIVE + ", m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY url, date_trunc('month', snapshot_date) ORDER BY list_position(['openphish', 'urlhaus', 'commoncrawl', 'tranco_templated'], source), page_id) = 1) SELECT url, date_trunc('month', snapshot_date)::DATE AS snapshot_date, page_id, source, y FROM m")
def within_day_dedup(s: SparkSession, d: str) -> DataFrame:
    monthly = _visits(s, d).withColumn("snapshot_date", F.trunc("snapshot_date", "month"))
    return live.within_day(monthly).select("url", "snapshot_date", "page_id", "source", "y")


_TIMELINE = "WITH " + _FIRST + """, a AS (SELECT snapshot_date, count(*) AS new_rows, sum(y)::BIGINT AS new_phishing FROM n GROUP BY 1), f AS (SELECT snapshot_date, count(*) AS k FROM (SELECT domain, min(snapshot_date) AS snapshot_date FROM n GROUP BY 1) GROUP BY 1)
SELECT a.snapshot_date, new_rows, new_phishing, (sum(new_rows) OVER w)::BIGINT AS cumulative_rows, (sum(new_phishing) OVER w)::BIGINT AS cumulative_phishing, (sum(coalesce(k, 0)) OVER w)::BIGINT AS cumulative_domains FROM a LEFT JOIN f USING (snapshot_date) WINDOW w AS (ORDER BY a.snapshot_date)"""


@query(_TIMELINE)
def timeline(s: SparkSession, d: str) -> DataFrame:
    return live.timeline(_visits(s, d))


@query("WITH " + _FIRST + " SELECT a.snapshot_date, (SELECT count(DISTINCT domain) FROM n WHERE n.snapshot_date <= a.snapshot_date) AS domains FROM (SELECT DISTINCT snapshot_date FROM n) a")
def cumulative_domains(s: SparkSession, d: str) -> DataFrame:
    """The domains seen up to each day."""
    return live.timeline(_visits(s, d)).select("snapshot_date", F.col("cumulative_domains").alias("domains"))


@query("WITH " + B.URLS + " SELECT source, count(*) AS n FROM u GROUP BY source")
def source_counts(s: SparkSession, d: str) -> DataFrame:
    return live.source_counts(B.urls(s, d))


@query("WITH " + B.URLS + " SELECT count(*) AS n, count(DISTINCT domain) AS n_domains, sum(y)::BIGINT AS n_phishing, count(DISTINCT snapshot_date) AS n_days, min(snapshot_date) AS first_day, max(snapshot_date) AS last_day FROM u")
def live_corpus(s: SparkSession, d: str) -> DataFrame:
    return live.provenance(B.urls(s, d))


@query("WITH " + B.URLS + " SELECT * FROM u WHERE (y = 1 AND source = 'openphish') OR (y = 0 AND source = 'commoncrawl')")
def headline_rows(s: SparkSession, d: str) -> DataFrame:
    return live.headline(B.urls(s, d))


@query("WITH " + B.URLS + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rank FROM u) WHERE rank <= 3")
def topk_per_group(s: SparkSession, d: str) -> DataFrame:
    return live.top_per_group(B.urls(s, d), "domain", ["page_id"], 3)


@query("SELECT event_type AS error, count(*) AS n FROM events GROUP BY 1")
def error_histogram(s: SparkSession, d: str) -> DataFrame:
    return live.error_histogram(B.table(s, d, "events").select(F.col("event_type").alias("error")))


@query("WITH " + B.URLS + ", " + B.CORPUS + " SELECT url, y, domain, 'live' AS corpus FROM u UNION ALL SELECT url, y, domain, 'benchmark' FROM c")
def corpus_union(s: SparkSession, d: str) -> DataFrame:
    one = lambda f, k: f.select("url", "y", "domain", F.lit(k).alias("corpus"))
    return one(B.urls(s, d), "live").unionByName(one(B.corpus(s, d), "benchmark"))


# --- splits ----------------------------------------------------------------------------------------------------------

_RANDOM = B.CORPUS + """, o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '-20260920'), row_id::VARCHAR) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM c),
r AS (SELECT *, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM o)"""
_DISJOINT = B.CORPUS + """, g AS (SELECT domain, count(*) AS n FROM c GROUP BY 1), b AS (SELECT domain, n, coalesce(sum(n) OVER (ORDER BY md5(domain || '-20260920'), domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM g),
t AS (SELECT coalesce(sum(n), 0) AS tr FROM b WHERE b < 0.7::DOUBLE * t), a AS (SELECT domain, CASE WHEN b < 0.7::DOUBLE * b.t THEN 'train' WHEN b - tr < 0.15::DOUBLE * b.t THEN 'val' ELSE 'test' END AS part FROM b, t), r AS (SELECT c.*, part FROM c JOIN a USING (domain))"""
_SIZES = " SELECT part, count(*) AS n, round(avg(y), 6) AS base_rate FROM r GROUP BY part"
_TEMPORAL = B.DATED + """, d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS i, count(*) OVER () AS d FROM (SELECT DISTINCT snapshot_date FROM l)), h AS (SELECT *, d - greatest(1, round_even(d * 0.3, 0))::INT AS tr FROM d),
v AS (SELECT snapshot_date, CASE WHEN i <= tr - greatest(1, round_even(tr * 0.2, 0)) THEN 0 WHEN i <= tr THEN 1 ELSE 2 END AS p FROM h), e AS (SELECT l.*, p FROM l JOIN v USING (snapshot_date)), f AS (SELECT domain, min(p) AS p FROM e GROUP BY 1),
r AS (SELECT e.y, e.domain, e.snapshot_date, ['train', 'val', 'test'][e.p + 1] AS part FROM e JOIN f ON e.domain = f.domain AND e.p = f.p)"""


@query("WITH " + _RANDOM + _SIZES)
def random_split_sizes(s: SparkSession, d: str) -> DataFrame:
    return splits.sizes(splits.random_split(B.corpus(s, d), "row_id"))


@query("WITH " + _RANDOM + " SELECT row_id, part FROM r")
def random_split_rows(s: SparkSession, d: str) -> DataFrame:
    return splits.random_split(B.corpus(s, d), "row_id").select("row_id", "part")


@query("WITH " + _DISJOINT + _SIZES)
def disjoint_split_sizes(s: SparkSession, d: str) -> DataFrame:
    return splits.sizes(splits.disjoint_split(B.corpus(s, d)))


@query("WITH " + _DISJOINT + " SELECT (SELECT count(*) FROM (SELECT domain FROM r GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS leaked_groups, count(*) AS n FROM r")
def disjoint_leak_check(s: SparkSession, d: str) -> DataFrame:
    r = splits.disjoint_split(B.corpus(s, d))
    return r.agg(F.count("*").alias("n")).crossJoin(splits.leaks(r).agg(F.count("*").alias("leaked_groups")))  # one row each


@query("WITH " + _TEMPORAL + _SIZES)
def temporal_split_sizes(s: SparkSession, d: str) -> DataFrame:
    return splits.sizes(splits.temporal_split(B.dated(s, d)))


@query("WITH " + _TEMPORAL + """, z AS (SELECT (SELECT count(DISTINCT snapshot_date) FROM l) AS n_days, (SELECT count(*) FROM l) AS n_rows, count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'train' AND y = 1) AS ap, count(*) FILTER (part = 'test') AS b, count(*) FILTER (part = 'test' AND y = 1) AS bp FROM r),
k AS (SELECT *, CASE WHEN n_rows = 0 THEN 'no rows' WHEN n_days < 14 THEN 'too few days' WHEN a = 0 THEN 'no split' WHEN a < 400 THEN 'train rows' WHEN ap < 100 THEN 'train positives' WHEN b < 400 THEN 'holdout rows' WHEN bp < 100 THEN 'holdout positives' ELSE 'ready' END AS reason FROM z)
SELECT reason = 'ready' AS ready, reason, n_days, n_rows, greatest(14 - n_days, 0) AS days_needed FROM k""")
def readiness(s: SparkSession, d: str) -> DataFrame:
    return splits.readiness(B.dated(s, d))


# --- scores --------------------------------------------------------------------------------------------------------------

_AT = "count(*) FILTER (prob >= {t} AND y = 1) AS tp, count(*) FILTER (prob >= {t} AND y = 0) AS fp, count(*) FILTER (prob < {t} AND y = 1) AS fn, count(*) FILTER (prob < {t} AND y = 0) AS tn"
_SCORE = "SELECT {by} n, round(b, 6) AS base_rate, {t}::DOUBLE AS threshold, tp, fp, fn, tn, " + SCORES + ", round(br, 6) AS brier, round(CASE WHEN b * (1 - b) > 0 THEN 1 - br / (b * (1 - b)) ELSE 0 END, 6) AS brier_skill FROM (SELECT *, " + RATIOS + " FROM (SELECT {by} count(*) AS n, avg(y) AS b, " + _AT + ", avg((prob - y) * (prob - y)) AS br FROM {f} {g}))"
_SWEEP = B.SCORED + ", q AS (SELECT prob, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM s GROUP BY 1), w AS (SELECT prob, (sum(p) OVER o)::BIGINT AS tp, (sum(q) OVER o)::BIGINT AS fp, (sum(p) OVER () - sum(p) OVER o)::BIGINT AS fn, (sum(q) OVER () - sum(q) OVER o)::BIGINT AS tn FROM q WINDOW o AS (ORDER BY prob DESC)), z AS (SELECT prob, tp, fp, fn, tn, " + SCORES + " FROM (SELECT *, " + RATIOS + " FROM w))"


@query("WITH " + B.SCORED + " " + _SCORE.format(by="", t=0.5, f="s", g=""))
def score_at(s: SparkSession, d: str) -> DataFrame:
    return metrics.score_at(B.scored(s, d), THRESHOLD)


@query("WITH " + _SWEEP + " SELECT * FROM z")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return metrics.sweep(B.scored(s, d))


@query("WITH " + _SWEEP + " SELECT prob AS threshold, f1 AS value FROM z ORDER BY f1 DESC, prob DESC LIMIT 1")
def select_threshold_f1(s: SparkSession, d: str) -> DataFrame:
    return metrics.select_threshold(B.scored(s, d), "f1")


@query("WITH " + _SWEEP + " SELECT prob AS threshold, tss AS value FROM z ORDER BY tss DESC, prob DESC LIMIT 1")
def select_threshold_tss(s: SparkSession, d: str) -> DataFrame:
    return metrics.select_threshold(B.scored(s, d), "tss")


@query("WITH " + _SWEEP + " SELECT max(tss) AS peak_tss FROM z")
def peak_tss(s: SparkSession, d: str) -> DataFrame:
    return metrics.select_threshold(B.scored(s, d), "tss").select(F.col("value").alias("peak_tss"))


@query("WITH " + B.SCORED + " SELECT grp, " + _AT.format(t=0.5) + " FROM s GROUP BY grp")
def group_confusion(s: SparkSession, d: str) -> DataFrame:
    return metrics.group_confusion(B.scored(s, d), THRESHOLD)


def _boot(name: str, key: str, seed: int, f: str = "s") -> str:
    return f"""{name}g AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS i, count(*) OVER () AS n FROM (SELECT {key}, {_AT.format(t=0.5)} FROM {f} GROUP BY {key})),
{name}d AS (SELECT b, ('0x' || substr(md5(b || '-' || k || '-{seed}'), 1, 8))::BIGINT % (SELECT max(n) FROM {name}g) AS i FROM range({RESAMPLES}) x(b), (SELECT i AS k FROM {name}g)),
{name}t AS (SELECT b, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0) - coalesce(sum(fp) / nullif(sum(fp) + sum(tn), 0), 0.0) AS tss FROM {name}d JOIN {name}g USING (i) GROUP BY b)"""


@query("WITH " + B.SCORED + ", " + _boot("x", "grp", 20260920) + " SELECT round(quantile_cont(tss, 0.025), 6) AS lo, round(quantile_cont(tss, 0.975), 6) AS hi FROM xt")
def cluster_bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_ci(B.scored(s, d), THRESHOLD, "grp", RESAMPLES, draw="groups")


@query("WITH " + B.SCORED + ", " + _boot("x", "row_id", 20260920) + " SELECT round(quantile_cont(tss, 0.025), 6) AS lo, round(quantile_cont(tss, 0.975), 6) AS hi FROM xt")
def iid_bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_ci(B.scored(s, d), THRESHOLD, None, RESAMPLES, draw="groups")


_COUNTS = B.SCORED + ", g7 AS (SELECT {key}, " + _AT.format(t=0.5) + " FROM s GROUP BY {key}), r7 AS (SELECT recall - far AS v FROM (SELECT " + RATIOS + " FROM (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(tn)::DOUBLE AS tn FROM g7))) SELECT (SELECT count(*) FROM (SELECT DISTINCT tp, fp, fn, tn FROM g7)) AS classes, {n} AS resamples, round(v, 6) AS point, true AS centred, true AS as_wide FROM r7"


def _counted(s: SparkSession, d: str, key: str, n: int) -> DataFrame:
    """The interval by multinomial counts, held against the point and the linear standard error of the score."""
    rows = B.scored(s, d)
    groups = metrics.group_confusion(rows, THRESHOLD, key)
    ci = metrics.bootstrap_ci(rows, THRESHOLD, key if key != "row_id" else None, n)
    classes = groups.select("tp", "fp", "fn", "tn").distinct().agg(F.count("*").alias("classes"))
    x = classes.crossJoin(metrics.linear_error(groups)).crossJoin(ci)  # one row each
    width = (F.col("hi") - F.col("lo")) / (2 * 1.959964 * F.col("error"))
    return x.select("classes", F.lit(n).alias("resamples"), metrics.r6(F.col("point")).alias("point"), (F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("point")) <= F.col("error") / 3).alias("centred"), (F.abs(width - 1) <= 0.2).alias("as_wide"))


@query("WITH " + _COUNTS.format(key="grp", n=2000))
def cluster_bootstrap_counts(s: SparkSession, d: str) -> DataFrame:
    return _counted(s, d, "grp", 2000)


@query("WITH " + _COUNTS.format(key="row_id", n=2000))
def iid_bootstrap_counts(s: SparkSession, d: str) -> DataFrame:
    return _counted(s, d, "row_id", 2000)


_HALVES = "ea AS (SELECT * FROM s WHERE day <= DATE '2024-01-15'), eb AS (SELECT * FROM s WHERE day > DATE '2024-01-15')"


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x, cut = B.scored(s, d), F.lit("2024-01-15").cast("date")
    return x.where(F.col("day") <= cut), x.where(F.col("day") > cut)


@query("WITH " + B.SCORED + ", " + _HALVES + ", " + _boot("x", "grp", 20260920, "ea") + ", " + _boot("y", "grp", 20260921, "eb") + """, i AS (SELECT round(quantile_cont(xt.tss - yt.tss, 0.025), 6) AS lo, round(quantile_cont(xt.tss - yt.tss, 0.975), 6) AS hi FROM xt JOIN yt USING (b)),
pa AS (SELECT recall - far AS v FROM (SELECT """ + RATIOS + " FROM (SELECT " + _AT.format(t=0.5) + " FROM ea))), pb AS (SELECT recall - far AS v FROM (SELECT " + RATIOS + " FROM (SELECT " + _AT.format(t=0.5) + " FROM eb))) SELECT round(pa.v - pb.v, 6) AS point, lo, hi, lo > 0 OR hi < 0 AS excludes_zero FROM pa, pb, i")
def difference_ci(s: SparkSession, d: str) -> DataFrame:
    a, b = _halves(s, d)
    return metrics.difference_ci(a, THRESHOLD, b, THRESHOLD, n_resamples=RESAMPLES, draw="groups")


# --- cells and comparisons --------------------------------------------------------------------------------------------------


def _cells(s: SparkSession, d: str) -> DataFrame:
    x = B.scored(s, d)
    frames = {f"c{i + 1}": x.where(F.col("grp") % 4 == i) for i in range(4)}
    return experiment.cells(frames, {"f1": 0.3, "tss": 0.5})


_CELLS = B.SCORED + ", t AS (SELECT *, 'c' || (grp % 4 + 1) AS cell FROM s), z AS (" + " UNION ALL BY NAME ".join("SELECT *, '" + p + "' AS point FROM (" + _SCORE.format(by="cell,", t=t, f="t", g="GROUP BY cell") + ")" for p, t in (("f1", 0.3), ("tss", 0.5))) + ")"


@query("WITH " + _CELLS + " SELECT * FROM z")
def evaluate_cells(s: SparkSession, d: str) -> DataFrame:
    return _cells(s, d)


_STEPS = "point, round(c1 - c2, 6) AS split_leakage, {} AS temporal_shift, {} AS construction_artifact, round(c1 - c4, 6) AS total FROM (PIVOT (SELECT point, cell, tss FROM z) ON cell IN ('c1', 'c2', 'c3', 'c4') USING first(tss))"


@query("WITH " + _CELLS + " SELECT " + _STEPS.format("round(c2 - c3, 6)", "round(c3 - c4, 6)"))
def attribution_waterfall(s: SparkSession, d: str) -> DataFrame:
    return experiment.attribution(_cells(s, d), s.range(1).select(F.lit(1.0).alias("benign_template_share")))


@query("WITH " + _CELLS + " SELECT " + _STEPS.format("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"))
def attribution_guard(s: SparkSession, d: str) -> DataFrame:
    return experiment.attribution(_cells(s, d), audit.template_audit(B.corpus(s, d)))


@query("WITH " + B.SCORED + " " + _SCORE.format(by="", t=0.5, f="(SELECT * FROM s WHERE y = 0 OR grp % 2 = 1)", g=""))
def robustness_cell(s: SparkSession, d: str) -> DataFrame:
    return metrics.score_at(B.scored(s, d).where((F.col("y") == 0) | (F.col("grp") % 2 == 1)), THRESHOLD)


def _tss_sql(frame: str, t: float) -> str:
    return "(SELECT recall - far FROM (SELECT " + RATIOS + " FROM (SELECT " + _AT.format(t=t) + f" FROM {frame})))"


@query("WITH " + B.SCORED + ", " + _HALVES + ", v AS (SELECT " + ", ".join(f"{_tss_sql(f, t)} AS {k}" for k, f, t in (("a", "ea", 0.5), ("b", "eb", 0.5), ("c", "ea", 0.3), ("d", "eb", 0.3))) + ") SELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(a - b, 6) AS gap, round(d - b, 6) AS recovery, round((d - b) / nullif(a - b, 0), 6) AS recovery_fraction FROM v")
def two_by_two(s: SparkSession, d: str) -> DataFrame:
    a, b = _halves(s, d)
    return experiment.two_by_two(a, b, a, b, THRESHOLD, 0.3)


def _comparison(s: SparkSession, d: str) -> DataFrame:
    def one(name: str, f: DataFrame) -> DataFrame:
        best = audit.verdict_summary(audit.structural_rates(f)).select("max_single_property_tss")
        return audit.template_audit(f).select("n", F.col("tss").alias("template_rule_tss")).crossJoin(best).select(F.lit(name).alias("corpus"), "n", "template_rule_tss", "max_single_property_tss")  # one row each

    return experiment.compare(one("orders", B.corpus(s, d)).unionByName(one("pages", B.urls(s, d))))


def _one_sql(name: str, t: str) -> str:
    https, www = f"avg(starts_with(url, 'https')::INT) FILTER (y = {{}})", f"avg(regexp_matches(url, '^[a-z]+://www\\.')::INT) FILTER (y = {{}})"
    path, q = "avg(regexp_matches(url, '^[a-z]+://[^/?#]*/+[^/?#]')::INT) FILTER (y = {})", "avg(regexp_matches(url, '\\?[^#]')::INT) FILTER (y = {})"
    best = "greatest(" + ", ".join(f"abs({e.format(0)} - {e.format(1)})" for e in (https, www, path, q)) + ")"
    rule = "count(*) FILTER (NOT m AND y = 1) / count(*) FILTER (y = 1) - count(*) FILTER (NOT m AND y = 0) / count(*) FILTER (y = 0)"
    return f"SELECT '{name}' AS corpus, count(*) AS n, round({rule}, 6) AS template_rule_tss, round({best}, 6) AS max_single_property_tss FROM (SELECT url, y, regexp_full_match(url, 'https://www\\.[^/?#]+/?') AS m FROM {t})"


@query("WITH " + B.CORPUS + ", " + B.URLS + " SELECT *, row_number() OVER (ORDER BY greatest(template_rule_tss, max_single_property_tss) DESC, corpus)::INT AS rank FROM (" + _one_sql("orders", "c") + " UNION ALL " + _one_sql("pages", "u") + ")")
def comparison_rank(s: SparkSession, d: str) -> DataFrame:
    return _comparison(s, d)


@query("SELECT rank, '| ' || corpus || ' | ' || coalesce(printf('%.3f', template_rule_tss), '—') || ' | ' || coalesce(printf('%.3f', max_single_property_tss), '—') || ' |' AS line FROM (" + _SQL["comparison_rank"] + ")")
def report_lines(s: SparkSession, d: str) -> DataFrame:
    return experiment.render(_comparison(s, d))


# --- models, sealing, streams ---------------------------------------------------------------------------------------------------


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    v = B.table(s, d, "embeddings").where(F.col("embedding").isNotNull())
    names = [f"f{i}" for i in range(v.agg(F.max(F.size("embedding"))).head()[0] or 0)]
    return v.select("vec_id", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 97).alias("domain"), *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names))), names


@query()
def rf_train_predict(s: SparkSession, d: str) -> DataFrame:
    rows, names = _vectors(s, d)
    parts = splits.random_split(rows, "vec_id")
    m = model.train_wide(parts.where("part = 'train'"), names)
    return model.predict(m, parts.where("part = 'test'")).select("vec_id", "y", F.round("prob", 6).alias("prob"))


@query()
def rf_balanced_predict(s: SparkSession, d: str) -> DataFrame:
    """Scores by a forest whose trees have a bootstrap sample and a class balance each."""
    rows, names = _vectors(s, d)
    parts = splits.random_split(rows, "vec_id")
    m = model.train_balanced(parts.where("part = 'train'"), names, **EXPERIMENT)
    return model.predict(m, parts.where("part = 'test'")).select("vec_id", "y", F.round("prob", 6).alias("prob"))


@query()
def rf_importance(s: SparkSession, d: str) -> DataFrame:
    rows, names = _vectors(s, d)
    return model.importances(model.train_wide(rows, names))


@query()
def confound_diagnostic(s: SparkSession, d: str) -> DataFrame:
    rows = U.with_features(B.corpus(s, d)).select("y", "domain", *U.PATH_SHAPE)
    return model.confound(rows, U.PATH_SHAPE)


@query("WITH " + B.URLS + " SELECT page_id, url, y, source FROM u")
def snapshot_seal_roundtrip(s: SparkSession, d: str) -> DataFrame:
    rows = B.urls(s, d).select("page_id", "url", "y", "source")
    key = "0123456789abcdef"
    return readers.unseal(readers.seal(rows, key, ["url", "y", "source"]), key, "url string, y int, source string")


def _streamed(s: SparkSession, d: str, make) -> DataFrame:
    """What a stream over the events' file writes until all of it has been read."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/lacuna-shared"
    base = base.rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    stream = ingest.snapshot_stream(s, d, B.table(s, d, "events").schema, glob="events.parquet")
    ingest.run_available(make(stream), f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup_available_now(s: SparkSession, d: str) -> DataFrame:
    """One row for each user and type over all history."""
    return _streamed(s, d, lambda e: ingest.deduplicated(e.select("event_type", "user_id"), ["event_type", "user_id"]))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup_watermark(s: SparkSession, d: str) -> DataFrame:
    """One row for each event, with state bounded by a watermark."""
    return _streamed(s, d, lambda e: ingest.deduplicated(e.select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id", "ts", "40 days")).select("event_id")


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1 HAVING ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_daily_counts(s: SparkSession, d: str) -> DataFrame:
    """Days that the watermark of one day has closed."""
    return _streamed(s, d, lambda e: ingest.daily_counts(e.select(F.col("ts").cast("timestamp").alias("ts")), "ts")).select(F.col("window.start").cast("date").alias("day"), "n")


# --- shares, paths and samples ---------------------------------------------------------------------------------------


@query("WITH " + _CELLS + ", w AS (SELECT " + _STEPS.format("round(c2 - c3, 6)", "round(c3 - c4, 6)") + """), l AS (SELECT * FROM (UNPIVOT w ON split_leakage, temporal_shift, construction_artifact INTO NAME step VALUE value))
SELECT point, step, value, round(abs(value) / nullif(abs(total), 0), 6) AS share FROM l""")
def attribution_shares(s: SparkSession, d: str) -> DataFrame:
    return experiment.shares(attribution_waterfall(s, d))


@query("WITH " + B.CORPUS + ", " + r"p AS (SELECT y, regexp_matches(string_split(regexp_extract(regexp_replace(url, '^[^:]*://', ''), '^[^/]*/(.*)$', 1), '?')[1], '[^/]')::INT AS has FROM c) SELECT round(avg(has) FILTER (y = 0), 6) AS benign, round(avg(has) FILTER (y = 1), 6) AS phishing FROM p")
def path_presence(s: SparkSession, d: str) -> DataFrame:
    return model.path_presence(B.corpus(s, d))


@query("WITH " + B.PARTS + """, b4 AS (SELECT row_id % 997 AS block, u AS url, registrable AS domain, md5((row_id % 997) || '-20260920') AS bo, md5(u || '-20260920') AS uo FROM x),
k4 AS (SELECT DISTINCT bo, block FROM b4 ORDER BY bo, block LIMIT 400), o4 AS (SELECT b4.* FROM b4 JOIN k4 USING (bo, block) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY bo, block, uo, url) = 1),
t4 AS (SELECT * FROM o4 QUALIFY row_number() OVER (PARTITION BY block ORDER BY bo, block, uo, url) <= 5) SELECT block, url, domain FROM t4 ORDER BY bo, block, uo, url LIMIT 500""")
def random_pages(s: SparkSession, d: str) -> DataFrame:
    """A sample of the corpus as an index in 997 blocks: one URL for each domain, five for each block, in a shuffled order."""
    records = B.corpus(s, d).select((F.col("row_id") % 997).alias("block"), "url", F.lit("200").alias("status"), F.lit("text/html").alias("mime"))
    return readers.random_urls(records, 500, per_block=5, max_blocks=400)


# --- crawl index in blocks ------------------------------------------------------------------------------------------------

_RECORDS = B.PARTS + """, k3 AS (SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS urlkey, lpad(row_id::VARCHAR, 14, '0') AS timestamp, u AS url,
 ['200', '404', '301', '200', '200'][(row_id % 5 + 1)::INT] AS status, ['text/html', 'application/xhtml+xml', 'image/png'][(row_id % 3 + 1)::INT] AS mime FROM x),
a3 AS (SELECT DISTINCT array_to_string(list_reverse(string_split(registrable, '.')), ',') AS prefix FROM x WHERE suffix IN ('org', 'co.uk')), r3 AS (SELECT prefix, urlkey, timestamp, url, status, mime FROM a3 JOIN k3 ON starts_with(urlkey, prefix || ')') OR starts_with(urlkey, prefix || ','))"""


def _indexed(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The corpus as a crawl index in compressed blocks, and the reversed domains of two suffixes as prefixes to look up."""
    rows = U.with_suffix(U.with_parts(B.corpus(s, d)))
    key = F.concat(U.surt(F.col("host")), F.lit(")"), F.col("path"), F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""))
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), (F.col("row_id") % k).cast("int"))
    rows = rows.select(key.alias("urlkey"), F.lpad(F.col("row_id").cast("string"), 14, "0").alias("timestamp"), F.col("u").alias("url"), pick(5, "200", "404", "301", "200", "200").alias("status"), pick(3, "text/html", "application/xhtml+xml", "image/png").alias("mime"), "suffix", "registrable")
    rows = materialize(rows, "records")  # URLs are taken apart once
    path = shared_dir(s, "crawl-index")
    blocks.write_blocks(rows.drop("suffix", "registrable"), path, per_block=500)
    removed_at_exit(s, path)
    return path, rows.where(F.col("suffix").isin("org", "co.uk")).select(U.surt(F.col("registrable")).alias("prefix")).distinct()


@query("WITH " + _RECORDS + " SELECT * FROM r3")
def sparse_index_records(s: SparkSession, d: str) -> DataFrame:
    """Records of many domains by ranged reads of the blocks that can hold them."""
    path, prefixes = _indexed(s, d)
    return blocks.domain_records(s, path, prefixes).drop("block", "line_no")


@query("WITH " + _RECORDS + ", n3 AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY urlkey, timestamp, url) AS n FROM r3), p3 AS (SELECT * FROM n3 WHERE n <= 12 AND status = '200' AND contains(mime, 'html')) SELECT prefix, url FROM p3 QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n) <= 3")
def sparse_index_pages(s: SparkSession, d: str) -> DataFrame:
    """Of the first 12 records of each domain the first 3 fetched pages."""
    path, prefixes = _indexed(s, d)
    return blocks.pages_of(s, path, prefixes, per_domain=3)


_LINES = B.PARTS + """, l5 AS (SELECT row_id, CASE WHEN row_id % 13 = 0 THEN scheme || '://' || netloc || '/robots.txt' ELSE u END AS url, registrable AS domain, ['200', '404', '200', '301', '200'][(row_id % 5 + 1)::INT] AS status, ['text/html', 'application/pdf'][((row_id // 7) % 2 + 1)::INT] AS mime FROM x),
w5 AS (SELECT *, CASE WHEN row_id % 11 = 0 THEN 'damaged' WHEN status <> '200' THEN 'not_200' WHEN NOT contains(mime, 'html') THEN 'not_html' WHEN ends_with(url, '/robots.txt') THEN 'no_page' END AS why FROM l5),
g5 AS (SELECT domain, count(*) AS n FROM w5 WHERE why IS NULL GROUP BY 1), f5 AS (SELECT * FROM g5 ORDER BY md5(domain || '-20260920'), domain LIMIT 40), s5 AS (SELECT n, domain IN (SELECT domain FROM f5) AS of FROM g5)
SELECT reason, coalesce(n, 0)::BIGINT AS n FROM (SELECT r.reason, c.n FROM (VALUES ('damaged'), ('not_200'), ('not_html'), ('no_page')) r(reason) LEFT JOIN (SELECT why, count(*) AS n FROM w5 GROUP BY why) c ON c.why = r.reason
 UNION ALL SELECT 'over_domains', sum(n) FILTER (NOT of) FROM s5 UNION ALL SELECT 'over_per_domain', sum(greatest(n - 5, 0)) FILTER (of) FROM s5 UNION ALL SELECT 'kept', sum(least(n, 5)) FILTER (of) FROM s5)"""


@query("WITH " + _LINES)
def index_tallies(s: SparkSession, d: str) -> DataFrame:
    """The corpus as lines of an index, some of them damaged: how many are kept, and how many are refused for each reason."""
    rows = U.with_suffix(U.with_parts(B.corpus(s, d)))
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    url = F.when(F.col("row_id") % 13 == 0, F.concat("scheme", F.lit("://"), "netloc", F.lit("/robots.txt"))).otherwise(F.col("u"))
    line = F.to_json(F.struct(url.alias("url"), pick(F.col("row_id") % 5, "200", "404", "200", "301", "200").alias("status"), pick(F.floor(F.col("row_id") / 7) % 2, "text/html", "application/pdf").alias("mime")))
    path = shared_dir(s, "index-lines")
    rows.select(F.when(F.col("row_id") % 11 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    removed_at_exit(s, path)
    return readers.tallied_index(s, path, per_domain=5)[1]


@query("WITH " + B.URLS + " SELECT page_id, url, y, source, snapshot_date FROM u")
def sealed_days(s: SparkSession, d: str) -> DataFrame:
    """Days written once as files, every other one sealed, and read back under one glob."""
    rows, path, key = B.urls(s, d).select("page_id", "url", "y", "source", "snapshot_date"), shared_dir(s, "days"), "0123456789abcdef"
    even = F.dayofmonth("snapshot_date") % 2 == 0
    days.write_sealed(rows.where(even), path, key, block_rows=500)
    days.write_plain(rows.where(~even), path)
    days.write_plain(rows.withColumn("url", F.lit("of a later writer")), path)  # leaves all days as they are
    removed_at_exit(s, path)
    return days.read_days(s, path, "page_id long, url string, y int, source string", key)


@query(_TIMELINE)
def stream_timeline(s: SparkSession, d: str) -> DataFrame:
    """The timeline from files of sightings that arrive in no order of days, kept by a stream."""
    base = shared_dir(s, "stream-timeline")
    rows = _visits(s, d)
    lots = max(1, -(-rows.count() // (6 * FILE_ROWS)))  # files do not grow
    rows.repartition(6 * lots, F.xxhash64("page_id")).write.parquet(f"{base}/in")
    files = len(s.read.schema(rows.schema).parquet(f"{base}/in").inputFiles())  # three micro-batches, however many were written
    stream_of_days.run_timeline(ingest.snapshot_stream(s, f"{base}/in", rows.schema, files_per_trigger=max(1, -(-files // 3))), f"{base}/out", f"{base}/state", parts=6 * lots)
    removed_at_exit(s, base)
    return stream_of_days.timeline(s, f"{base}/out")


# --- the experiment from split to cells ---------------------------------------------------------------------------------------

def _experiment_parts(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The random and the disjoint split of the corpus with its features: rows are dealt while they are narrow, then widened and written once for both."""
    narrow = B.corpus(s, d).select("row_id", "y", "domain", "url")
    dealt = materialize(splits.disjoint_split(narrow).withColumnRenamed("part", "disjoint"), "dealt")
    tasks = max(4 * s.sparkContext.defaultParallelism, dealt.count() // FILE_ROWS)  # features cost the same in every row, so tasks get equal shares
    rows = splits.random_split(dealt, "row_id").withColumnRenamed("part", "random").repartition(tasks, "row_id")
    wide = materialize(U.with_features(rows).select("row_id", "y", "domain", "random", "disjoint", *U.FEATURES), "features")
    return {k: wide.withColumn("part", F.col(k)).drop("random", "disjoint") for k in ("random", "disjoint")}


@query()
def experiment_cells(s: SparkSession, d: str) -> DataFrame:
    """Two forests, trained on a random and on a disjoint split of the corpus, scored on their test parts and on the live rows."""
    rows = materialize(U.with_features(B.urls(s, d)).select("y", "source", "domain", *U.FEATURES), "live")
    parts = _experiment_parts(s, d)  # each is read for training, thresholds and scores
    fitted = {k: model.fit(p, U.FEATURES, k, **EXPERIMENT) for k, p in parts.items()}
    test = {k: p.where("part = 'test'") for k, p in parts.items()}
    return experiment.run(fitted["random"], fitted["disjoint"], test["random"], test["disjoint"], rows, RESAMPLES)
