"""Quality rules from cross-document line frequency, in DataFrame functions only.

Every line is normalised (lower case, blanks joined, digits as 0) and hashed. For each host the distinct
documents that hold a line are counted; a line in more than ``max_documents`` of them is taken as
boilerplate and removed, and a document that keeps less than ``min_kept_share`` of the characters of its lines is rejected.

A copy repeats every line of its original, so counts of rows would take each line of a much copied document for
boilerplate and lose the original too. Documents of a host are therefore distinct by their text: copies count once, and
documents that share lines count each, be it all lines but for their numbers. Removing copies is the work of the
deduplication stages.

Texts are read once: a narrow table keeps the base metrics and the hashes and lengths of lines. Two 64-bit hashes with
different seeds stand for a line of a host.

Defined cases: null text is a text without words; its base rules fail. A null host is a host of its own.
Lines without a word count for nothing. Repeated rows are copies; each gets its own result row. An empty
table gives an empty result. Extra columns stay as they are; working columns start with ``_q``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
#: In how many distinct documents of a host a line may stand, and the share of its lines' characters a document must keep.
MAX_DOCUMENTS, MIN_KEPT_SHARE = 100, 0.5
SALTS = 16
#: Frequent lines up to which they are broadcast (16 bytes each).
MOST_BROADCAST = 1_000_000
#: Rejected rows up to which their keys are broadcast (16 bytes each).
MOST_REJECTED = 2_000_000


def let(value: Column, f) -> Column:
    """``f(value)`` with value computed once for each row, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words that stand in a window of that many words found twice or more in the list, the first one included."""
    none = F.lit(0).cast("long")

    def hashed(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, window)))), 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))

    def union(at: Column) -> Column:
        """Length of the union of [p, p + window) over ascending positions."""
        return F.aggregate(at, F.struct(none.alias("n"), F.lit(-window).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")))["n"]

    def few(h: Column, d: Column) -> Column:
        return F.transform(F.filter(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), lambda x: F.array_contains(d, x["h"])), lambda x: x["i"])

    def many(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"])))

    def covered(h: Column) -> Column:
        twice = let(F.array_sort(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        return let(twice, lambda d: union(F.when(F.size(d) <= 128, few(h, d)).otherwise(many(h))))

    # Few texts repeat a window, and hashes alone show that none does.
    return let(words, lambda w: F.when(F.size(w) >= window, let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none))).otherwise(none))


def base_metrics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "_qw": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r"))),
    }


def line_hashes(text: Column) -> Column:
    """Structs of the hash and the length of each line that has a word, normalised."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Nd}", "0")
    text = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("g"), F.xxhash64(F.lit(1), x).alias("h"), F.length(x).cast("long").alias("c")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """One row for each row of ``docs``: the id, the base metrics, base_failed, n_removed_chars and kept."""
    return judged(docs, id_col, text_col, host_col, max_documents, min_kept_share).drop("_qkey")


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> Column:
    row = [docs[id_col], docs[host_col], docs[text_col]]
    return F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *reversed(row)).alias("b"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """The rows of :func:`judge` with the key of each row, ``_qkey``."""
    text, none = F.col("_qtext"), F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("_qid"), F.col(host_col).alias("_qhost"), F.col(text_col).alias("_qtext"), row_key(docs, id_col, text_col, host_col).alias("_qkey"))
    narrow = rows.select("_qid", "_qkey", "_qhost", F.xxhash64(text).alias("_qfamily"), *(c.alias(k) for k, c in base_metrics(text).items()), line_hashes(text).alias("_ql"))
    narrow = narrow.withColumn("_qall", F.aggregate("_ql", none, lambda a, x: a + x["c"])).withColumn("_qrow", F.monotonically_increasing_id())
    narrow = materialize(narrow, "lines")  # once, so a row's number stays
    host = [F.coalesce(F.col("_qhost"), F.lit("")), F.col("_qhost").isNull()]
    key = [F.xxhash64(*host, "_qx.g").alias("_qa"), F.xxhash64("_qx.h", *host).alias("_qb")]
    lines = narrow.select("_qrow", "_qfamily", "_qhost", F.explode("_ql").alias("_qx")).select("_qrow", "_qfamily", *key, F.col("_qx.c").alias("_qn"))
    frequent = (
        lines.groupBy("_qa", "_qb", "_qfamily").agg(F.lit(1).alias("_qone"))
        .groupBy("_qa", "_qb").agg(F.count("*").alias("_qdocs")).where(F.col("_qdocs") > max_documents)
        .select("_qa", "_qb")
    )
    frequent = materialize(frequent, "frequent")  # at most 1/max_documents as many as lines
    if frequent.count() <= MOST_BROADCAST:
        hits = lines.join(F.broadcast(frequent), ["_qa", "_qb"], "left_semi")
    else:  # a hot line meets its lines in SALTS tasks
        salted = frequent.withColumn("_qsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("_qsalt", F.pmod("_qrow", F.lit(SALTS)).cast("int")).join(salted, ["_qa", "_qb", "_qsalt"], "left_semi")
    removed = hits.groupBy("_qrow").agg(F.sum("_qn").alias("n_removed_chars"))
    out = narrow.drop("_ql", "_qfamily", "_qhost").join(removed, "_qrow", "left")
    n, r = F.col("_qw.n"), F.col("_qw.r")
    failed = (n < 10) | (100 * r > 20 * n)
    removed_chars = F.coalesce("n_removed_chars", none)
    depleted = F.col("_qall") - removed_chars < min_kept_share * F.col("_qall")
    return out.select("_qkey", F.col("_qid").alias(id_col), n.alias("n_words"), F.col("_qw.c").alias("word_chars"), "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"), removed_chars.alias("n_removed_chars"), (~failed & ~depleted).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, source IS NULL AS nohost, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS g FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY rid),
cnt AS (SELECT rid, count(*) AS n, sum(length(word)) AS c FROM w GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
l AS (SELECT rid, host, nohost, trim(regexp_replace(l, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS l FROM (SELECT rid, host, nohost, unnest(string_split(regexp_replace(lower(t), '\p{Nd}', '0', 'g'), chr(10))) AS l FROM d)),
k AS (SELECT rid, host, nohost, l FROM l WHERE l <> ''),
q AS (SELECT rid, md5(t) AS whole FROM d),
f AS (SELECT host, nohost, l FROM k JOIN q USING (rid) GROUP BY ALL HAVING count(DISTINCT whole) > 100),
x AS (SELECT k.rid, sum(length(k.l)) AS total, coalesce(sum(length(k.l)) FILTER (f.l IS NOT NULL), 0) AS gone FROM k LEFT JOIN f ON k.host = f.host AND k.nohost = f.nohost AND k.l = f.l GROUP BY k.rid),
m AS (SELECT doc_id, coalesce(cnt.n, 0) AS n_words, coalesce(cnt.c, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
 coalesce(rep.n, 0) AS n_repeat_words, coalesce(x.gone, 0)::BIGINT AS n_removed_chars, coalesce(x.total, 0) AS total
 FROM d LEFT JOIN cnt USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN x USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n_removed_chars,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (total - n_removed_chars < 0.5 * total) AS kept FROM m
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their columns; rows that share an id, or have none, are kept each by itself.

    The keys of what is rejected are broadcast up to a checked number, and no text is shuffled; beyond it, all rows meet them.
    """
    gone = materialize(judged(docs).where(~F.col("kept")).select(F.col("_qkey").alias("_qgone")).distinct(), "rejected")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_REJECTED else gone, row_key(docs) == gone["_qgone"], "left_anti")
