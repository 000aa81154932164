"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns under a token budget. Each
window holds the system turn, as many whole turns of history as fit ``history_tokens``, and its own turns.
Only assistant turns of a window's own part are targets of the loss; repeated turns are masked, so each
target counts once over all windows.

Template of a turn: ``<s>role[SEP]text</s>``. Control strings inside roles and texts get one backslash after
their first character (and one more if they have backslashes there), which :func:`unescape` takes out.

Defined cases: null text or role is empty; rows of a null conversation form one conversation. Turns order by
turn, role, text, so repeated rows and ties have a fixed order and each is a turn. A turn longer than the
budget stands in a window of its own, whole, with ``over_budget`` true. Only a first turn of role ``system``
is repeated. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

OPEN, SEP, CLOSE = "<s>", "[SEP]", "</s>"
CONTROL = r"(/?s>|(?:SEP|/?INST)\])"
BUDGET, HISTORY = 1024, 128


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def tokens(text: Column) -> Column:
    """Words, digits and signs by a pattern, and 4 for the template: a stand-in for a tokenizer that runs inside Spark's own functions."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]")) + 4).cast("long")


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history_tokens: int = HISTORY, tokens_col: str | None = None) -> DataFrame:
    """Rows (conv_id, window, formatted, loss_spans, repeated, n_tokens, over_budget).

    ``tokens_col``: the tokens of each turn's text as some tokenizer counted them (null: none); else :func:`tokens` counts.

    ``loss_spans``: (start, length) in characters of ``formatted``, from 0. ``repeated``: for each turn in it,
    whether it repeats a turn of an earlier window. ``n_tokens`` includes what is repeated.
    """
    w = Window.partitionBy("_c").orderBy("_t", "_r", "_x")
    rows = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(role_col, F.lit("")).alias("_r"), F.coalesce(text_col, F.lit("")).alias("_x"), (tokens(F.col(text_col)) if tokens_col is None else F.greatest(F.coalesce(tokens_col, F.lit(0)), F.lit(0)).cast("long") + 4).alias("_n"))
    rows = (
        rows.withColumn("_i", F.row_number().over(w))
        .withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_sys", F.first(F.when(F.col("_r") == "system", F.struct("_r", "_x", "_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # What is left for a window's own turns, less what the system turn and history can take.
    room = F.greatest(F.lit(budget - history_tokens) - F.coalesce(F.col("_sys._n"), F.lit(0)), F.lit(max(1, budget // 4)))
    rows = rows.withColumn("_room", room).withColumn("_cell", F.floor((F.col("_end") - 1) / F.col("_room")))
    # A cell's turns but the one that crosses into it sum to less than the room; with that one they may not.
    cell = Window.partitionBy("_c", "_cell")
    rows = rows.withColumn("_apart", (F.sum("_n").over(cell) > F.col("_room")) & (F.col("_start") < F.col("_cell") * F.col("_room")))
    rows = rows.withColumn("_first", (F.col("_i") == 1) | F.coalesce((F.col("_cell") != F.lag("_cell").over(w)) | (F.col("_apart") != F.lag("_apart").over(w)), F.lit(False)))
    rows = rows.withColumn("_w", F.sum(F.col("_first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # A turn is history of the windows that begin at most history_tokens after its own begin; every turn has
    # tokens, so a turn sees no more of them than that.
    reach = Window.partitionBy("_c").orderBy("_start").rangeBetween(1, history_tokens)
    rows = rows.withColumn("_later", F.collect_list(F.when(F.col("_first"), F.col("_w"))).over(reach))
    system = F.col("_sys").isNotNull() & (F.col("_i") == 1)
    own = rows.select("_c", "_w", F.lit(2).alias("_kind"), "_i", "_r", "_x", "_n")
    past = rows.where(~system & (F.size("_later") > 0)).select("_c", F.explode("_later").alias("_w"), F.lit(1).alias("_kind"), "_i", "_r", "_x", "_n")
    heads = rows.where(F.col("_first") & (F.col("_w") > 0) & F.col("_sys").isNotNull()).select("_c", "_w", F.lit(0).alias("_kind"), F.lit(1).alias("_i"), F.col("_sys._r").alias("_r"), F.col("_sys._x").alias("_x"), F.col("_sys._n").alias("_n"))
    head, body = F.concat(F.lit(OPEN), escape(F.col("_r")), F.lit(SEP)), escape(F.col("_x"))
    parts = own.unionByName(past).unionByName(heads).select("_c", "_w", F.struct("_kind", "_i", head.alias("head"), body.alias("body"), (F.col("_r") == "assistant").alias("says"), F.col("_n").alias("n")).alias("p"))
    got = parts.groupBy("_c", "_w").agg(F.array_sort(F.collect_list("p")).alias("p"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def add(a: Column, x: Column) -> Column:
        start, size = a["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.when((x["_kind"] == 2) & x["says"], F.array(F.struct(start.alias("start"), size.alias("length"))))
        return F.struct((start + size + len(CLOSE)).alias("at"), F.concat(a["spans"], F.coalesce(span, F.expr("cast(array() as array<struct<start:int,length:int>>)"))).alias("spans"))

    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return got.select(
        F.col("_c").alias(conv_col), F.col("_w").alias("window"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("p", zero, add)["spans"].alias("loss_spans"),
        F.transform("p", lambda x: x["_kind"] != 2).alias("repeated"), total.alias("n_tokens"), (total > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """From the windows alone: (conv_id, window, turns: role and text of the turns that are not repeated, targets: unescaped texts under the loss)."""
    parts = F.split("formatted", CLOSE)
    turns = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.struct(F.get(F.col("repeated"), i).alias("again"), F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), SEP, 1).alias("role"), F.substring(x, F.locate(SEP, x) + len(SEP), F.lit(1 << 30)).alias("text"))), lambda x: ~x["again"])
    turns = F.transform(turns, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(conv_col, "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    kinds = dict(turns.dtypes)
    more = spark.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(windows(turns.unionByName(more)))
    turned = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = back.select("conv_id", F.struct("window", F.size("turns").cast("long").alias("n"), turned.alias("t"), F.array_join("targets", "").alias("l"), F.col("chars").cast("long").alias("f")).alias("w"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda k: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[k])
    joined = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    return rows.select("conv_id", total("n").alias("n_turns"), F.sha2(joined("t"), 256).alias("turns_sha256"), F.length(joined("l")).cast("long").alias("loss_chars"), F.sha2(joined("l"), 256).alias("loss_sha256"), total("f").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, len(regexp_extract_all(text, '\p{L}{1,6}|\p{N}{1,3}|[^\x20\x09-\x0D\p{L}\p{N}]')) + 4 AS n,
 12 + length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|(SEP|/?INST)\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|(SEP|/?INST)\])')) AS chars FROM t),
a AS (SELECT *, row_number() OVER o AS i, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS stop, first_value(role) OVER o = 'system' AS headed, first_value(n) OVER o AS head_n, first_value(chars) OVER o AS head_chars FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
r AS (SELECT *, stop - n AS start, greatest(1024 - 128 - CASE WHEN headed THEN head_n ELSE 0 END, 256) AS room FROM a),
l AS (SELECT *, (stop - 1) // room AS cell FROM r),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, cell) > room AND start < cell * room AS apart FROM l),
f AS (SELECT *, i = 1 OR cell <> lag(cell) OVER o OR apart <> lag(apart) OVER o AS opens FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
h AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 1 FOLLOWING AND 128 FOLLOWING) AS again FROM f)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum(chars) + sum(CASE WHEN headed AND i = 1 THEN 0 ELSE chars * again END) + sum(CASE WHEN opens AND i > 1 AND headed THEN head_chars ELSE 0 END))::BIGINT AS formatted_chars,
 count(*) FILTER (opens) AS n_windows
FROM h GROUP BY conv_id
"""
