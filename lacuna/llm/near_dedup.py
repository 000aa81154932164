"""MinHash near-duplicates by a multi-index Hamming join.

A document's set: the distinct hashes of its shingles of ``words`` words (64 bits; fewer words make one shingle).
Equal sets are one node from the start, so exact copies cost a row each and nothing more.

A node's signature has ``CHUNKS * CHUNK`` MinHash values of 16 bits. Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` = 19 of the 50 values agree, by the pigeonhole principle, in some chunk of five
values up to one error. Every chunk is therefore written once for each place that may be wrong, that place left
out: all pairs within distance 19 share such a key, the bucket. At a similarity of 0.8 a pair shares one with a
probability above 0.999998, since a chunk with at most one error among the ten is enough.

Every pair of a bucket ends in one component or is checked on its full sets; no pair is ruled out by anything
else. Pairs are never rows:

1. Each node meets the leader of one of its buckets, the one nearest by signature. A bucket's leader is its node
   whose buckets are largest together, which is the text that the others of a family were made from. Links are
   confirmed on full sets, components follow.
2. In buckets that still hold several components, the nodes outside the largest one meet all others in tiles of at
   most ``TILE_NODES`` nodes and about ``TILE_ELEMENTS`` shingles. A tile counts the intersections of all its pairs
   at once, as a product of two 0/1 matrices, and returns links of a spanning forest of its components: fewer
   rows than it has nodes. Buckets with the same nodes are taken once.

Defined cases: null or blank text is the empty set and linked with nothing. Null ids take part in links, are
never a component's id, and are kept only where all ids of the component are null. Repeated rows are copies with
the same id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_bytes, hashes_of, materialize, mix, n_buckets, slices, table

CHUNKS, CHUNK, ERRORS = 10, 5, 1
VALUES = CHUNKS * CHUNK
#: A leader that agrees in fewer values than this is not tried in the first round.
LEAST_EQUAL = 24
#: Nodes of one side of a tile, and shingles of its sets, about.
TILE_NODES, TILE_ELEMENTS = 512, 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_XOR = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = mix(np.arange(101, VALUES + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_CHAIN = np.uint64(0xD1342543DE82EF95)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = flat_bytes(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    at = np.searchsorted(starts, offsets)
    base = hashes_of(data, starts, ends)
    del data, inside, first, starts, ends
    size, out = np.diff(at), [base[:0]] * len(texts)
    runs = base
    for k in range(1, words):
        for i in np.flatnonzero(size == k).tolist():  # the whole text is one shingle
            out[i] = runs[at[i] : at[i] + 1]
        runs = mix(runs[:-1] * _CHAIN + base[k:]) if len(runs) else runs
    for i in np.flatnonzero(size >= words).tolist():
        out[i] = np.unique(runs[at[i] : at[i + 1] - words + 1])
    return out


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tx, n, node, check, signature): tx is a hash of the text; node and check are hashes of the whole set, null where it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(n)
            node, check = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
            values = np.zeros((len(n), VALUES), dtype=np.uint16)
            if len(some):
                h = np.concatenate([sets[i] for i in some])
                at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                node[some] = mix(np.add.reduceat(mix(h ^ _XOR[0]), at) + n[some].astype(np.uint64))
                check[some] = np.add.reduceat(mix(h ^ _XOR[1]), at)
                least = np.empty((VALUES, len(some)), dtype=np.uint64)
                for k in range(VALUES):
                    least[k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], at)
                values[some] = (mix(least) >> np.uint64(48)).astype(np.uint16).T
            none = n == 0
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * VALUES), pa.array(values.ravel().view(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tx"), pa.array(n), pa.array(node.view(np.int64), mask=none), pa.array(check.view(np.int64), mask=none), sig], names=["id", "tx", "n", "node", "check", "signature"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    return rows.mapInArrow(sign, "id long, tx long, n long, node long, check long, signature array<short>")


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): for each chunk of a signature and each place in it that may be wrong, a hash of the other places."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                flat = some.column("signature").flatten().to_numpy(zero_copy_only=False).view(np.uint16).astype(np.uint64)
                chunks = flat.reshape(some.num_rows, CHUNKS, CHUNK)
                out = np.empty((some.num_rows, CHUNKS, CHUNK), dtype=np.uint64)
                for wrong in range(CHUNK):
                    packed = np.zeros((some.num_rows, CHUNKS), dtype=np.uint64)
                    for k in range(CHUNK):
                        if k != wrong:
                            packed = (packed << np.uint64(16)) | chunks[:, :, k]
                    tag = np.arange(1, CHUNKS + 1, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(wrong)
                    out[:, :, wrong] = mix(packed ^ mix(tag.copy()))
                node = np.repeat(some.column("node").to_numpy(zero_copy_only=False), VALUES)
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(keys, "key long, node long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that an edge (a, b) names.

    Each node hooks to its smallest neighbour, edges are rewritten to the hooked nodes, and so on until none is
    left; their number falls quickly, and each round is a table in the shared folder.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hook = materialize(hook.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "hooks")
        labels = materialize(labels.join(hook, F.col("component") == F.col("v"), "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        moved = edges.join(hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a", "left").join(hook.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b", "left")
        moved = moved.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of :func:`components` after more links (a, b): only the components that these join are worked out anew."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    over = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(over)  # its nodes are components, or nodes that had no link before
    old = labels.join(joined.select(F.col("node").alias("_c"), F.col("component").alias("_to")), F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = joined.join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new), "labels")


def near(pairs: DataFrame, nodes: DataFrame, percent: int, least_equal: int) -> DataFrame:
    """Pairs (a, b) that sizes and signatures do not rule out, with ``equal``, the number of equal values."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    out = pairs.join(one("a"), "a").join(one("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return out.withColumn("equal", equal).where(F.col("equal") >= least_equal).select("a", "b", "na", "nb", "equal")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    out = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    return out.withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def tiles(rows: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, i, j, side, node, c, major, h), sorted by tile: the nodes of a bucket outside its largest component (side 0) and all of its nodes (side 1), cut into tiles (i, j)."""
    mine = rows.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mine = mine.join(sets.select("node", F.size("h").alias("n")), "node")
    sizes = mine.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"))
    total = [F.sum("m").alias("m"), F.sum("w").alias("w"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")]
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "c", "w")).alias("x"), F.count("*").alias("cs"), *total).where("cs > 1")
    cut = lambda m, w: F.greatest(F.ceil(m / TILE_NODES), F.ceil(w / TILE_ELEMENTS)).cast("int")
    mixed = mixed.select("key", "s1", "s2", "m", F.col("x.c").alias("major"), cut(F.col("m") - F.col("x.m"), F.col("w") - F.col("x.w")).alias("ti"), cut(F.col("m"), F.col("w")).alias("tj"))
    once = mixed.groupBy("m", "s1", "s2").agg(F.min_by(F.struct("key", "major", "ti", "tj"), "key").alias("x")).select("x.*")
    mine = materialize(mine.select("key", "node", "c", "n").join(once, "key"), "mixed")
    place = lambda k: F.pmod(F.xxhash64("node", F.lit(2)), F.col(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    x = mine.where("c <> major").withColumn("i", place("ti")).withColumn("j", all_("tj")).withColumn("side", F.lit(0))
    y = mine.withColumn("j", place("tj")).withColumn("i", all_("ti")).withColumn("side", F.lit(1))
    both = x.unionByName(y).select("key", "i", "j", "side", "node", "c", "major")
    held = mine.agg(F.sum(F.col("n") * (F.col("ti") + F.col("tj")))).head()[0]
    parts = n_buckets(held or 0, 4 * TILE_ELEMENTS, 1)
    return both.join(sets.select("node", "h"), "node").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node").select("key", "i", "j", "side", "node", "c", "major", "h")


def tile_links(node: np.ndarray, c: np.ndarray, major: int, x: int, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that join components, of the first ``x`` nodes of a tile with the others: a spanning forest of all its links."""
    nx, ny = node[:x], node[x:]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sx, sy = sizes[:x, None], sizes[None, x:]
    # Of two nodes outside the largest component each would meet the other.
    open_ = (c[:x, None] != c[None, x:]) & ((c[x:] == major)[None, :] | (nx[:, None] < ny[None, :])) & (100 * np.minimum(sx, sy) >= percent * np.maximum(sx, sy))
    if not open_.any():
        return []
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    side = np.repeat(np.arange(len(sets)), sizes)
    in_x = np.zeros(len(values), dtype=bool)
    in_x[at[side < x]] = True
    in_y = np.zeros(len(values), dtype=bool)
    in_y[at[side >= x]] = True
    number = np.cumsum(in_x & in_y) - 1
    common = (in_x & in_y)[at]
    row, column = side[common], number[at[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros(open_.shape, dtype=np.float32)  # whole numbers below 2**24 are exact
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        held = np.zeros((len(sets), 4096), dtype=np.float32)
        held[row[a:b], column[a:b] - first] = 1
        both += held[:x] @ held[x:].T
    both = both.astype(np.int64)
    found = np.argwhere(open_ & (100 * both >= percent * (sx + sy - both)))
    of: dict[int, int] = {}

    def root(k: int) -> int:
        while of.get(k, k) != k:
            k = of[k]
        return k

    out = []
    for i, j in found.tolist():
        a, b = root(int(c[i])), root(int(c[x + j]))
        if a != b:
            of[max(a, b)] = min(a, b)
            out.append((int(nx[i]), int(ny[j])))
    return out


def rest_of_links(rows: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join components of a bucket, after all its pairs of two components were checked on their full sets."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def done() -> pa.RecordBatch:
            node, c = (np.array([r[k] for r in held], dtype=np.int64) for k in (1, 2))
            links = tile_links(node, c, held[0][3], sum(r[0] == 0 for r in held), [r[4] for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            flat = batch.column("h").values.to_numpy(zero_copy_only=False)
            ends = batch.column("h").offsets.to_numpy().tolist()
            columns = [batch.column(k).to_pylist() for k in ("key", "i", "j", "side", "node", "c", "major")]
            for at, (key, i, j, *r) in enumerate(zip(*columns, strict=True)):
                if (key, i, j) != tile and held:
                    yield done()
                    held = []
                tile = key, i, j
                held.append((*r, flat[ends[at] : ends[at + 1]].copy()))
        if held:
            yield done()

    return tiles(rows, sets, labels).mapInArrow(meet, "a long, b long")


#: What a row is found by again: the hash of its text, its id, and whether that is null.
KEY = ["tx", "idn", "idnull"]


def keyed(id_: Column, tx: Column) -> list[Column]:
    return [tx.alias("tx"), F.coalesce(id_, F.lit(0).cast("long")).alias("idn"), id_.isNull().alias("idnull")]


def set_rows(docs: DataFrame, named: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, h): the full set of each named node, from one of its documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            node = np.array([mix(mix(s ^ _XOR[0]).sum(keepdims=True) + np.uint64(len(s)))[0] if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            mine = np.flatnonzero(node == batch.column("node").to_numpy(zero_copy_only=False))  # two texts of one id could have one hash
            sizes = np.array([len(sets[i]) for i in mine], dtype=np.int64)
            flat = np.concatenate([sets[i] for i in mine]).view(np.int64) if len(mine) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(node[mine]), lists], names=["node", "h"])

    text = F.col(text_col).cast("string")
    rows = docs.select(*keyed(F.col(id_col).cast("long"), F.xxhash64(text)), text.alias("text")).join(named, KEY)
    return rows.select("node", "text").mapInArrow(build, "node long, h array<long>").dropDuplicates(["node"])


def linked(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tx, n, c, component_id) for each row; ``c`` numbers components and is null for empty sets. Links: intersection at least ``percent`` of the union."""
    signed = materialize(signatures(docs, words, id_col, text_col), "signatures")
    full = signed.where(F.col("node").isNotNull())
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tx")).alias("first")
    nodes = materialize(full.groupBy("node", "check").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), first), "nodes")
    keys = chunk_keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = materialize(keys.join(shared, "key"), "buckets")
    known = materialize(rows.groupBy("node").agg(F.sum("m").alias("pop")), "known")
    leaders = rows.join(known, "node").groupBy("key").agg(F.max_by("node", F.struct("pop", "node")).alias("leader"))
    stars = rows.join(leaders, "key").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    best = near(stars, nodes, percent, LEAST_EQUAL).groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("equal", "a")).alias("x")).select("x.a", "b", "x.na", "x.nb")
    best = materialize(best, "round1")
    # Full sets of the nodes that stand in a bucket with others; one document for each node.
    named = known.select("node").join(nodes.select("node", "first"), "node").select("node", *keyed(F.col("first.id"), F.col("first.tx")))
    sets = materialize(set_rows(docs, named, words, id_col, text_col), "sets")
    labels = components(materialize(confirmed(best, sets, percent), "links1"))
    more = materialize(rest_of_links(rows, sets, labels, percent), "links2")
    if not more.isEmpty():
        labels = extended(labels, more)
    of = nodes.select("node", "check", F.col("first.id").alias("id")).join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = of.groupBy("c").agg(F.min("id").alias("component_id"))
    of = of.join(smallest, "c").select(F.col("node").alias("_node"), F.col("check").alias("_check"), "c", "component_id")
    out = signed.join(of, (F.col("node") == F.col("_node")) & (F.col("check") == F.col("_check")), "left")
    return out.select("id", "tx", "n", "c", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    out = linked(docs, words, percent, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT rowid AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT rid, CASE WHEN len(ws) < 4 THEN md5(array_to_string(ws, ' ')) ELSE md5(array_to_string(ws[i:i + 3], ' ')) END AS h FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.rid < b.rid GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, doc_id IS NULL AND component_id IS NULL) AS kept FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, by shingles of five words: of the rows with its smallest id, one. Null or blank texts stay, each row.

    Rows are told apart by id and text, so of repeated ids only what is linked goes. Any columns are carried along.
    """
    marked = materialize(linked(docs), "linked")  # narrow rows: what led to them can go
    none = marked.where("c is null").select(*keyed(F.col("id"), F.col("tx")), F.lit(True).alias("blank")).distinct()
    rest = marked.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tx")).alias("x"))
    kept = none.unionByName(rest.select(*keyed(F.col("x.id"), F.col("x.tx")), F.lit(False).alias("blank")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), *keyed(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    rows = whole.join(kept, KEY)
    one = rows.where("not blank").groupBy(*KEY).agg(F.first("row").alias("row"))
    return one.select("row.*").unionByName(rows.where("blank").select("row.*"))
