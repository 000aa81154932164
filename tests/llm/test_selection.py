"""Importance resampling, automaton deduplication and lexical search against brute force, with the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import automaton_dedup, common, importance, lexical_search, words

DOCS = "doc_id long, text string, rank int, _g string"
LOWERED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def terms(text):
    return LOWERED.findall(lower(text or ""))


def odd_texts():
    rng = random.Random(5)
    base = ["the", "Quick", "bröwn", "fox", "x" * 80, "a1b2", "东西", "№5", "don't", "well-known"]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randrange(60))) for _ in range(60)]
    return [None, "", " \t\n ", "--- !!!", "one", *texts, texts[3], texts[3], "word " * 400, " ".join(f"w{i}" for i in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(odd_texts())]
    rows += [rows[9], (None, "a null id " * 10, 1, None), (None, None, None, None), (7, "another text of the id " * 5, 2, "y")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- importance --------------------------------------------------------------------------------------------------


def features(text, buckets, run=3):
    w = terms(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def resampled_by_brute_force(docs, target, buckets, percent, least):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, buckets))
    for text in target:
        t.update(features(text, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text, buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(text)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r.append(k + 1)
    return [tuple(r[:4] + [r[5] if len(r) > 5 else None]) for r in out]


@pytest.mark.parametrize("chunk_bytes", [1 << 16, 40])
def test_resampling_equals_brute_force(spark, docs, chunk_bytes):
    target = ["the quick fox", None, "x" * 80 + " fox fox", "", "w1 w2 w3"]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, items, buckets=50, percent=40, least_words=5, chunk_bytes=chunk_bytes)
    rows = sorted(map(tuple, got.drop("n_words").collect()), key=str)
    want = resampled_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], target, 50, 40, 5)
    assert rows == sorted(want, key=str)
    assert sum(r[4] is not None for r in rows) > 10


def test_resampling_of_empty_tables(spark, docs):
    items = spark.createDataFrame([], "text string")
    assert importance.resample(docs.where("false"), items).count() == 0
    got = importance.resample(docs, items, percent=100).collect()
    assert len(got) == docs.count() and sum(r["rank"] is not None for r in got) == sum(r["n_words"] >= 20 for r in got)


def test_checksums_of_joined_strings():
    rng = random.Random(1)
    some = lambda sizes: [bytes(rng.randrange(256) for _ in range(rng.choice(sizes))) for _ in range(100)]
    a, b = some([0, 1, 5, 200]), some([0, 1, 62, 63, 64, 65, 5000])
    crc = lambda x: np.array([zlib.crc32(v) for v in x], dtype=np.uint32)
    assert importance.appended(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("limit", [1, 7, 50, 10**6])
def test_blocks_own_each_word_once(limit):
    for text in odd_texts():
        raw = (text or "").encode()
        parts = words.blocks(raw, limit, words.ALPHANUMERIC, 2)
        found = [LOWERED.findall(lower(raw[a:b].decode())) for a, b, _ in parts]
        assert sum((w[:n] for w, (_, _, n) in zip(found, parts, strict=True)), []) == terms(text)
        whole, at = terms(text), 0
        for w, (_, _, n) in zip(found, parts, strict=True):
            assert w == whole[at : at + n + 2]
            at += n


def test_a_word_of_many_megabytes_is_one_word():
    text = b"a " + b"b" * (8 << 20) + b" c"
    assert [n for _, _, n in words.blocks(text, 1 << 16, words.ALPHANUMERIC, 0)] and sum(n for _, _, n in words.blocks(text, 1 << 16, words.ALPHANUMERIC, 0)) == 3
    n, _, _, _ = lexical_search.term_counts(pa.array([text.decode()]), {b"c": 0}, 1 << 16)
    assert n.tolist() == [3]


# --- automata ----------------------------------------------------------------------------------------------------


def repeats_by_brute_force(rows, window):
    cut = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    low = {}
    for i, w in cut:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, (i, k)), (i, k))
    out = []
    for i, w in cut:
        gone = {k + x for k in range(len(w) - window + 1) if i is not None and (i, k) > low[tuple(w[k : k + window])] for x in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def copies(seed, n=60, letters=12, size=70):
    """Texts of few words, edited copies of each other, with repeats inside."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz"[:letters]) * 2 for _ in range(size)] for _ in range(5)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "short one"), (4, " ".join(["same"] * 50)), (5, "same " * 30 + "end"), (None, " ".join(base[0])), (None, None)]
    for i in range(6, n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(["new", "ü", "zz"])
        a = rng.randrange(20)
        out.append((i, rng.choice([" ", "\n", " \t "]).join(w[a:] + (w[:a] if rng.random() < 0.3 else []))))
    return out + [out[10], out[11], (200, out[12][1]), (201, out[12][1]), (8, out[13][1])]


@pytest.mark.parametrize("hot,slice_bytes,shard_words", [(10**9, 4 << 20, 1 << 14), (10**9, 500, 60), (3, 500, 60)])
def test_repeated_word_windows_equal_brute_force(spark, monkeypatch, hot, slice_bytes, shard_words):
    monkeypatch.setattr(automaton_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(automaton_dedup, "SHARD_WORDS", shard_words)
    rows = copies(hot % 7 + shard_words)
    frame = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], DOCS).repartition(3)
    got = automaton_dedup.judged(frame, window=6, gram=3, hot=hot).select("id", "n_words", "n_removed", "sha256")
    assert sorted(map(tuple, got.collect()), key=str) == repeats_by_brute_force(rows, 6)
    assert got.where("n_removed > 0").count() > 20


def test_removed_passages_and_columns(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"at first {passage} here", 1, "g"), (2, f"then\n\n {passage}  and so on", 2, None), (3, "untouched  text\n with blanks", None, "h")]
    out = automaton_dedup.remove_repeats(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "rank", "_g"]
    assert sorted(map(tuple, out.collect())) == [(1, rows[0][1], 1, "g"), (2, "then and so on", 2, None), (3, rows[2][1], None, "h")]
    assert automaton_dedup.judged(spark.createDataFrame([], DOCS)).count() == 0


def test_automata_find_first_places():
    rng = random.Random(3)
    for window in (1, 2, 4):
        for _ in range(40):
            some = lambda n: [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(n)]
            strings, asked = some(6), some(6)
            keys, first, at = [], {}, 0
            for s in strings:
                keys.append([])
                for i in range(len(s)):
                    key = rng.randrange(1000) if i >= window - 1 else automaton_dedup.NEVER
                    keys[-1].append(key)
                    if i >= window - 1:
                        w = tuple(s[i - window + 1 : i + 1])
                        first[w] = min(first.get(w, key), key)
            got = automaton_dedup.matched(*automaton_dedup.Automaton(strings, keys).table(window), asked, window).tolist()
            for s in asked:
                for i in range(len(s) - window + 1):
                    assert got[at] == first.get(tuple(s[i : i + window]), automaton_dedup.NEVER)
                    at += 1


def test_word_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    raw = " ".join(f"w{i}" + "x" * (9000 if i % 97 == 0 else 0) for i in rng.integers(0, 300, 4000)).encode()
    data, sizes, known = np.frombuffer(raw, np.uint8), np.array([3000, len(raw) - 3000]), np.array([True, True])
    one = automaton_dedup.Slice(data, sizes, known, 20, 8, 16)
    monkeypatch.setattr(automaton_dedup, "BLOCK_WORDS", 501)
    monkeypatch.setattr(common, "HASHED", 700)
    many = automaton_dedup.Slice(data, sizes, known, 20, 8, 16)
    assert (one.hashes == many.hashes).all()
    windows = lambda s: sorted((h, w) for h, a, b in zip(s.h.tolist(), s.first.tolist(), s.last.tolist(), strict=True) for w in range(a, b + 1))
    assert windows(one) == windows(many)


# --- lexical search ----------------------------------------------------------------------------------------------


def ranked_by_brute_force(docs, items, k=20):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    n, total = len(cut), sum(c.total() for _, c in cut)
    df = Counter(w for _, c in cut for w in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in cut:
            m = 100 - 25 + (25 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,shard", [(2 << 20, 16 << 20), (30, 800)])
def test_search_equals_brute_force(spark, docs, monkeypatch, block, shard):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard)
    items = [(1, "the quick fox fox"), (2, None), (3, ""), (4, "w17 w18 东西"), (5, "nothing matches"), (6, "DON t known"), (6, "a second text"), (1, "the quick fox fox"), (None, "null id")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], [x for x in items if x[1] is not None], 5)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_equal_bounds_are_opened_for_smaller_ids(spark):
    """400 documents tie; the smallest ids lie in the last ranges."""
    rows = [(1000 - i, "alpha beta", 0, "") for i in range(400)] + [(2000, "gamma", 0, "")]
    got = lexical_search.search(spark.createDataFrame(rows, DOCS).coalesce(1), spark.createDataFrame([(1, "alpha")], "item_id long, text string"))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(601, 621))


def test_the_tree_opens_few_ranges():
    n = 4096
    doc, share = np.arange(n), np.ones(n, dtype=np.int64)
    share[1234] = 1000
    tree = lexical_search.Tree(doc, np.zeros(n, dtype=np.int64), share, n)
    seen = []

    class Watched(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    tree.below = Watched(tree.below)
    best = []
    tree.search(np.array([0]), np.array([7]), doc, best, 1)
    assert best == [(7000, -1234)] and len(tree.maxima) == 128 + 32 + 8 + 2 + 1 and len(seen) == 4


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0
    assert lexical_search.search(docs.where(F.col("doc_id") < 3), items).count() == 0
