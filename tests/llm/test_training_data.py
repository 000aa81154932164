"""The training-data operators against brute force on small fixtures, with the cases that their docstrings define."""

import hashlib
import os
import random
import re
import struct
import sys
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lacuna import llm
from lacuna.llm import chat_format, common, encoding, mixing, near_dedup, packing, quality_rules, sharding, sstable, suffix_dedup, vector_search, warc
from lacuna.llm.common import shared_dir
from lacuna.llm.encoding import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _qrow int"


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(3)
    words = ["".join(random.choices("abcdehilnorst", k=random.randint(2, 7))) for _ in range(300)]
    base = [" ".join(random.choices(words, k=random.randint(3, 90))) for _ in range(30)]
    passage = " ".join(random.choices(words, k=25))
    rows = [None, "", " \n ", base[0], base[0], base[0].upper(), base[1] + " x", base[1], "a", "héllo wörld " * 6, base[2] + "\n" + passage, base[3] + "\n" + passage, "long " * 3000, *base[4:]]
    rows = [(i, t, "en", None if i == 7 else f"s{i % 3}", 0, 1) for i, t in enumerate(rows)] + [(3, base[0], "en", "s0", 0, 1), (None, base[5], "en", "s1", 0, 1)]
    return spark.createDataFrame(rows, DOCS)


def components_by_brute_force(rows, words):
    """(id or -1, size of the set, component's id) of rows (id, text), sorted."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [shingles(t or "") for _, t in rows]
    number = {x: i for i, x in enumerate({x for s in sets for x in s})}
    held = np.zeros((len(rows), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [number[x] for x in s]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    linked = (100 * both >= 80 * (n[:, None] + n[None, :] - both)) & (n[:, None] > 0) & (n[None, :] > 0)
    of = list(range(len(rows)))

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in np.argwhere(linked).tolist():
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    groups = {}
    for i, (id_, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(id_)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted((key((i, len(s), smallest[root(k)] if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))))


def test_near_duplicates_equal_brute_force(docs):
    got = near_dedup.near_duplicates(docs, words=4).collect()
    key = lambda *r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("nodes", [512, 60])
def test_no_link_of_a_large_family_is_lost(spark, monkeypatch, nodes):
    """500 near copies, most pairs a little above or below the limit, null ids among them; also where tiles are small."""
    monkeypatch.setattr(near_dedup, "TILE_NODES", nodes)
    random.seed(6)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(500):
        words = list(base)
        for k in range(random.choice([3, 4, 5, 6])):
            words[random.randrange(len(words))] = f"x{i}-{k}"
        rows.append((None if i % 10 == 3 else 1000 - i, " ".join(words)))
    rows += [(None, "null ids " * 3 + str(i)) for i in range(30)] + [(5, "one id with " + "other texts " * i) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = components_by_brute_force(rows, 4)
    assert len({c for _, _, c in want}) > 20
    key = lambda *r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame, words=4).collect()) == want


def test_near_dedup_stage_keeps_one_row_of_each_component(spark):
    text = lambda k: " ".join(f"t{k}-{i}" for i in range(60))
    rows = [(1, text(0)), (1, text(0)), (2, text(0) + " end"), (1, text(1)), (3, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (4, None), (5, ""), (6, text(3) + " end"), (7, text(4))]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, 9, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tx int, row int")
    out = near_dedup.stage(spark, frame, "")
    assert out.columns == frame.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) == sorted([(1, text(0)), (1, text(1)), (0, text(2)), (6, text(3) + " end"), (4, ""), (5, ""), (7, text(4))])
    assert near_dedup.stage(spark, frame.where("false"), "").count() == 0 and near_dedup.near_duplicates(frame.where("false")).count() == 0


def test_later_links_extend_components(spark):
    random.seed(4)
    edges = [(random.randint(-40, 40), random.randint(-40, 40)) for _ in range(45)] + [(100, 101), (102, 103)]
    first, more = (spark.createDataFrame(x, "a long, b long") for x in (edges[:25], edges[25:]))
    want = {}
    for a, b in edges:
        if a != b:
            both = want.get(a, {a}) | want.get(b, {b})
            want.update(dict.fromkeys(both, both))
    got = near_dedup.extended(near_dedup.components(first), more).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((n, min(c)) for n, c in want.items())


def repeats_by_brute_force(rows):
    """(id or -1, bytes, removed, spans, sha256), sorted, of rows (id, bytes)."""
    first = {}
    for i, b in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for a in range(len(b) - 49):
            first.setdefault(b[a : a + 50], i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for a in range(len(b) - 49) if i is not None else ():
            if first[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i if i is not None else -1, len(b), len(b) - len(left), len(re.findall(b"\1+", gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(docs):
    want = repeats_by_brute_force([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    got = suffix_dedup.judged(docs).collect()
    key = lambda r: str((r.row, r.removed, r.spans, r.sha256))
    assert sorted(map(key, suffix_dedup.judged(docs, few_copies=True).collect())) == sorted(map(key, got))
    assert sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.bytes, r.removed, r.spans, r.sha256) for r in got) == want
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    by = {(r.row.doc_id, r.row.text): r.kept for r in got}
    assert all(hashlib.sha256((r.kept or "").encode()).hexdigest() == r.sha256 for r in got if r.kept is None or r.kept.isascii())
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, [by[r.doc_id, r.text] for r in docs.collect()]))


@pytest.mark.parametrize("hot,slice_bytes", [(10**9, 2 << 20), (10**9, 600), (2, 600)])
def test_edited_copies_equal_brute_force(spark, monkeypatch, hot, slice_bytes):
    """Near copies, a passage in many texts, a common phrase and repeated ids; in one slice or many, by segments or by windows."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "MERGED_BYTES", 3000)
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 8)))
    passage = " ".join(word() for _ in range(30))
    phrase = "a phrase that many of the texts hold"
    rows = []
    for family in range(6):
        base = [word() for _ in range(60)]
        for k in range(12):
            words = list(base)
            for _ in range(random.randint(0, 3)):
                words[random.randrange(60)] = word()
            cut = sorted(random.sample(range(len(passage)), 2))
            rows.append((random.randrange(200), " ".join(words[: random.randint(30, 60)]) + f" {phrase} " + word() + " " + passage[cut[0] : cut[1]]))
    rows += [(300, "ab" * 200), (301, "ab" * 100), (302, "é" * 90), (303, "xé" + "é" * 60), (304, "short"), (305, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.judged(frame, hot_slices=hot).collect()
    assert sorted((r.row.doc_id, r.bytes, r.removed, r.spans, r.sha256) for r in got) == repeats_by_brute_force([(i, t.encode()) for i, t in rows])
    assert sum(r.removed for r in got) > 10000


def test_a_passage_in_very_many_texts(spark):
    passage = "this passage of more than fifty bytes stands in every one of the texts of the table"
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(f" {passage} "), F.md5(F.col("id").cast("string"))).alias("text"), F.lit(1).alias("tx"))
    got = suffix_dedup.judged(rows, hot_slices=2).groupBy("spans").agg(F.count("*"), F.min("removed"), F.max("removed")).collect()
    # Some letters beside the passage stand there in a text before, too.
    (zero, one), n = sorted(map(tuple, got)), len(passage) + 2
    assert zero == (0, 1, 0, 0) and one[:2] == (1, 99_999) and n <= one[2] <= one[3] <= n + 12


def test_merged_transforms_order_all_suffixes():
    random.seed(5)
    parts = [bytes(random.choices(b"ab", k=random.randint(1, 30))) for _ in range(20)]
    symbols, texts = [], []
    for half in (parts[:9], parts[9:]):
        joined = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16) for p in half])
        stop = np.flatnonzero(joined == 0).astype(np.int32)
        before, order = suffix_dedup.transform(joined, stop)
        symbols.append(before)
        whole = b"".join(p + b"\0" for p in half)
        texts += [whole[at:].split(b"\0")[0] for at in order]
    order, common = suffix_dedup.merge(symbols, 12)
    got = [texts[i][:12] for i in order]
    assert got == sorted(got)
    for k in range(1, len(got)):
        shared = next((i for i, (x, y) in enumerate(zip(got[k - 1], got[k])) if x != y), min(len(got[k - 1]), len(got[k])))
        assert common[k] == shared


def spelt(n):
    return "".join(chr(97 + int(c)) for c in str(n))


def test_quality_rules(spark, docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect() if r.doc_id is not None}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[12].n_words == 3000 and got[12].n_repeat_words == 3000
    line = "the same line of words that stands in every document of one host"
    rows = [(i, f"{line}\n{spelt(i)} stands here {spelt(i * 7)}", "en", "h", 0, 1) for i in range(150)] + [(200 + i, " ".join(spelt(1000 * i + k) for k in range(40)) + "\n" + line, "en", "h", 0, 1) for i in range(5)]
    copies = [(300 + i, " ".join(spelt(5000 + k) for k in range(30)), "en", "h", 0, 1) for i in range(150)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows + copies, DOCS)).collect()}
    assert not any(kept[i] for i in range(150)) and all(kept[200 + i] for i in range(5)) and all(kept[300 + i] for i in range(150))
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_a_block_of_shared_lines_is_boilerplate(spark):
    # Letters for numbers: digits are normalised away.
    own = lambda i, k: " ".join("abcdefghij"[int(d)] * 2 for d in f"{i:03}{k}") + (" and some words of its own here", " then another line with more to say")[k]
    block = [" ".join(f"{'abcdefghij'[k]}{w}" for w in ("shared", "line", "of", "the", "template")) for k in range(10)]
    rows = [(i, "\n".join(block + [own(i, k) for k in range(2)]), "en", "s0", 0, 1) for i in range(150)]
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.n_removed_chars for r in got} == {sum(map(len, block))} and not any(r.kept for r in got)
    few = quality_rules.judge(spark.createDataFrame(rows[:100], DOCS)).collect()
    assert {r.n_removed_chars for r in few} == {0} and all(r.kept for r in few)


def test_documents_that_differ_in_numbers_alone_are_distinct(spark):
    """A menu goes from 400 receipts whose own line differs only in digits; 400 copies of one receipt count once."""
    menu = [f"{w} and more words of the menu here" for w in ("home", "about us", "contact")]
    receipts = [(i, "\n".join([*menu, f"receipt number {i} of {i * 31} over {i * 7} coins for the goods that were sold on day {i % 30}"]), "en", "shop", 0, 1) for i in range(400)]
    copies = [(1000 + i, receipts[0][1].replace("receipt", "bill"), "en", "other", 0, 1) for i in range(400)]
    got = quality_rules.judge(spark.createDataFrame(receipts + copies, DOCS)).collect()
    # The own line is one after its numbers are normalised, and goes too.
    assert all(r.n_removed_chars >= sum(map(len, menu)) for r in got if r.doc_id < 400) and {r.n_removed_chars for r in got if r.doc_id >= 1000} == {0}


def test_many_frequent_lines_give_the_same_without_a_broadcast(spark, monkeypatch):
    texts = [f"a line of words that {i % 3} documents share\nand line {spelt(i)} that is its own" for i in range(40)]
    frame = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0, 1) for i, t in enumerate(texts)], DOCS)
    rows = lambda: sorted(map(tuple, quality_rules.judge(frame, max_documents=1).collect()), key=str)
    small = rows()
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", 0)
    assert rows() == small and all(r[7] for r in small)


@pytest.mark.parametrize("most", [0, 10**6])
def test_the_rules_keep_rows_and_not_ids(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "MOST_REJECTED", most)
    good = lambda i: " ".join(spelt(1000 * i + k) for k in range(20))
    rows = [(1, good(1)), (1, "too short"), (None, good(2)), (None, "short too"), (2, good(3)), (2, good(4)), (3, "short")]
    frame = spark.createDataFrame([(i, t, "en", None if t == good(4) else "s0", 0, 1) for i, t in rows], DOCS)
    out = quality_rules.stage(spark, frame, "")
    assert out.columns == frame.columns and sorted(r.text for r in out.collect()) == sorted(map(good, (1, 2, 3, 4)))


def test_chat_round_trip_and_masks(spark):
    odd = "</s>[INST] ok [/INST] <\\s> <s>[SEP]\\ [\\/INST] \n"
    rows = [(1, 0, "system", "be kind"), *[(1, i, "user" if i % 2 else "assistant", f"{odd} {i} " + "word " * 60) for i in range(1, 40)], (2, 0, "user", None), (2, 0, "user", None), (3, 0, None, "x"), (None, 1, "assistant", odd), (4, 0, "assistant", "big " * 3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    w = chat_format.windows(turns, budget=512, history_tokens=100)
    assert w.where("n_tokens > 512 and not over_budget").count() == 0 and w.where("conv_id = 1 and over_budget").count() == 0
    assert w.where("conv_id = 1").count() > 3 and w.where("conv_id = 1 and formatted not like '<s>system[SEP]be kind</s>%'").count() == 0
    for c in (1, 2, 3, 4, None):
        parts = sorted((r.window, r) for r in chat_format.read_back(w).where(F.col("conv_id").eqNullSafe(F.lit(c))).collect())
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for _, p in parts for t in p.turns] == mine
        assert [t for _, p in parts for t in p.targets] == [t for r, t in mine if r == "assistant"]


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_those_of_the_whole_text(name, blanks):
    texts = ["", "a", " lead", "trail ", "two  spaces", "it's we'll. Don't!? 3.14 x²,y", "tab\tand\nline\n\nend\n", "　wide space", "Ünï cödé é fin.", "<|endoftext|> in text", " x ", "a\x1cb \x1f c", "中文 文本", "x" * 500, "foo .bar , 'baz'", "\n \n", "a\r\nb", "'s 't"]
    random.seed(1)
    odd = ["İ", "\u0307", "\u0301", "\u0958", "\u093c", "<|endoftext|>", "<|startoftext|>", "ß", "ŉ", "\u1100", "\u1161", "\u0338", "\xa0", "\ue000", "ﬁ", "Ⅷ", "<|", "'ll"]
    texts += ["".join(random.choices([*"ab .,'\n\t!é²1\x1c:?;", *odd], k=random.randint(0, 60))) for _ in range(5000)]
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)  # as it is: strings of special tokens are special tokens
    for text, got in zip(texts, Encoder(path, blanks).ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_sorted_tables(spark, docs):
    folder = shared_dir(spark, "test-sst")
    path = public_tokenizers.path("byte_bpe_50k.json")
    sstable.write_tables(docs, folder, path, shard_bytes=4000)
    got = sstable.read_tables(spark, folder).orderBy("start").collect()
    assert len(got) == docs.count() and got[0].doc_id is None
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    t = Tokenizer.from_file(path)
    data = [sstable.Shard.of(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).collect()]
    for r in docs.where("doc_id is not null").collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert want in [x.tolist() for s in data for x in s.lookup(r.doc_id)]
    assert not any(s.lookup(987654) for s in data)
    found = sstable.lookup(spark, folder, [3, 20, None, 987654])
    texts = lambda i: sorted(t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect() if r.doc_id == i)
    assert {i: sorted(x.tolist() for x in got) for i, got in found.items()} == {i: texts(i) for i in (3, 20, None, 987654)} and len(found[3]) == 2
    assert sstable.write_tables(docs.where("false"), shared_dir(spark, "test-none"), path).count() == 0


def test_many_rows_of_one_id_fill_several_shards(spark):
    folder, path = shared_dir(spark, "test-roll"), public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(None, f"text {i} " * 40) for i in range(200)] + [(7, f"seven {i} " * 40) for i in range(50)] + [(8, None)], "doc_id long, text string")
    manifest = sstable.write_tables(rows, folder, path, roll_bytes=8000)
    assert manifest.count() > 5 and sstable.read_tables(spark, folder).count() == 251
    found = sstable.lookup(spark, folder, [None, 7, 8])
    assert [len(found[k]) for k in (None, 7, 8)] == [200, 50, 1] and found[8][0].tolist() == [0]


def test_packing(spark, docs):
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64, with_ids=True)
    got = packing.pack(cut, 64).collect()
    assert len(got) == cut.count() and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.15 * total / 64 + 2
    random.seed(2)
    for _ in range(30):
        counts = {n: random.randint(1, 50) for n in random.sample(range(1, 101), 30)}
        steps = packing.plan(counts, 100)
        assert {n: sum(s[2] for s in steps if s[0] == n) for n in counts} == counts


def test_mixing_stays_within_a_block(spark):
    for shares in ([1, 1, 1], [700, 200, 100], [333, 300, 200, 100, 50, 17], [5, *[1] * 40]):
        total, done = sum(shares), [0] * len(shares)
        for t, (i, _, _) in enumerate(mixing.frame(shares)):
            done[i] += 1
            assert all(abs(d * total - (t + 1) * s) < total for d, s in zip(done, shares, strict=True))
    rows = spark.createDataFrame([(i, "x" * 100, "en", "hot" if i % 3 else f"s{i % 4}", 0, 1) for i in range(900)] + [(None, None, "en", None, 0, 1)], DOCS)
    got = mixing.mix(rows, block_bytes=1000).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in rows.collect()}
    assert mixing.stage(spark, rows, "").columns == rows.columns
    assert mixing.mix(rows.where("false")).count() == 0


@pytest.mark.parametrize("weights", [{"big": 0.5, **{f"s{i}": 0.5 / 64 for i in range(64)}}, {"big": 0.999, "s0": 0.001}, {"big": 0.33, "s0": 0.34, "s1": 0.33}, None])
def test_mixing_follows_the_target_weights(spark, weights):
    # Every document is a block, so each slot holds one row.
    rows = [(i, "x" * 10, "big") for i in range(700)] + [(1000 * (k + 1) + i, "x" * 10, f"s{k}") for k in range(len(weights or "1234") - 1) for i in range(1 + k % 3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, block_bytes=10).collect()
    got.sort(key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) and {r.doc_id for r in got} == {i for i, _, _ in rows}
    sizes = {s: sum(10 for _, _, x in rows if x == s) for _, _, s in rows}
    target = weights or {s: n**mixing.ALPHA for s, n in sizes.items()}
    total, done = sum(target.values()), dict.fromkeys(target, 0)
    for t, r in enumerate(got):
        done[r.source] += 1
        assert all(abs(done[s] - (t + 1) * w / total) < 1 + 1e-9 for s, w in target.items())


def mixed_by_brute_force(rows, weights, block_bytes):
    """(id, source, epoch, block, slot, place) by a schedule of its own: at each slot the released block with the earliest deadline."""
    sources = {}
    for i, text, source in rows:
        h = 42 if i is None else xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        h -= (h >> 63) << 64
        sources.setdefault(source, []).append((((h % 2**64) >> 1), h, i is not None, i or 0, len((text or "").encode()), i))
    names = sorted((s for s in sources if weights.get(s, 0) > 0), key=lambda s: (s is not None, str(s)))
    share = [Fraction(str(weights[s])) / sum(Fraction(str(weights[n])) for n in names) for s in names]
    size = [sum(r[4] for r in sources[s]) for s in names]
    whole = max(-(-n // w) for n, w in zip(size, share, strict=True))
    block_bytes = max(block_bytes, -(-whole // 2**20))
    blocks = [max(1, -(-n // block_bytes)) for n in size]
    held = [{} for _ in names]
    for k, s in enumerate(names):
        at = 0
        for r in sorted(sources[s]):
            held[k].setdefault(min(at // block_bytes, blocks[k] - 1), []).append((r[5], at))
            at += r[4]
    turn, out, slot = [0] * len(names), [], 0
    while any(t < b for t, b in zip(turn, blocks, strict=True)):
        ready = [(-(-(turn[k] + 1) // w), k) for k, w in enumerate(share) if turn[k] // w <= slot]
        deadline, k = min(ready)
        assert slot < deadline
        epoch, block = divmod(turn[k], blocks[k])
        out += [(i, names[k], epoch, block, slot, at) for i, at in held[k].get(block, ())]
        turn[k] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, None: 0.2}, {"a": 0.05, "b": 0.95}, {"a": 1, "b": 1, None: 7, "none such": 3}])
def test_mixing_equals_a_schedule_by_brute_force(spark, weights):
    random.seed(4)
    rows = [(i if i % 50 else None, "x" * random.randrange(200), random.choice(["a", "a", "b", None])) for i in range(1, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, weights, block_bytes=500).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(mixed_by_brute_force(rows, weights, 500), key=str)


def test_a_large_mixture_has_no_more_slots_than_any(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x" * 1000, "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(rows, {"a": 0.7, "b": 0.3}, block_bytes=10, most_slots=64)
    assert 60 <= got.agg(F.max("slot")).head()[0] <= 70 and got.select("doc_id").distinct().count() == 2000


def test_windows_by_the_callers_token_counts(spark):
    rows = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"turn {t}", 100 if t else None) for t in range(8)], "conv_id long, turn int, role string, text string, n int")
    few, many = (chat_format.windows(rows, budget=b, history_tokens=16, tokens_col="n").count() for b in (250, 2000))
    assert few > many == 1


def test_rows_of_one_id_fill_several_ranges(spark):
    """A third of all rows has one id, and a third none: running sums go on from range to range."""
    rows = spark.createDataFrame([(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}") for i in range(600)], "doc_id long, text string")
    sized = sharding.shard_documents(rows.repartition(5)).orderBy("shard", "slot").collect()
    assert [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in sized] == sorted((i is not None, i or 0, len(t) + 8, zlib.crc32(t.encode())) for i, t in rows.collect())
    out = common.running(rows.select(F.col("doc_id"), F.lit(1).cast("long").alias("n"), F.xxhash64("text").alias("h")), [F.col("doc_id"), F.col("h")], "n", 9)
    assert sorted(r._place for r in out.collect()) == sorted(r._sum for r in out.collect()) == list(range(600))


def test_sharding(spark, docs):
    got = sharding.shard_documents(docs, 5).orderBy("shard", "slot").collect()
    assert len(got) == docs.count()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    for s in range(5):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(docs.where("false"), 5).count() == 0


def test_archives(spark):
    pages = [(1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 5000), (None, "http://n", "<p>one</p>"), (-7, "http://m", "<p>two</p>"), (1, "http://a2", "<p>one</p>")]
    folder = shared_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, roll_bytes=300, task_bytes=600)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert sorted(by[1]) == [("response", None, 10), ("revisit", 1, 10)] and by[2] == [("revisit", 1, 10)] and by[3] == [("response", None, 0)] and by[4] == [("revisit", 3, 0)]
    names = [heads["WARC-Record-ID"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect() for heads, _ in warc.records(r.content)]
    assert len(set(names)) == len(pages)
    assert by[None] == [("response", None, 10)] and by[-7] == [("response", None, 10)] and by[5] == [("response", None, 10000)]


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[10:14] = x[9]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0]), (None, [1.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.search(v, v.where("vec_id % 20 = 0")).collect()
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -2
        hit += len(set(np.lexsort((np.arange(600), -s))[:5]) & {r.vec_id for r in got if r.query_id == q})
    assert hit >= 0.9 * 150 and len(got) == 150
    assert vector_search.search(v.where("false"), v).count() == 0


def test_vector_search_gives_k_to_each_of_repeated_queries(spark):
    x = np.random.default_rng(6).normal(size=(300, 4)).tolist()
    rows = [*enumerate(x), (100, x[100]), (200, x[7]), *[(7, x[7])] * 300]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_key", F.lit("mine"))
    got = vector_search.search(v, v.where("vec_id in (7, 100, 200)")).collect()
    held = {}
    for r in got:
        held.setdefault((r.query_id, r.query_key), []).append(r)
    assert sorted(q for q, _ in held) == [7, 100, 200, 200]  # equal rows are one query
    for (q, _), mine in held.items():
        assert sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in mine)
    copies = [m for (q, _), m in held.items() if q == 200 and all(r.vec_id == 7 for r in m)]
    assert len(copies) == 1 and all(abs(r.score - 1) < 1e-12 for r in copies[0])


def test_tree_opens_leaves_until_they_hold_enough():
    x = vector_search.unit(np.random.default_rng(8).normal(size=(2000, 6)))
    tree = vector_search.Tree(x)
    sizes = {leaf: 1 for leaf in range(0, tree.leaves, 3)}  # the others are empty
    assert len(tree.leaves_near(x[0], 2)) == 2
    near = tree.leaves_near(x[0], 2, sizes, 6)
    assert sum(sizes.get(leaf, 0) for leaf in near) == 6
    assert len(tree.leaves_near(x[0], 1, sizes, 10**6)) == tree.leaves


def test_pipeline_stages_keep_their_columns(spark, docs):
    import corpus_pipeline

    rows = docs.drop("_qrow").withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    last = corpus_pipeline.STAGES[-1][1](spark, rows, "")
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in rows.select("doc_id").distinct().collect()}


FOLDER = "/root/testdata/sf0.001"


def test_a_second_run_of_the_pipeline_leaves_the_first_result_readable(spark):
    import corpus_pipeline

    first = corpus_pipeline.run(spark, FOLDER)
    rows = first.count()
    second = corpus_pipeline.run(spark, FOLDER)
    common.sweep(spark)
    assert first.count() == rows == second.count()


def test_tables_go_when_nothing_reads_them(spark):
    held = common.materialize(spark.range(10), "held")
    derived = common.materialize(spark.range(20), "derived").where("id > 4")
    lost = common.materialize(spark.range(30), "lost").inputFiles()[0]
    for _ in range(5):
        common.sweep(spark)
    assert held.count() == 10 and derived.count() == 15
    assert not os.path.exists(lost.removeprefix("file://")) and os.path.exists(held.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = llm.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r) for r in c.sql(f"select {', '.join(columns)} from ({llm.ORACLES[name]})").fetchall()), key=key)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == want


def documents():
    return sorted(duckdb.sql(f"select doc_id, coalesce(text, '') from '{FOLDER}/documents.parquet'").fetchall())


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_words_that_are_not_remembered_are_encoded_once_for_many_texts(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 0)
    enc, learned = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False), []
    monkeypatch.setattr(enc, "_learn", lambda words, of=enc._learn: learned.append(len(words)) or of(words))
    texts = [f"zwölf Boxkämpfer, jagen\nViktor {i % 3}" for i in range(400)]
    got = list(enc.ids(texts))
    assert learned == [6] and got == [np.array(enc.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_remembered_words_cost_no_step_of_python_each(name, blanks, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 301)  # the words below: no room for later ones
    enc, words = Encoder(public_tokenizers.path(name), blanks), [f"Wörd{i}" for i in range(300)]
    texts = [" ".join([*words, f"neu{i}"]) for i in range(100)]
    list(enc.ids([" ".join(["a", *words])]))
    steps, asked = [], []
    sent = enc._encode
    enc._encode = lambda some: asked.extend(some) or sent(some)
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    try:
        got = list(enc.ids(texts))
    finally:
        sys.setprofile(None)
    assert len(steps) < 300 * 100 / 4
    assert got == [np.array(enc.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    asked.clear()
    signs = [" ".join(["a", *(w + sign for w in words)]) for sign in ('"', "&&&", "/", ")")]
    assert list(enc.ids(signs)) == [np.array(enc.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in signs]
    assert not any("rd" in x for x in asked)  # a known word goes not through the library again for the sign after it


def test_words_are_told_apart_by_all_their_bytes(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 40)
    monkeypatch.setattr(encoding, "STEP", 7)
    monkeypatch.setattr(encoding.Memory, "_slots", lambda self, keys: np.full(len(keys), len(self.slots) - 2))  # all ask for one place
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    words = [*("x" * n for n in range(1, 70)), *("é" * n for n in range(1, 40)), *("y" * n + "z" for n in range(25, 35)), "a\0", "a", "a\0\0", "\0"]
    for texts in (words, [" ".join(words), None, "", " ", " ".join(reversed(words))], words):
        want = [np.array(enc.tokenizer.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
        assert list(enc.ids(texts)) == want
        assert list(enc.ids(pa.array(["not", *texts, "these"]).slice(1, len(texts)))) == want
    assert enc.words.size == enc.pieces.size == 41  # with place 0


def test_op3_query_equals_the_library(spark):
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in documents():
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in llm.QUERIES["op3_sorted_tables"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(capacity - n)
        else:
            bins[at] -= n
    return len(bins)


def test_op4_query_equals_the_library_and_packs_well(spark):
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in documents():
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    got = llm.QUERIES["op4_best_fit_packing"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= first_fit_decreasing([r.length for r in got], 2048) + 1


def test_op7_query_scores_are_exact_and_most_are_the_nearest(spark):
    rows = sorted(duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet'").fetchall())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got, hit, all_ = llm.QUERIES["op7_kmeans_tree_search"](spark, FOLDER).collect(), 0, 0
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, min(5, len(ids) - 1) + 1))
        assert all(abs(score[ids == r.vec_id][0] - r.score) < 1e-12 for r in mine) and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        near = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hit, all_ = hit + len(near & {r.vec_id for r in mine}), all_ + len(near)
    assert hit >= 0.9 * all_


def test_op5_query_follows_the_byte_shares(spark):
    got = llm.QUERIES["op5_mix_sources"](spark, FOLDER).orderBy("slot", "place").collect()
    rows = duckdb.sql(f"select doc_id, source, octet_length(encode(coalesce(text, ''))) from '{FOLDER}/documents.parquet'").fetchall()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    weight = {s: n**mixing.ALPHA for s, n in sizes.items()}
    total, done = sum(weight.values()), dict.fromkeys(weight, 0)
    blocks = sorted({(r.slot, r.source, r.epoch, r.block) for r in got}, key=lambda b: b[0])
    assert len({b[0] for b in blocks}) == len(blocks)
    for slot, source, *_ in blocks:
        done[source] += 1
        # A block without a row's beginning leaves its slot empty.
        assert done[source] <= (slot + 1) * weight[source] / total + 1


def test_long_texts_are_hashed_block_by_block(monkeypatch):
    rng = np.random.default_rng(1)
    raw = " ".join(map(str, rng.integers(0, 500, 20_000))).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 30_000, len(raw)])
    texts = pa.array([raw[:30_000].decode(), raw[30_000:].decode()])
    sets, whole = near_dedup.shingle_sets(texts, 4), suffix_dedup.anchors(data, offsets, 50, 20)
    monkeypatch.setattr(common, "HASHED", 3000)
    assert all((a == b).all() for a, b in zip(sets, near_dedup.shingle_sets(texts, 4), strict=True))
    cut = suffix_dedup.anchors(data, offsets, 50, 20)
    windows = lambda x: sorted((int(d), int(h), w) for d, h, a, b in zip(*x, strict=True) for w in range(a, b + 1))
    assert windows(whole) == windows(cut) and len(cut[0]) > len(whole[0])


def test_a_text_of_50_mb_takes_bounded_memory():
    import tracemalloc

    from lacuna.llm import automaton_dedup

    raw = (b"some words of a very long text %d " * 4 % (1, 2, 3, 4) + b"and more " * 40) * (50 * 2**20 // 500)
    data = np.frombuffer(raw, np.uint8)
    for f in (lambda: near_dedup.shingle_sets(pa.array([raw.decode()]), 4), lambda: suffix_dedup.anchors(data, np.array([0, len(data)]), 50, 20), lambda: automaton_dedup.Slice(data, np.array([len(data)]), np.array([True]), 20, 8, 16)):
        tracemalloc.start()
        f()
        assert tracemalloc.get_traced_memory()[1] < 18 * len(data)
        tracemalloc.stop()
