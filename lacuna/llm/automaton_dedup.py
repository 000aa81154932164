"""Repeated word sequences across and within documents, by suffix automata of reference shards.

A word goes if some ``window`` consecutive words that cover it also start earlier: in a document with a smaller id, or
before in the same one. Sequences are judged on the input; they never cross documents.

1. Texts that are equal as a whole are made one. Of these all but the one with the smallest id go as a whole.
2. Every document would have to stream through the automaton of every shard; only text that can match is sent. Of the
   hashes of the ``gram``-word runs in a window the smallest is its anchor: equal windows have the same anchor at the
   same place. Each slice of documents sends each of its anchors once; what stands in one place alone is dropped, and
   with it all windows that cannot repeat. A false agreement of hashes costs work only.
3. The windows of an anchor form a segment of less than ``2 * window`` words. A slice sends each of its segments once,
   with its first place, to the segment's bucket. Segments that are equal by their bytes are one there.
4. Of anchors with several segments, runs of windows that stand in two of them form strings, grouped in lots of whole
   anchors. A lot's strings are cut into reference shards by document, and each shard's suffix automaton is built in a
   task of its own. It knows for each of its states where the state's sequences stand first.
5. The automata of a lot are joined with all of the lot's strings, and the strings stream through them for their
   matching statistics: where the longest match is ``window`` words or more, the state that holds the window tells its
   first place in the shard. The first one among all shards decides.
6. Slices get for their segments the windows that stand earlier elsewhere, and remove the maximal spans these cover.

An anchor that stands in ``HOT`` places or more is dealt by whole windows: each distinct window of it is one row of a
slice, reduced by a partial aggregate, so that none outgrows its bucket.

Defined cases: null text has no words. Rows with a null id stay whole and count for nothing. Rows with one id are one
document: of sequences at the same start in them none is earlier. Texts shorter than a window stay whole. Very long
texts are a slice each, and are hashed in blocks. Empty tables give empty results. Other columns are carried along by
:func:`remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHashes, flat_bytes, hashes_of, materialize, n_buckets, slices, table
from .suffix_dedup import anchors_of, binaries, columns_of, distinct, packed, runs, spread, unpacked
from .words import NO_BLANK, numbered, spans

WINDOW, GRAM = 20, 8
#: Bytes of text for a slice and for a bucket; places from which on an anchor is dealt by windows.
SLICE_BYTES, BUCKET_BYTES, HOT = 4 << 20, 8 << 20, 4096
#: Words of strings in a lot, about, and in a reference shard; words whose anchors are looked for at once.
LOT_WORDS, SHARD_WORDS, BLOCK_WORDS = 1 << 16, 1 << 14, 1 << 19
#: Words of more bytes are hashed by themselves.
LONG_WORD = 1 << 12
NEVER = np.iinfo(np.int64).max
L, B = pa.int64(), pa.binary()


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    long_ = np.flatnonzero(end - start > LONG_WORD)
    out, cuts = [], [-1, *long_.tolist(), len(start)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # the words between two long ones, and the one that ends them
        if b > a + 1:
            base = int(start[a + 1])
            out.append(hashes_of(data[base : int(end[b - 1])], start[a + 1 : b] - base, end[a + 1 : b] - base))
        if b < len(start):
            out.append(np.frombuffer(hashlib.blake2b(data[start[b] : end[b]].tobytes(), digest_size=8).digest(), "<u8"))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_anchors(words: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first window, last window) of runs of windows with one anchor, block by block."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(words), BLOCK_WORDS):
        to = min(len(words), at + BLOCK_WORDS + window - 1)
        if to - at >= window:
            value = SpanHashes.over(words[at:to]).grams(gram)[: to - at - gram + 1]
            doc, h, first, last = anchors_of(value, np.clip(offsets, at, to) - at, window, gram)
            parts.append((doc.astype(np.int64), h, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- suffix automata ---------------------------------------------------------------------------------------------


class Automaton:
    """The suffix automaton of several strings of numbers, with the least key of the positions at which a state's strings end."""

    def __init__(self, strings: list[list[int]], keys: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NEVER]
        for symbols, of in zip(strings, keys, strict=True):
            state = 0
            for symbol, key in zip(symbols, of, strict=True):
                state = self.extended(state, symbol, key)

    def state(self, length: int, link: int, after: dict[int, int], key: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.least.append(key)
        return len(self.next) - 1

    def split(self, p: int, symbol: int, key: int) -> int:
        """A state for the shorter strings of the one behind ``symbol``: those that ``p`` leads to."""
        q = self.next[p][symbol]
        clone = self.state(self.length[p] + 1, self.link[q], self.next[q].copy(), key)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def extended(self, last: int, symbol: int, key: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # another string has it
            if self.length[q] != self.length[last] + 1:
                return self.split(last, symbol, key)
            self.least[q] = min(self.least[q], key)
            return q
        new = self.state(self.length[last] + 1, 0, {}, key)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, symbol, NEVER)
        return new

    def table(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(steps: state, symbol, next state), link and length of each state, and the least key of the window a state's longest string ends with."""
        link, length, least = np.array(self.link), np.array(self.length), np.array(self.least)
        for n in np.unique(length)[:0:-1]:
            some = np.flatnonzero(length == n)
            np.minimum.at(least, link[some], least[some])
        holder = np.arange(len(link))  # the state on the way to the root that holds the window
        for n in np.unique(length):
            some = np.flatnonzero(length == n)
            up = link[some]
            holder[some] = np.where((up >= 0) & (length[up] >= window), holder[up], some)
        least = np.where(length >= window, least[holder], NEVER)
        steps = np.array([(s, c, t) for s, after in enumerate(self.next) for c, t in after.items()], dtype=np.int32).reshape(-1, 3)
        return steps, link.astype(np.int32), length.astype(np.int32), least


def matched(steps: np.ndarray, link: np.ndarray, length: np.ndarray, least: np.ndarray, strings: list[list[int]], window: int) -> np.ndarray:
    """For each window of the strings its least key in the automaton, by their matching statistics; NEVER where it does not occur."""
    go = dict(zip(((steps[:, 0].astype(np.int64) << 32) | steps[:, 1]).tolist(), steps[:, 2].tolist(), strict=True))
    link, length, least = link.tolist(), length.tolist(), least.tolist()
    out = []
    for symbols in strings:
        state, n = 0, 0
        for i, symbol in enumerate(symbols):
            to = go.get(state << 32 | symbol)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = go.get(state << 32 | symbol)
            if to is not None:
                state, n = to, n + 1
            if i >= window - 1:
                out.append(least[state] if n >= window else NEVER)
    return np.array(out, dtype=np.int64)


# --- the segments of a bucket ------------------------------------------------------------------------------------


def first_of(group: np.ndarray, n: int, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least (document, start) of each of ``n`` groups."""
    order = np.lexsort((start, doc, group))
    low = order[np.searchsorted(group[order], np.arange(n))] if len(order) else order
    return doc[low], start[low]


class Bucket:
    """The distinct segments that slices sent to a bucket, and the strings among them that automata have to match.

    ``rows``: slice, n, of (words, bytes, half of the anchor's hash, first document and start of each of n segments), bytes. The same
    rows give the same numbers.
    """

    def __init__(self, rows: pd.DataFrame, window: int):
        rows = rows.sort_values("slice")
        self.slices, self.many = rows["slice"].to_numpy(), rows["n"].to_numpy()
        sizes, h, docs, starts = zip(*(columns_of(x, n, "IIqq") for x, n in zip(rows["of"], self.many.tolist(), strict=True)), strict=True)
        parts = []
        for n, raw in zip(sizes, rows["bytes"], strict=True):
            text, at = unpacked(raw, int(n.astype(np.int64).sum())), 0
            for k in n.tolist():
                parts.append(text[at : at + k])
                at += k
        self.of, segments = distinct(parts)
        self.docs, self.starts, h = np.concatenate(docs), np.concatenate(starts), np.concatenate(h)
        self.low = first_of(self.of, len(segments), self.docs, self.starts)
        anchor = np.zeros(len(segments), dtype=np.uint32)
        anchor[self.of] = h
        data = np.frombuffer(b"".join(segments), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in segments])]).astype(np.int64)
        begin, end, of = spans(data, offsets, NO_BLANK)
        words = np.bincount(of, minlength=len(segments))
        self.windows = words - window + 1
        self.base = np.cumsum(self.windows) - self.windows
        # Of anchors with several segments: runs of windows that stand in two of them.
        order = np.argsort(anchor, kind="stable")
        _, count = runs(anchor[order])
        some = order[np.repeat(count > 1, count)]
        first = (np.cumsum(words) - words)[some]
        at, row = spread(first, self.windows[some]), np.repeat(np.arange(len(some)), self.windows[some])
        value = SpanHashes.over(word_hashes(data, begin, end)).of(at, at + window) if len(at) else at.astype(np.uint64)
        by = np.argsort(value, kind="stable")
        _, count = runs(value[by])
        twice = np.zeros(len(value), dtype=bool)
        twice[by] = np.repeat(count > 1, count)
        hit = np.flatnonzero(twice)
        new = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1]))) if len(hit) else hit
        length = np.diff(np.append(new, len(hit)))
        place = at[hit[new]]
        self.segment = some[row[hit[new]]]  # of each run, with its first window
        inside = place - first[row[hit[new]]]
        self.first = self.base[self.segment] + inside
        number, _ = numbered(data, begin, end)
        number = number.astype(np.int32)
        self.string, raw = distinct([number[a:b].tobytes() for a, b in zip(place.tolist(), (place + length - 1 + window).tolist(), strict=True)])
        self.strings = [np.frombuffer(x, np.int32) for x in raw]
        self.string_low = first_of(self.string, len(raw), self.low[0][self.segment], self.low[1][self.segment] + inside)
        self.string_anchor = np.zeros(len(raw), dtype=np.uint32)
        self.string_anchor[self.string] = anchor[self.segment]
        self.string_windows = np.array([len(x) for x in self.strings], dtype=np.int64) - window + 1
        self.window = window

    def shards(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(lot, shard, strings): the strings of anchors that have several, in order of their first places."""
        order = np.lexsort((self.string_low[1], self.string_low[0], self.string_anchor))
        first, count = runs(self.string_anchor[order])
        weight = np.add.reduceat(self.string_windows[order] + self.window - 1, first) * (count > 1) if len(first) else first
        lot = np.repeat((np.cumsum(weight) - weight) // LOT_WORDS, count)[np.repeat(count > 1, count)]
        mine = order[np.repeat(count > 1, count)]
        for k in np.unique(lot).tolist():
            some = mine[lot == k]
            some = some[np.lexsort((self.string_low[1][some], self.string_low[0][some]))]
            size = self.string_windows[some] + self.window - 1
            shard = (np.cumsum(size) - size) // SHARD_WORDS
            for n in np.unique(shard).tolist():
                yield k, n, some[shard == n]

    def least(self, merged: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The first (document, start of the segment there) of each window of each segment."""
        start = np.cumsum(self.string_windows) - self.string_windows
        doc, place = (np.repeat(x, self.string_windows) for x in self.string_low)
        place = place + spread(np.zeros(len(start), np.int64), self.string_windows)
        for strings, docs, places in zip(merged["strings"], merged["docs"], merged["places"], strict=True):
            strings = np.frombuffer(strings, np.int64)
            at = spread(start[strings], self.string_windows[strings])
            docs, places = np.frombuffer(docs, np.int64), np.frombuffer(places, np.int64)
            less = (docs < doc[at]) | ((docs == doc[at]) & (places < place[at]))
            doc[at[less]], place[at[less]] = docs[less], places[less]
        out = [np.repeat(x, self.windows) for x in self.low]
        inside = spread(np.zeros(len(self.windows), np.int64), self.windows)
        many = self.string_windows[self.string]
        to, of = spread(self.first, many), spread(start[self.string], many)
        out[0][to], out[1][to] = doc[of], place[of] - inside[to]
        return out[0], out[1]


# --- slices ---------------------------------------------------------------------------------------------------------


class Slice:
    """A slice's words and anchors and, once those that stand elsewhere too are known, its segments."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, known: np.ndarray, window: int, gram: int, buckets: int):
        self.data, self.window, self.buckets = data, window, buckets
        self.start, self.end, of = spans(data, np.concatenate([[0], np.cumsum(sizes)]), NO_BLANK)
        self.words = np.bincount(of, minlength=len(sizes))
        self.offsets = np.concatenate([[0], np.cumsum(self.words)])
        self.hashes = word_hashes(data, self.start, self.end)
        doc, h, first, last = word_anchors(self.hashes, self.offsets, window, gram)
        mine = known[doc]  # a document without an id takes no part
        self.doc, self.h, self.first, self.last = doc[mine], h[mine], first[mine], last[mine]
        key = (self.bucket(self.h).astype(np.uint64) << np.uint64(32)) | (self.h & np.uint64(0xFFFFFFFF))
        self.keys, self.number, self.times = np.unique(key, return_inverse=True, return_counts=True)
        self.of_bucket = (self.keys >> np.uint64(32)).astype(np.int64)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def occurrences(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first word, words, h, hot) of each segment; ``shared`` and ``hot``: of each of ``keys``."""
        shared, hot = shared[self.number], hot[self.number]
        some, each = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        many = self.last[each] - self.first[each] + 1
        at = spread(self.first[each], many)
        size = np.concatenate([self.last[some] - self.first[some] + self.window, np.full(len(at), self.window)])
        return np.concatenate([self.doc[some], np.repeat(self.doc[each], many)]), np.concatenate([self.first[some], at]), size, np.concatenate([self.h[some], np.repeat(self.h[each], many)]), np.repeat([False, True], [len(some), len(at)])


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of each text with one space between two: (all bytes, bytes and words of each text)."""
    start, end, of = spans(data, offsets, NO_BLANK)
    n = len(offsets) - 1
    words = np.bincount(of, minlength=n)
    inner = np.flatnonzero(of[1:] == of[:-1]) if len(of) else of
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[start] += 1
    step[end] -= 1  # no word ends where another begins but at a cut, which sums to 0
    keep = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    keep[end[inner]] = True
    data = data.copy()
    data[end[inner]] = 0x20
    sizes = np.bincount(of, weights=end - start, minlength=n).astype(np.int64) + np.maximum(words - 1, 0)
    return data[keep].tobytes(), sizes, words


def repeats(texts: DataFrame, total: int, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """For ``texts`` (tx of 32 bytes, id, text), of ``total`` bytes or less: (tx, words, sha256) of each, and (tx, removed, sha256, kept) of those that lose words."""
    buckets = n_buckets(total, BUCKET_BYTES, 16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "text", SLICE_BYTES):
                raw, sizes, words = canonical(*flat_bytes(part.column("text")))
                ids = part.column("id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                shas = b"".join(hashlib.sha256(raw[a:b]).digest() for a, b in zip(cut[:-1], cut[1:], strict=True))
                about = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), known.tobytes(), b"".join(part.column("tx").to_pylist()), sizes.tobytes(), words.astype(np.int64).tobytes(), shas]
                yield binaries([(uuid.uuid4().int >> 65, len(part), *about, packed(raw))], [("slice", L), ("n", L), *((k, B) for k in ("ids", "known", "tx", "sizes", "words", "shas", "data"))])

    # Written once, so that a slice's number stands for the same texts from here on.
    cut = materialize(texts.select("id", "tx", "text").mapInArrow(deal, "slice long, n long, ids binary, known binary, tx binary, sizes binary, words binary, shas binary, data binary"), "word-slices")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tx, shas = batch.column("tx")[i].as_py(), batch.column("shas")[i].as_py()
                n = batch.column("n")[i].as_py()
                part = lambda x: pa.array([x[32 * k : 32 * k + 32] for k in range(n)], B)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part(tx), pa.array(np.frombuffer(batch.column("words")[i].as_py(), np.int64)), part(shas)], names=["tx", "words", "sha"])

    def opened(batch: pa.RecordBatch, i: int) -> Slice:
        sizes, known = np.frombuffer(batch.column("sizes")[i].as_py(), np.int64), np.frombuffer(batch.column("known")[i].as_py(), bool)
        return Slice(np.frombuffer(unpacked(batch.column("data")[i].as_py(), int(sizes.sum())), np.uint8), sizes, known, window, gram, buckets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                s = opened(batch, i)
                h, times = s.keys.astype(np.uint32), np.minimum(s.times, 0xFFFF).astype(np.uint16)
                at = np.searchsorted(s.of_bucket, np.arange(buckets + 1)).tolist()
                rows = [(b, number, h[x:y].tobytes(), times[x:y].tobytes()) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
                yield binaries(rows, [("bucket", L), ("slice", L), ("h", B), ("times", B)])

    def share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["h"]])
        times = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["times"]])
        _, of = np.unique(h, return_inverse=True)
        all_ = np.bincount(of, weights=times)[of]
        flags = (all_ > 1).astype(np.uint8) + 2 * (all_ >= hot).astype(np.uint8)
        ends = np.cumsum([len(x) // 2 for x in rows["times"]])
        return pd.DataFrame({"slice": rows["slice"], "bucket": key[0], "flags": [packed(x.tobytes()) for x in np.split(flags, ends[:-1])], "n": np.diff(ends, prepend=0)})

    found = cut.select("slice", "sizes", "known", "data").mapInArrow(find, "bucket long, slice long, h binary, times binary").groupBy("bucket").applyInPandas(share, "slice long, bucket long, flags binary, n long")
    hits = found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "flags", "n")).alias("hits"))  # as many as the slice has anchors

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the slice's distinct segments; under -1 the texts that have any, and where they lie; under -2 windows of hot anchors."""
        schema = [("bucket", L), ("slice", L), ("n", L), ("of", B), ("bytes", B), ("tx", B), ("places", B), ("n_places", L), ("base", B)]
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                s = opened(batch, i)
                ids, tx = np.frombuffer(batch.column("ids")[i].as_py(), np.int64), batch.column("tx")[i].as_py()
                flags = np.zeros(len(s.keys), dtype=np.uint8)
                for hit in batch.column("hits")[i].as_py():
                    at = np.searchsorted(s.of_bucket, hit["bucket"])
                    flags[at : at + hit["n"]] = np.frombuffer(unpacked(hit["flags"], hit["n"]), np.uint8)
                doc, start, size, h, is_hot = s.occurrences((flags & 1).astype(bool), flags > 1)
                if not len(doc):
                    continue
                by = np.lexsort((start, np.where(is_hot, buckets, s.bucket(h))))
                doc, start, size, h, is_hot = doc[by], start[by], size[by], h[by], is_hot[by]
                raw = s.data.tobytes()
                # A hot window and a segment of the same words are kept apart.
                of, parts = distinct([(hot_, raw[a:b]) for hot_, a, b in zip(is_hot.tolist(), s.start[start].tolist(), s.end[start + size - 1].tolist(), strict=True)])
                low_doc, low_start = first_of(of, len(parts), ids[doc], start - s.offsets[doc])
                key, hot_part = np.zeros(len(parts), dtype=np.uint64), np.zeros(len(parts), dtype=bool)
                key[of], hot_part[of] = h, is_hot
                bucket = np.where(hot_part, -2, s.bucket(key))  # buckets ascend with numbers, and hot windows come last
                first, many = runs(bucket)
                rows = []
                for a, n in zip(first.tolist(), many.tolist(), strict=True):
                    some, lows = slice(a, a + n), low_doc[a : a + n].tobytes() + low_start[a : a + n].tobytes()
                    if bucket[a] == -2:
                        rows.append((-2, number, n, packed(lows), b"".join(hashlib.blake2b(x, digest_size=16).digest() for _, x in parts[some]), None, None, a, None))
                    else:
                        sizes = np.array([len(x) for _, x in parts[some]], dtype=np.uint32)
                        rows.append((int(bucket[a]), number, n, packed(sizes.tobytes() + key[some].astype(np.uint32).tobytes() + lows), packed(b"".join(x for _, x in parts[some])), None, None, 0, None))
                held, doc = np.unique(doc, return_inverse=True)
                begin, end = s.start[s.offsets[held]], s.end[s.offsets[held + 1] - 1]
                new = np.concatenate([[0], np.cumsum(s.words[held])])  # words of the texts that are held
                start = start - s.offsets[held][doc] + new[doc]
                by = np.argsort(start, kind="stable")
                low = np.lexsort((start - new[doc], ids[held][doc], of))
                is_low = np.zeros(len(of), dtype=bool)
                at, _ = runs(of[low])
                is_low[low[at]] = True
                # Repeats of the first place, as in rows of one id, are no earlier than it.
                is_low |= (ids[held][doc] == low_doc[of]) & (start - new[doc] == low_start[of])
                where = packed(np.diff(start[by], prepend=0).astype(np.int32).tobytes() + size[by].astype(np.int32).tobytes() + of[by].astype(np.int32).tobytes() + is_low[by].tobytes())
                about = packed((end - begin).astype(np.int64).tobytes() + s.words[held].astype(np.int64).tobytes())
                texts_ = packed(b"".join(raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)))
                base = np.stack([bucket[first], first], axis=1).astype(np.int64).tobytes()
                rows.append((-1, number, len(held), about, texts_, b"".join(tx[32 * k : 32 * k + 32] for k in held.tolist()), where, len(by), base))
                yield binaries(rows, schema)

    rows = cut.join(hits, "slice").select("slice", "sizes", "known", "data", "ids", "tx", "hits")
    rows = materialize(rows.mapInArrow(segments, "bucket long, slice long, n long, of binary, bytes binary, tx binary, places binary, n_places long, base binary"), "word-segments")
    dealt = rows.where("bucket >= 0").select("bucket", "slice", "n", "of", "bytes")

    def strings(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(rows, window)
        out = [(key[0], lot, shard, some.tobytes(), b.string_windows[some].tobytes(), b.string_low[0][some].tobytes(), b.string_low[1][some].tobytes(), b"".join(b.strings[k].tobytes() for k in some.tolist())) for lot, shard, some in b.shards()]
        return pd.DataFrame(out, columns=["bucket", "lot", "shard", "strings", "windows", "docs", "starts", "symbols"])

    def lists(windows: bytes, symbols: bytes) -> list[list[int]]:
        size = np.frombuffer(windows, np.int64) + window - 1
        symbols, end = np.frombuffer(symbols, np.int32).tolist(), np.cumsum(size).tolist()
        return [symbols[b - n : b] for b, n in zip(end, size.tolist(), strict=True)]

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The automaton of a reference shard; its keys number the places of windows in order."""
        r = rows.iloc[0]
        windows = np.frombuffer(r["windows"], np.int64)
        doc = np.repeat(np.frombuffer(r["docs"], np.int64), windows)
        start = np.repeat(np.frombuffer(r["starts"], np.int64), windows) + spread(np.zeros(len(windows), np.int64), windows)
        order = np.lexsort((start, doc))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        rank, at, keys = rank.tolist(), 0, []
        for n in windows.tolist():
            keys.append([NEVER] * (window - 1) + rank[at : at + n])
            at += n
        steps, link, length, least = Automaton(lists(r["windows"], r["symbols"]), keys).table(window)
        out = {"bucket": r["bucket"], "lot": r["lot"], "shard": r["shard"], "steps": steps.tobytes(), "link": link.tobytes(), "length": length.tobytes(), "least": least.tobytes(), "at_docs": doc[order].tobytes(), "at_starts": start[order].tobytes()}
        return pd.DataFrame([out])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's strings through one automaton of their lot: the first place there of each of their windows."""
        for batch in batches:
            for i in range(len(batch)):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: E731, B023
                key = matched(get("steps", np.int32).reshape(-1, 3), get("link", np.int32), get("length", np.int32), get("least", np.int64), lists(batch.column("windows")[i].as_py(), batch.column("symbols")[i].as_py()), window)
                hit = key != NEVER
                docs, places = np.full(len(key), NEVER), np.full(len(key), NEVER)
                docs[hit], places[hit] = get("at_docs", np.int64)[key[hit]], get("at_starts", np.int64)[key[hit]]
                yield binaries([(batch.column("bucket")[i].as_py(), batch.column("strings")[i].as_py(), docs.tobytes(), places.tobytes())], [("bucket", L), ("strings", B), ("docs", B), ("places", B)])

    shards = dealt.groupBy("bucket").applyInPandas(strings, "bucket long, lot long, shard long, strings binary, windows binary, docs binary, starts binary, symbols binary")
    shards = materialize(shards, "word-shards")
    automata = shards.groupBy("bucket", "lot", "shard").applyInPandas(build, "bucket long, lot long, shard long, steps binary, link binary, length binary, least binary, at_docs binary, at_starts binary").drop("shard")
    # Each automaton goes to all strings of its lot: LOT_WORDS / SHARD_WORDS of them, about.
    merged = shards.select("bucket", "lot", "strings", "windows", "symbols").join(automata, ["bucket", "lot"]).mapInArrow(stream, "bucket long, strings binary, docs binary, places binary")

    def settle(rows: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        """For each slice the windows of its segments that stand before its own: (segment, first, end)."""
        if not len(rows):
            return pd.DataFrame({"slice": [], "bucket": [], "found": [], "n": []})
        b = Bucket(rows, window)
        doc, start = b.least(merged)
        segment = np.repeat(np.arange(len(b.windows)), b.windows)
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (segment[1:] != segment[:-1])))
        piece_of = segment[new]
        begin = new - b.base[piece_of]
        end = np.diff(np.append(new, len(doc))) + begin
        at = np.searchsorted(piece_of, np.arange(len(b.windows) + 1))
        each = np.diff(at)[b.of]
        piece, element = spread(at[b.of], each), np.repeat(np.arange(len(b.of)), each)
        d, s = doc[new[piece]], start[new[piece]]
        keep = (d < b.docs[element]) | ((d == b.docs[element]) & (s < b.starts[element]))
        piece, element = piece[keep], element[keep]
        row = np.repeat(np.arange(len(b.many)), b.many)[element]
        inside = element - (np.cumsum(b.many) - b.many)[row]
        table_ = np.stack([inside, begin[piece], end[piece]], axis=1).astype(np.int64)
        first, many = runs(row)
        return pd.DataFrame({"slice": b.slices[row[first]], "bucket": rows["bucket"].iloc[0], "found": [packed(table_[a : a + n].tobytes()) for a, n in zip(first.tolist(), many.tolist(), strict=True)], "n": many})

    found = dealt.groupBy("bucket").cogroup(merged.groupBy("bucket")).applyInPandas(settle, "slice long, bucket long, found binary, n long")
    found = found.groupBy(F.col("slice").alias("_slice")).agg(F.collect_list(F.struct("bucket", "found", "n")).alias("found"))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n, raw = batch.column("n")[i].as_py(), batch.column("bytes")[i].as_py()
                docs, starts = columns_of(batch.column("of")[i].as_py(), n, "qq")
                base = batch.column("n_places")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([raw[16 * k : 16 * k + 16] for k in range(n)], B), pa.array([batch.column("slice")[i].as_py()] * n, L), pa.array(np.arange(base, base + n)), pa.array(docs), pa.array(starts)], names=["window", "slice", "k", "doc", "start"])

    each = rows.where("bucket = -2").select("slice", "n", "of", "bytes", "n_places").mapInArrow(windows_of, "window binary, slice long, k long, doc long, start long")
    place = F.struct("doc", "start")
    firsts = each.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1")
    late = each.join(firsts, "window").where(F.col("first") < place).groupBy(F.col("slice").alias("_hot")).agg(F.collect_list("k").alias("late"))  # as many as the slice has windows

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("tx", B), ("removed", L), ("sha", B), ("kept", pa.string())]
        for batch in batches:
            for i in range(len(batch)):
                sizes, words = columns_of(batch.column("of")[i].as_py(), batch.column("n")[i].as_py(), "qq")
                raw, tx = unpacked(batch.column("bytes")[i].as_py(), int(sizes.sum())), batch.column("tx")[i].as_py()
                start, size, of, is_low = columns_of(batch.column("places")[i].as_py(), batch.column("n_places")[i].as_py(), "iiib")
                start, size, of = np.cumsum(start.astype(np.int64)), size.astype(np.int64), of.astype(np.int64)
                step = np.zeros(int(words.sum()) + 1, dtype=np.int64)

                def lose(a: np.ndarray, b: np.ndarray, step: np.ndarray = step) -> None:
                    np.add.at(step, a, 1)
                    np.add.at(step, b, -1)

                own = is_low == 0
                lose(start[own], (start + size)[own])
                order = np.argsort(of, kind="stable")
                at = np.searchsorted(of[order], np.arange(int(of.max()) + 2))
                base = dict(np.frombuffer(batch.column("base")[i].as_py(), np.int64).reshape(-1, 2).tolist())
                for f in batch.column("found")[i].as_py() or ():
                    k, a, b = np.frombuffer(unpacked(f["found"], 24 * f["n"]), np.int64).reshape(-1, 3).T
                    k = k + base[f["bucket"]]
                    many = at[k + 1] - at[k]
                    o = order[spread(at[k], many)]
                    lose(start[o] + np.repeat(a, many), start[o] + np.repeat(b - 1 + window, many))
                k = np.array(batch.column("late")[i].as_py() or [], dtype=np.int64)
                o = order[spread(at[k], at[k + 1] - at[k])]
                lose(start[o], start[o] + window)
                gone = np.cumsum(step[:-1]) > 0
                first, end, _ = spans(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)]), NO_BLANK)
                edge, out = np.concatenate([[0], np.cumsum(words)]).tolist(), []
                for d, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    lost = gone[a:b]
                    if lost.any():
                        left = np.flatnonzero(~lost)
                        cuts = np.flatnonzero(np.append(True, left[1:] != left[:-1] + 1)) if len(left) else left
                        runs_ = zip(left[cuts].tolist(), np.append(left[cuts[1:] - 1], left[-1:]).tolist(), strict=True)
                        kept = b" ".join(raw[first[a + x] : end[a + y]] for x, y in runs_)
                        out.append((tx[32 * d : 32 * d + 32], int(lost.sum()), hashlib.sha256(kept).digest(), kept.decode()))
                yield binaries(out, schema)

    whole = rows.where("bucket = -1").join(found, F.col("slice") == F.col("_slice"), "left").join(late, F.col("slice") == F.col("_hot"), "left")
    gone = whole.select("n", "of", "bytes", "tx", "places", "n_places", "base", "found", "late").mapInArrow(remove, "tx binary, removed long, sha binary, kept string")
    return cut.select("n", "tx", "words", "shas").mapInArrow(facts, "tx binary, words long, sha binary"), gone


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row, id, n_words, n_removed, sha256, kept) for each row; ``kept`` is null for rows that lose nothing."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    about = [F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("tx")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *about)
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    texts = docs.select(*about, text.alias("text")).groupBy("tx").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    facts, gone = repeats(texts, total, window, gram, hot)
    gone = gone.select(F.col("tx").alias("_tx"), "removed", F.col("sha").alias("_sha"), "kept")
    first = rows.groupBy(F.col("tx").alias("_ftx")).agg(F.min("id").alias("first"))
    out = rows.join(first, F.col("tx") == F.col("_ftx")).join(facts.withColumnRenamed("tx", "_wtx"), F.col("tx") == F.col("_wtx")).join(gone, F.col("tx") == F.col("_tx"), "left")
    copy = F.coalesce((F.col("id") > F.col("first")) & (F.col("words") >= window), F.lit(False))
    lost = F.col("removed").isNotNull() & F.col("id").isNotNull()
    pick = lambda whole, part, none: F.when(copy, whole).when(lost, part).otherwise(none)
    return out.select("row", "id", F.col("words").alias("n_words"), pick(F.col("words"), F.col("removed"), F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(pick(F.unhex(F.sha2(F.lit(""), 256)), F.col("_sha"), F.col("sha")))).alias("sha256"), pick(F.lit(""), F.col("kept"), F.lit(None).cast("string")).alias("kept"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without its repeated passages: a text that loses words holds the others, a space between two; the rest stay as they are."""
    out = judged(docs, id_col, text_col, window, gram)
    return out.select(*(F.coalesce(F.col("kept"), F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op12_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("sha256").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT h, min({'d': doc_id, 'i': i}) AS low FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT rid, i + k AS i FROM w JOIN m USING (h), range(0, 20) r(k) WHERE {'d': doc_id, 'i': w.i} > low),
p AS (SELECT rid, i, w FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d)),
k AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM p ANTI JOIN g USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid) LEFT JOIN n USING (rid)
"""
