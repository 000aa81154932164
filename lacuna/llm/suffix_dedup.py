"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms of shards.

A byte goes if some ``span`` bytes that cover it also start in a document with a smaller id. Strings are judged on
the input; they never cross documents.

1. Texts that are equal as a whole are made one by a shuffle, or, with ``few_copies``, are dealt into slices where they
   lie; the results are the same. Of equal texts all but the one with the smallest id go as a whole.
2. Of the hashes of the 20-byte strings in each window of ``span`` bytes the smallest is the window's anchor: equal
   windows have the same anchor at the same place. Each slice sends each of its anchors once; what stands in one
   text alone is dropped, and with it all windows that cannot repeat. A false agreement of hashes costs work only.
3. The windows of an anchor form a segment of at most ``span + 30`` bytes. A slice sends each of its segments once,
   with its smallest document, to the segment's bucket; segments are equal by their bytes, not by hashes. An anchor
   that stands in ``HOT`` slices or more is dealt by whole windows instead, so none outgrows its bucket.
4. An anchor whose segments are all equal is settled: there is nothing to merge. Of the others, runs of windows
   that stand in two segments (by hash: again, a false agreement costs work only) form strings. A string belongs to
   the shard of its smallest document; each shard's transform is built in a task of its own.
5. The interleave of all shards' transforms is refined one symbol a round: the rows in their present order are
   dealt stably by the symbol before them, which gives the order by one symbol more. A row starts a new interval in
   the round in which its prefix first differs from the row before it: that round less one is the common prefix.
   Rows whose common prefix is ``span`` are one repeated string, and no suffix was compared with another.
6. The smallest document of each repeated string says which occurrences go; slices get it for their segments, and
   the spans meet the texts once more.

Defined cases: null text is empty. Rows with a null id stay whole and count for nothing. Rows with one id are
judged alike: a repeat within the same id is none. Texts shorter than ``span`` stay whole. Empty tables give empty
results. Other columns are carried along by :func:`remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import SpanHashes, flat_bytes, hashes_of, materialize, n_buckets, slices, table

SPAN, GRAM = 50, 20
#: Bytes of text for a slice and for a bucket; slices from which on an anchor is dealt by windows.
SLICE_BYTES, BUCKET_BYTES, HOT = 2 << 20, 8 << 20, 4096
#: Bytes of strings whose transforms are merged at once, about, and the shards they form.
MERGED_BYTES, SHARDS = 1 << 20, 4
ALL = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first window, last window) of each run of windows with one anchor; ``offsets`` cut documents."""
    none = np.empty(0, np.int64)
    if len(data) < span:
        return none, none.astype(np.uint64), none, none
    if len(data) <= 2 * common.HASHED:
        return anchors_of(SpanHashes(data).grams(gram)[: len(data) - gram + 1], offsets, span, gram)
    parts = []  # windows that begin in a block; what its end cuts apart is matched like any other text
    for at in range(0, len(data) - span + 1, common.HASHED):
        block = data[at : at + common.HASHED + span - 1]
        doc, h, first, last = anchors_of(SpanHashes(block).grams(gram)[: len(block) - gram + 1], np.clip(offsets, at, at + len(block)) - at, span, gram)
        parts.append((doc, h, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def anchors_of(value: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same from the hashes of all runs of ``gram`` symbols, ``span`` or more symbols in all."""
    # Half of the hash above the place: the smallest is the leftmost of the smallest hashes.
    least = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    size, width = 1, span - gram + 1
    while 2 * size <= width:
        least = np.minimum(least[size:], least[:-size])
        size *= 2
    if size < width:
        least = np.minimum(least[width - size :], least[: size - width])
    room = np.maximum(np.diff(offsets) - span + 1, 0)  # windows of each document
    doc = np.repeat(np.arange(len(room), dtype=np.int32), room)
    window = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(room) - room), room)
    place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    return doc[first], value[place[first]], window[first], window[last]


# --- Burrows-Wheeler transforms of segments: symbols are bytes + 1, and 0 ends a segment -----------------------


def refine(order: np.ndarray, before: np.ndarray, step: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: rows in ``order`` go to ``step`` of them, dealt stably by the symbol before; segment ends stay first, in their order."""
    symbol = before[order]
    dealt = np.argsort(symbol, kind="stable")  # a radix sort of 16-bit symbols
    out = step[order[dealt]]
    out[: len(ends)] = ends
    return out, dealt, symbol[dealt]


def transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the symbol before each row, the row's place in the text), rows in suffix order; equal suffixes by segment."""
    before = np.empty_like(symbols)
    before[1:], before[0] = symbols[:-1], 0
    order = np.arange(len(symbols), dtype=np.int32)
    step = order - 1
    longest = int(np.diff(ends, prepend=-1).max()) if len(ends) else 0
    for _ in range(longest):
        order, _, _ = refine(order, before, step, ends)
    return before[order], order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of all shards' rows by their first ``depth`` symbols: (rows, common prefix with the row before, ``depth`` at most).

    It reads the transforms alone. A row's step is where its symbol before lies in its own shard: rows with that
    symbol keep their order.
    """
    before = np.concatenate(transforms)
    step = np.empty(len(before), dtype=np.int32)
    ends, base = [], 0
    for b in transforms:
        step[base + np.argsort(b, kind="stable")] = np.arange(base, base + len(b), dtype=np.int32)
        ends.append(np.arange(base, base + np.count_nonzero(b == 0), dtype=np.int32))
        base += len(b)
    ends = np.concatenate(ends)
    order = np.arange(len(before), dtype=np.int32)
    interval = np.zeros(len(before), dtype=np.int32)
    common = np.full(len(before), depth, dtype=np.int16)
    common[:1] = 0
    for length in range(1, depth + 1):
        order, dealt, symbol = refine(order, before, step, ends)
        old = interval[dealt]
        new = np.ones(len(before), dtype=bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        new[: len(ends)] = True
        np.minimum(common, length - 1, out=common, where=new & (common == depth))
        interval = np.cumsum(new, dtype=np.int32) - 1
    return order, common


def strings_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, each symbol's byte or -1) of strings that lie end to end."""
    symbols = np.zeros(len(data) + len(sizes), dtype=np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    is_byte = np.ones(len(symbols), dtype=bool)
    is_byte[ends] = False
    symbols[is_byte] = data.astype(np.uint16) + np.uint16(1)
    where = np.full(len(symbols), -1, dtype=np.int32)
    where[is_byte] = np.arange(len(data), dtype=np.int32)
    return symbols, ends.astype(np.int32), where


# --- the segments of a bucket ------------------------------------------------------------------------------------


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return new, np.diff(np.append(new, len(values)))


def spread(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``many[0]`` of them, and so on."""
    return np.arange(int(many.sum())) + np.repeat(starts - (np.cumsum(many) - many), many)


def distinct(parts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each value by its bytes, in order of first appearance, and the values."""
    of: dict[bytes, int] = {}
    return np.fromiter((of.setdefault(x, len(of)) for x in parts), np.int64, len(parts)), list(of)


_ZSTD = pa.Codec("zstd", compression_level=5)


def packed(data: bytes) -> bytes:
    return _ZSTD.compress(data, asbytes=True)


def unpacked(raw: bytes, size: int) -> bytes:
    return _ZSTD.decompress(raw, size, asbytes=True)


def columns_of(raw: bytes, n: int, kinds: str) -> list[np.ndarray]:
    """Columns of ``n`` numbers each, of the given numpy types, that were packed one after the other."""
    widths = [n * np.dtype(k).itemsize for k in kinds]
    data = unpacked(raw, sum(widths))
    return [np.frombuffer(data, k, n, at) for k, at in zip(kinds, np.cumsum([0, *widths[:-1]]).tolist(), strict=True)]


class Bucket:
    """The distinct segments that slices sent to a bucket, and the strings among them that have to be merged.

    ``rows``: slice, n, of (size, half of the anchor's hash and smallest document of each of n segments), bytes. The
    same rows give the same numbers.
    """

    def __init__(self, rows: pd.DataFrame, span: int):
        rows = rows.sort_values("slice")
        self.slices, self.span, self.many = rows["slice"].to_numpy(), span, rows["n"].to_numpy()
        sizes, h, docs = zip(*(columns_of(x, n, "HIq") for x, n in zip(rows["of"], self.many.tolist(), strict=True)), strict=True)
        sizes = [x.astype(np.int64) for x in sizes]
        parts = []
        for n, raw in zip(sizes, rows["bytes"], strict=True):
            text, at = unpacked(raw, int(n.sum())), 0
            for k in n.tolist():
                parts.append(text[at : at + k])
                at += k
        self.of, segments = distinct(parts)
        self.docs, h = np.concatenate(docs), np.concatenate(h)
        self.low = np.full(len(segments), ALL)
        np.minimum.at(self.low, self.of, self.docs)
        anchor = np.zeros(len(segments), dtype=np.uint32)
        anchor[self.of] = h
        size = np.array([len(x) for x in segments])
        self.windows = size - span + 1
        self.base = np.cumsum(self.windows) - self.windows
        # Of anchors with several segments: runs of windows that stand in two of them.
        order = np.argsort(anchor, kind="stable")
        _, count = runs(anchor[order])
        some = order[np.repeat(count > 1, count)]
        text = b"".join(segments[k] for k in some.tolist())
        data, end = np.frombuffer(text, np.uint8), np.cumsum(size[some])
        at = spread(end - size[some], self.windows[some])
        row = np.repeat(np.arange(len(some)), self.windows[some])
        value = SpanHashes(data).of(at, at + span) if len(at) else at.astype(np.uint64)
        by = np.argsort(value, kind="stable")
        first, count = runs(value[by])
        twice = np.zeros(len(value), dtype=bool)
        twice[by] = np.repeat(count > 1, count)
        hit = np.flatnonzero(twice)
        first = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1]))) if len(hit) else hit
        length = np.diff(np.append(first, len(hit)))
        begin = at[hit[first]]
        self.segment = some[row[hit[first]]]  # of each run, with its first window
        self.first = self.base[self.segment] + begin - (end - size[some])[row[hit[first]]]
        self.string, self.strings = distinct([text[a:b] for a, b in zip(begin.tolist(), (begin + length - 1 + span).tolist(), strict=True)])
        self.string_low = np.full(len(self.strings), ALL)
        np.minimum.at(self.string_low, self.string, self.low[self.segment])
        self.string_anchor = np.zeros(len(self.strings), dtype=np.uint32)
        self.string_anchor[self.string] = anchor[self.segment]
        self.string_windows = np.array([len(x) for x in self.strings], dtype=np.int64) - span + 1

    def shards(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(lot, shard, strings): the strings of anchors that have several; an anchor's strings are in one lot."""
        order = np.argsort(self.string_anchor, kind="stable")
        first, count = runs(self.string_anchor[order])
        open_ = np.repeat(count > 1, count)
        weight = np.add.reduceat(self.string_windows[order] + self.span, first) * (count > 1) if len(first) else first
        lot = np.repeat((np.cumsum(weight) - weight) // MERGED_BYTES, count)[open_]
        mine = order[open_]
        shard = (self.string_low[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(SHARDS)
        for k in np.unique(lot).tolist():
            for n in range(SHARDS):
                if len(some := np.sort(mine[(lot == k) & (shard == n)])):
                    yield k, n, some

    def least(self, merged: pd.DataFrame) -> np.ndarray:
        """The smallest document of each window of each segment; ``merged``: strings and the smallest documents of their windows."""
        start = np.cumsum(self.string_windows) - self.string_windows
        of_string = np.repeat(self.string_low, self.string_windows)
        for strings, least in zip(merged["strings"], merged["least"], strict=True):
            strings = np.frombuffer(strings, np.int64)
            of_string[spread(start[strings], self.string_windows[strings])] = np.frombuffer(least, np.int64)
        out = np.repeat(self.low, self.windows)
        many = self.string_windows[self.string]
        out[spread(self.first, many)] = of_string[spread(start[self.string], many)]
        return out


# --- slices ---------------------------------------------------------------------------------------------------------


class Slice:
    """A slice's anchors and, once those that others hold are known, its segments."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int, gram: int, buckets: int):
        self.data, self.offsets, self.span, self.buckets = data, offsets, span, buckets
        self.doc, self.h, self.first, self.last = anchors(data, offsets, span, gram)
        key = (self.bucket(self.h).astype(np.uint64) << np.uint64(32)) | (self.h & np.uint64(0xFFFFFFFF))
        self.keys, at, self.number = np.unique(key, return_index=True, return_inverse=True)
        last = np.zeros(len(self.keys), dtype=np.int64)
        last[self.number] = self.doc  # documents ascend, and the last one stays
        self.many = self.doc[at] != last
        self.of_bucket = (self.keys >> np.uint64(32)).astype(np.int64)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def occurrences(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first byte, size, h) of each segment, by bucket; ``shared`` and ``hot``: of each of ``keys``."""
        shared, hot = shared[self.number], hot[self.number]
        some, each = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        many = self.last[each] - self.first[each] + 1
        window = spread(self.first[each], many)
        h = np.concatenate([self.h[some], hashes_of(self.data, window, window + self.span) if len(window) else np.empty(0, np.uint64)])
        doc = np.concatenate([self.doc[some], np.repeat(self.doc[each], many)])
        start = np.concatenate([self.first[some], window])
        size = np.concatenate([self.last[some] - self.first[some] + self.span, np.full(len(window), self.span)])
        by = np.lexsort((start, self.bucket(h)))
        return doc[by], start[by], size[by], h[by]


def binaries(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


L, B = pa.int64(), pa.binary()


def repeated_spans(texts: DataFrame, total: int, span: int = SPAN, gram: int = GRAM, hot_slices: int = HOT, hashed: bool = True) -> DataFrame:
    """(tx, id, removed, spans, sha256, pieces) for the ``texts`` (tx, id, text), ``total`` bytes or less, that lose bytes.

    ``pieces``: first byte (from 0) and number of bytes of what is left. Only where ``hashed`` are the texts sent on
    to give ``sha256``; else it is null.
    """
    buckets = n_buckets(total, BUCKET_BYTES, 16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, offsets = flat_bytes(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            tx = "".join(batch.column("tx").to_pylist()).encode()
            yield binaries([(uuid.uuid4().int >> 65, ids.tobytes(), tx, np.diff(offsets).astype(np.int64).tobytes(), packed(data.tobytes()))], [("slice", L), ("ids", B), ("tx", B), ("sizes", B), ("data", B)])

    # Written once, so that a slice's number stands for the same texts from here on.
    cut = materialize(texts.where(F.octet_length("text") >= span).select("id", "tx", "text").mapInArrow(deal, "slice long, ids binary, tx binary, sizes binary, data binary"), "slices")

    def opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.frombuffer(batch.column("sizes")[i].as_py(), np.int64)
        return np.frombuffer(unpacked(batch.column("data")[i].as_py(), int(sizes.sum())), np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                s = Slice(*opened(batch, i), span, gram, buckets)
                h = s.keys.astype(np.uint32)
                at = np.searchsorted(s.of_bucket, np.arange(buckets + 1)).tolist()
                rows = [(b, number, h[x:y].tobytes(), s.many[x:y].tobytes()) for b, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
                yield binaries(rows, [("bucket", L), ("slice", L), ("h", B), ("many", B)])

    def share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["h"]])
        many = np.concatenate([np.frombuffer(x, bool) for x in rows["many"]])
        _, of = np.unique(h, return_inverse=True)
        texts_ = np.bincount(of, weights=many + 1.0)[of]
        slices_ = np.bincount(of)[of]
        flags = (texts_ > 1).astype(np.uint8) + 2 * (slices_ >= hot_slices).astype(np.uint8)
        ends = np.cumsum([len(x) for x in rows["many"]])
        return pd.DataFrame({"slice": rows["slice"], "bucket": key[0], "flags": [packed(x.tobytes()) for x in np.split(flags, ends[:-1])], "n": np.diff(ends, prepend=0)})

    found = cut.select("slice", "sizes", "data").mapInArrow(find, "bucket long, slice long, h binary, many binary").groupBy("bucket").applyInPandas(share, "slice long, bucket long, flags binary, n long")
    hits = found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "flags", "n")).alias("hits"))  # as many as the slice has anchors

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the slice's distinct segments; under bucket -1 the ``n`` texts that have any, and where they lie."""
        for batch in batches:
            for i, number in enumerate(batch.column("slice").to_pylist()):
                s = Slice(*opened(batch, i), span, gram, buckets)
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                tx = batch.column("tx")[i].as_py()
                flags = np.zeros(len(s.keys), dtype=np.uint8)
                for hit in batch.column("hits")[i].as_py():
                    at = np.searchsorted(s.of_bucket, hit["bucket"])
                    flags[at : at + hit["n"]] = np.frombuffer(unpacked(hit["flags"], hit["n"]), np.uint8)
                doc, start, size, h = s.occurrences((flags & 1).astype(bool), flags > 1)
                if not len(doc):
                    continue
                raw = s.data.tobytes()
                of, parts = distinct([raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
                low, key = np.full(len(parts), ALL), np.zeros(len(parts), dtype=np.uint64)
                np.minimum.at(low, of, ids[doc])
                key[of] = h
                bucket = s.bucket(key)  # numbers ascend with it
                first, many = runs(bucket)
                sizes, half = np.array([len(x) for x in parts], dtype=np.uint16), key.astype(np.uint32)
                rows = []
                for a, n in zip(first.tolist(), many.tolist(), strict=True):
                    some = slice(a, a + n)
                    rows.append((int(bucket[a]), number, n, packed(sizes[some].tobytes() + half[some].tobytes() + low[some].tobytes()), packed(b"".join(parts[some])), None, None, None, 0))
                held, doc = np.unique(doc, return_inverse=True)
                begin, end = s.offsets[held], s.offsets[held + 1]
                texts_ = packed(b"".join(raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))) if hashed else None
                by = np.argsort(start, kind="stable")
                steps = np.diff(start[by], prepend=0)
                where = packed(np.diff(doc[by], prepend=0).astype(np.int32).tobytes() + steps.astype(np.int32).tobytes() + size[by].astype(np.uint16).tobytes() + of[by].astype(np.int32).tobytes())
                base = np.stack([bucket[first], first], axis=1).astype(np.int64).tobytes()
                about = packed((end - begin).astype(np.int64).tobytes() + begin.astype(np.int64).tobytes() + ids[held].tobytes())
                rows.append((-1, number, len(held), about, texts_, b"".join(tx[64 * k : 64 * k + 64] for k in held.tolist()), where, base, len(by)))
                yield binaries(rows, [("bucket", L), ("slice", L), ("n", L), ("of", B), ("bytes", B), ("tx", B), ("places", B), ("base", B), ("n_places", L)])

    rows = cut.join(hits, "slice").select("slice", "sizes", "data", "ids", "tx", "hits").mapInArrow(segments, "bucket long, slice long, n long, of binary, bytes binary, tx binary, places binary, base binary, n_places long")
    rows = materialize(rows, "segments")
    dealt = rows.where("bucket >= 0").select("bucket", "slice", "n", "of", "bytes")

    def strings(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(rows, span)
        out = [(key[0], lot, shard, some.tobytes(), b.string_windows[some].tobytes(), b.string_low[some].tobytes(), b"".join(b.strings[k] for k in some.tolist())) for lot, shard, some in b.shards()]
        return pd.DataFrame(out, columns=["bucket", "lot", "shard", "strings", "windows", "low", "bytes"])

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The transform of a shard, with the byte that each of its rows starts at."""
        data, windows = np.frombuffer(rows["bytes"].iloc[0], np.uint8), np.frombuffer(rows["windows"].iloc[0], np.int64)
        symbols, ends, where = strings_of(data, windows + span - 1)
        before, order = transform(symbols, ends)
        out = rows[["bucket", "lot", "shard", "strings", "windows", "low"]]
        return out.assign(before=[before.tobytes()], place=[where[order].tobytes()])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The shards' transforms merged; the smallest document of each window of each string."""
        rows = rows.sort_values("shard")
        before = [np.frombuffer(x, np.uint16) for x in rows["before"]]
        windows = [np.frombuffer(x, np.int64) for x in rows["windows"]]
        sizes = [int((w + span - 1).sum()) for w in windows]
        shift = np.cumsum(sizes) - sizes
        order, common = merge(before, span)
        place = np.concatenate([np.where(p >= 0, p + at, -1) for p, at in zip((np.frombuffer(x, np.int32).astype(np.int64) for x in rows["place"]), shift.tolist(), strict=True)])[order]
        all_ = np.concatenate(windows)
        low = np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in rows["low"]]), all_ + span - 1)
        starts, _ = runs(np.cumsum(common < span))  # an interval: rows whose common prefix with the one before is the span
        value = np.where(place >= 0, low[place], ALL)
        least = np.minimum.reduceat(value, starts)
        of_byte = np.empty(len(low), dtype=np.int64)
        of_byte[place[place >= 0]] = np.repeat(least, np.diff(np.append(starts, len(order))))[place >= 0]
        end = np.cumsum(all_ + span - 1)
        got = of_byte[spread(end - (all_ + span - 1), all_)]
        return pd.DataFrame({"bucket": [key[0]], "strings": [b"".join(rows["strings"])], "least": [got.tobytes()]})

    shards = dealt.groupBy("bucket").applyInPandas(strings, "bucket long, lot long, shard long, strings binary, windows binary, low binary, bytes binary")
    built = shards.groupBy("bucket", "lot", "shard").applyInPandas(build, "bucket long, lot long, shard long, strings binary, windows binary, low binary, before binary, place binary")
    merged = built.groupBy("bucket", "lot").applyInPandas(meet, "bucket long, strings binary, least binary")

    def settle(rows: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        """For each slice the windows of its segments that stand in a smaller document than its own: (segment, first, end, smallest document)."""
        if not len(rows):
            return pd.DataFrame({"slice": [], "bucket": [], "found": []})
        b = Bucket(rows, span)
        least = b.least(merged)
        segment = np.repeat(np.arange(len(b.low)), b.windows)
        new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (segment[1:] != segment[:-1])))
        piece_of = segment[new]
        begin = new - b.base[piece_of]
        end = np.diff(np.append(new, len(least))) + begin
        at = np.searchsorted(piece_of, np.arange(len(b.low) + 1))
        each = np.diff(at)[b.of]
        piece = spread(at[b.of], each)
        element = np.repeat(np.arange(len(b.of)), each)
        keep = least[new[piece]] < b.docs[element]
        piece, element = piece[keep], element[keep]
        row = np.repeat(np.arange(len(b.many)), b.many)[element]
        inside = element - (np.cumsum(b.many) - b.many)[row]
        table_ = np.stack([inside, begin[piece], end[piece], least[new[piece]]], axis=1).astype(np.int64)
        first, many = runs(row)
        return pd.DataFrame({"slice": b.slices[row[first]], "bucket": rows["bucket"].iloc[0], "found": [packed(table_[a : a + n].tobytes()) for a, n in zip(first.tolist(), many.tolist(), strict=True)], "n": many})

    found = dealt.groupBy("bucket").cogroup(merged.groupBy("bucket")).applyInPandas(settle, "slice long, bucket long, found binary, n long")
    found = found.groupBy(F.col("slice").alias("_slice")).agg(F.collect_list(F.struct("bucket", "found", "n")).alias("found"))  # as many as the slice has segments

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("tx", pa.string()), ("id", L), ("removed", L), ("spans", L), ("sha256", pa.string()), ("pieces", pa.list_(pa.struct([("at", L), ("n", L)])))]
        for batch in batches:
            for i, found_ in enumerate(batch.column("found").to_pylist()):
                sizes, offset, ids = columns_of(batch.column("of")[i].as_py(), batch.column("n")[i].as_py(), "qqq")
                raw, tx = unpacked(batch.column("bytes")[i].as_py(), int(sizes.sum())) if hashed else b"", batch.column("tx")[i].as_py()
                base = dict(np.frombuffer(batch.column("base")[i].as_py(), np.int64).reshape(-1, 2).tolist())
                doc, start, size, of = (x.astype(np.int64) for x in columns_of(batch.column("places")[i].as_py(), batch.column("n_places")[i].as_py(), "iiHi"))
                doc = np.cumsum(doc)
                start = np.cumsum(start) - offset[doc]
                low = np.full(int(of.max()) + 1, ALL)
                np.minimum.at(low, of, ids[doc])
                # Within the slice: all but the occurrences in the segment's smallest document go.
                own = ids[doc] > low[of]
                spans = [(doc[own], start[own], (start + size)[own])]
                order = np.argsort(of, kind="stable")
                at = np.searchsorted(of[order], np.arange(len(low) + 1))
                for f in found_ or ():
                    k, a, b, least = np.frombuffer(unpacked(f["found"], 32 * f["n"]), np.int64).reshape(-1, 4).T
                    k = k + base[f["bucket"]]
                    many = at[k + 1] - at[k]
                    o = order[spread(at[k], many)]
                    hit = ids[doc[o]] > np.repeat(least, many)
                    spans.append((doc[o][hit], (start[o] + np.repeat(a, many))[hit], (start[o] + np.repeat(b - 1 + span, many))[hit]))
                d, a, b = joined(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                first, many = runs(d)
                begin, rows = (np.cumsum(sizes) - sizes).tolist(), []
                for x, m in zip(first.tolist(), many.tolist(), strict=True):
                    k = int(d[x])
                    left = [(p, q) for p, q in zip([0, *b[x : x + m].tolist()], [*a[x : x + m].tolist(), int(sizes[k])], strict=True) if q > p]
                    sha = hashlib.sha256(b"".join(raw[begin[k] + p : begin[k] + q] for p, q in left)).hexdigest() if hashed else None
                    rows.append((tx[64 * k : 64 * k + 64].decode(), int(ids[k]), int((b - a)[x : x + m].sum()), m, sha, [{"at": p, "n": q - p} for p, q in left]))
                yield binaries(rows, schema)

    whole = rows.where("bucket = -1").join(found, F.col("slice") == F.col("_slice"), "left")
    whole = whole.select("n", "of", "bytes", "tx", "places", "base", "n_places", "found")
    return whole.mapInArrow(remove, "tx string, id long, removed long, spans long, sha256 string, pieces array<struct<at: long, n: long>>")


def joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each document: overlapping and touching ones become one."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    _, rank = np.unique(doc, return_inverse=True)
    shift = rank.astype(np.int64) << 33
    reach = np.maximum.accumulate(b + shift)
    new = np.append(True, (a + shift)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], a[new], (reach - shift)[last]


def whole_characters(piece: Column) -> Column:
    """UTF-8 bytes without those of a character that was cut, at either end."""
    skip = F.length(F.regexp_extract(F.hex(F.substring(piece, 1, 3)), "^((?:[89AB].)*)", 1)) / 2
    tail = F.length(F.regexp_extract(F.hex(F.substring(piece, -3, 3)), "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", 0)) / 2
    return F.substring(piece, (skip + 1).cast("int"), F.greatest(F.lit(0), F.octet_length(piece) - skip - tail).cast("int"))


def joined_pieces(text: Column, pieces: Column, of: Callable[[Column], Column]) -> Column:
    """The pieces' bytes, each as ``of`` gives it, one after the other; the text's bytes are taken once for all of them."""
    one = lambda x: F.array_join(F.transform(pieces, lambda p: of(F.substring(x, (p["at"] + 1).cast("int"), p["n"].cast("int"))).cast("string")), "")
    return F.get(F.transform(F.array(text.cast("binary")), one), F.lit(0))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot_slices: int = HOT, few_copies: bool = False) -> DataFrame:
    """(row, bytes, removed, spans, sha256, kept) for each row of ``docs``; ``kept`` is the text that is left, cut characters dropped.

    Each row's text is shuffled once. What it loses comes to it as places, and is cut out by built-in functions. Where
    copies may be many, ``sha256`` comes with these, and a query that reads no ``kept`` shuffles no texts of rows.
    """
    text = F.col(text_col).cast("string")
    about = [F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("tx"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *about)  # which holds the text, once
    total = rows.agg(F.sum("bytes")).head()[0] or 0
    texts = docs.select(*about, text.alias("text")).where("id is not null and text is not null")
    if not few_copies:  # else the shuffle of all texts costs more than what copies send
        texts = texts.groupBy("tx").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    first = rows.where("id is not null").groupBy(F.col("tx").alias("_ftx")).agg(F.min("id").alias("first"))
    gone = repeated_spans(texts, total, span, gram, hot_slices, hashed=not few_copies).withColumnsRenamed({"tx": "_tx", "id": "_id"})
    # Of equal texts the first one's result is read; rows that share its id have the same one.
    gone = gone.join(first, (F.col("_tx") == F.col("_ftx")) & (F.col("_id") == F.col("first"))).drop("_ftx", "first", "_id").dropDuplicates(["_tx"])
    if few_copies:
        gone = materialize(gone, "gone")  # places alone: what led to them can go
    out = rows.join(first, F.col("tx") == F.col("_ftx"), "left").join(gone, F.col("tx") == F.col("_tx"), "left")
    copy = F.coalesce((F.col("id") > F.col("first")) & (F.col("bytes") >= span), F.lit(False))
    lost = F.col("removed").isNotNull() & F.col("id").isNotNull()
    pick = lambda whole, part, none: F.when(copy, whole).when(lost, part).otherwise(none)
    zero = F.lit(0).cast("long")
    own = F.col("row")[text_col].cast("string")
    sha256 = F.sha2(joined_pieces(own, F.col("pieces"), lambda x: x), 256) if few_copies else F.col("sha256")
    left = joined_pieces(own, F.col("pieces"), whole_characters)
    return out.select("row", "bytes", pick(F.col("bytes"), F.col("removed"), zero).alias("removed"), pick(F.lit(1).cast("long"), F.col("spans"), zero).alias("spans"), pick(F.sha2(F.lit(""), 256), sha256, F.col("tx")).alias("sha256"), pick(F.lit(""), left, own).alias("kept"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` without its repeated passages: the text column holds what is left."""
    out = judged(docs, id_col, text_col, span, gram)
    return out.select(*(F.col("kept" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("bytes").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha256").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT rid, doc_id, i, md5(x[i + 1:i + 50]) AS h FROM (SELECT rid, doc_id, x, unnest(range(0, octet_length(x) - 49)) AS i FROM d WHERE doc_id IS NOT NULL)),
m AS (SELECT h, min(doc_id) AS low FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT rid, i, CASE WHEN i > lag(i) OVER o + 50 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM w JOIN m USING (h) WHERE doc_id > low WINDOW o AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM g),
s AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY rid, span),
t AS (SELECT rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list([a, b] ORDER BY a) AS cuts FROM s GROUP BY rid)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(CASE WHEN n_spans IS NULL THEN x ELSE unhex(array_to_string(list_transform(range(0, len(cuts) + 1), lambda i: hex(x[CASE WHEN i = 0 THEN 1 ELSE cuts[i][2] + 1 END:CASE WHEN i = len(cuts) THEN octet_length(x) ELSE cuts[i + 1][1] END])), '')) END) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated passages removed; n_chars follows the text. Rows without an id or a text stay as they are."""
    out = judged(docs, few_copies=True)  # near-duplicates are gone
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
