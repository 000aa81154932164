"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once for each worker.

Both vocabularies encode parts of a text independently wherever their pre-tokenizer always cuts: before a
single space between two other characters (byte-level vocabulary), at every blank (word vocabulary), and between
a Latin letter or ASCII digit and one of the signs of ``_SIGNS`` or a line end (both). Of other letters some turn into
a letter and a mark when they are normalised (a capital I with a dot, letters that are never composed), and the mark
belongs to the signs after it; no cut is made there. Texts are cut there, pieces that were not seen before go through
the library, many in one call, and the ids of all pieces are joined. The ids are those of the library for the whole
text, strings of special tokens included; the tests hold them against it.

The cuts, the lookups and the joining are array operations over the UTF-8 bytes of many texts. A remembered word is
found by its bytes themselves (32 of them with its length), so two words are never taken for one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_bytes, mix

#: Distinct words and pieces that a worker remembers (the first ones, so the frequent ones), and bytes of the longest of them.
REMEMBERED, LONGEST = 500_000, 31
#: Texts that are taken from an iterator at once, and words that are looked up together: those that are not remembered go through the library once for all of them.
TOGETHER, LOOKED_UP = 512, 1 << 19
#: Words of one step of the array operations: their arrays stay small.
STEP = 1 << 15
_PLAIN = re.compile(r" ?[^\s\x1c-\x1f]{1,48}").fullmatch
_SIGNS = b'.,;:!?\n"#$%&()*+-/<=>@[\\]^_`{}~'  # not ', which begins 's, nor |, which ends <|
_PAD = b"\n" * (LONGEST + 1)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_workers: dict[tuple[str, bool], Encoder] = {}


def _flags(size: int, true: Iterable[int]) -> np.ndarray:
    out = np.zeros(size, dtype=bool)
    out[list(true)] = True
    return out


_SPACES = [c.encode() for c in map(chr, range(0x3001)) if c.isspace()]
_BLANK = _flags(256, [c[0] for c in _SPACES if len(c) == 1])
_LEAD = _flags(256, [c[0] for c in _SPACES if len(c) > 1])
_TWO, _THREE = ([int.from_bytes(c) for c in _SPACES if len(c) == n] for n in (2, 3))
_SIGN = _flags(256, _SIGNS)
_ALNUM = _flags(256, [c for c in range(128) if chr(c).isalnum()])
_LATIN = _flags(0x400, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)])
#: For each length the bytes of a window that count.
_MASKS = np.array([[255] * n + [0] * (LONGEST + 1 - n) for n in range(LONGEST + 1)], dtype=np.uint8).view("<u8")


def encoder(path: str, at_blanks: bool) -> Encoder:
    """The worker's own encoder for a vocabulary; it outlives a task."""
    if (path, at_blanks) not in _workers:
        _workers[path, at_blanks] = Encoder(path, at_blanks)
    return _workers[path, at_blanks]


def _blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _BLANK[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        code = data[lead].astype(np.uint32) << 8 | data[lead + 1]
        two, three = lead[np.isin(code, _TWO)], lead[np.isin(code << 8 | data[lead + 2], _THREE)]
        for at in (two, two + 1, three, three + 1, three + 2):
            out[at] = True
    return out


def _between(cut: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what lies between cuts, inside of spans with one byte between them."""
    cut[starts] = cut[ends] = True
    at, over = np.flatnonzero(cut), np.zeros(len(cut), dtype=bool)
    over[ends] = True
    kept = ~over[at[:-1]]
    return at[:-1][kept], at[1:][kept]


def _taken(ids: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``first[at]`` to ``first[at + 1]`` of the ids, one after the other, and their lengths."""
    counts = first[at + 1] - first[at]
    out, to = np.empty(counts.sum(), dtype="<u4"), 0
    for k in range(0, len(at), STEP):
        some = counts[k : k + STEP]
        ends = np.cumsum(some)
        out[to : to + ends[-1]] = ids[np.repeat(first[at[k : k + STEP]] - (ends - some), some) + np.arange(ends[-1])]
        to += int(ends[-1])
    return out, counts


class Memory:
    """Ids of words of up to ``LONGEST`` bytes, found by the words' bytes. Place 0 stands for none."""

    def __init__(self):
        self.slots = np.zeros(1 << (2 * REMEMBERED + 1).bit_length(), dtype=np.int32)
        self.size, self.keys = 1, np.zeros((REMEMBERED + 1, 4), dtype=np.uint64)
        self.first, self.ids = np.zeros(2, dtype=np.int64), np.empty(0, dtype="<u4")

    @staticmethod
    def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        windows = np.ndarray(len(data) - LONGEST, dtype=f"V{LONGEST + 1}", buffer=data, strides=(1,))
        sizes = np.minimum(sizes, LONGEST)
        keys = windows[starts].view("<u8").reshape(-1, 4) & _MASKS[sizes]
        keys[:, 3] |= sizes.astype(np.uint64) << np.uint64(56)
        return keys

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _MULTIPLIERS[0]
        for k in (1, 2, 3):
            h += keys[:, k] * _MULTIPLIERS[k]
        return (mix(h) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, todo, slot = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), self._slots(keys)
        while len(todo):
            at = self.slots[slot]
            differ = self.keys[at] ^ keys[todo]
            same = (differ[:, 0] | differ[:, 1] | differ[:, 2] | differ[:, 3]) == 0
            out[todo[same]] = at[same]
            on = (at > 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> None:
        """Remember, while there is room, ``which`` of some words that are not known yet; ``keys`` are those of ``which``."""
        room = len(self.keys) - self.size
        if not room:
            return
        keys, which = keys[:room], which[:room]
        places, slot = self.size + np.arange(len(keys)), self._slots(keys)
        ids, counts = _taken(ids, first, which)
        self.keys[places], self.size = keys, self.size + len(keys)
        self.ids, self.first = np.concatenate([self.ids, ids]), np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        while len(places):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = places[free]
            lost = self.slots[slot] != places
            places, slot = places[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class Encoder:
    """``ids(texts)`` yields the ids of each text as little-endian unsigned 32-bit integers.

    ``at_blanks``: the vocabulary drops blanks, so words are encoded; else a word has its leading space.
    """

    def __init__(self, path: str, at_blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.at_blanks = at_blanks
        self.between = " \ue000 " if at_blanks else "\n"
        self.mark = np.array(self._encode(["\ue000" if at_blanks else "\n"])[0], dtype="<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.begins = _flags(max(vocabulary.values()) + 1, [i for t, i in vocabulary.items() if t[0] == "\u0120"])  # with a space
        self.words, self.pieces = Memory(), Memory()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts with a line end between them."""
        blank = _blanks(data)
        if self.at_blanks:
            blank &= (data < 0x1C) | (data > 0x1F)
            edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
            return edges[::2], edges[1::2]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:-1] = (data[1:-1] == 32) & ~(blank[:-2] | blank[2:])
        return _between(cut, starts, ends)

    def _found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, memory: Memory, learn: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has; ``learn`` gets the distinct ones that are not remembered."""
        sizes = ends - starts
        at = np.concatenate([memory.find(Memory.keys_of(data, starts[k : k + STEP], sizes[k : k + STEP])) for k in range(0, len(starts), STEP)])
        at[sizes > LONGEST] = 0
        new = np.flatnonzero(at == 0)
        ids, first = memory.ids, memory.first
        if len(new):
            place: dict[bytes, int] = {}
            raw = memoryview(data)
            to = np.array([place.setdefault(bytes(raw[a:b]), len(place)) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            more, counts = learn(list(place))
            more_first = np.concatenate([[0], np.cumsum(counts)])
            at[new] = len(first) - 1 + to
            ids, first = np.concatenate([ids, more]), np.concatenate([first, first[-1] + more_first[1:]])
            which, one = np.unique(to, return_index=True)
            one = new[one]
            short = sizes[one] <= LONGEST
            memory.add(Memory.keys_of(data, starts[one[short]], sizes[one[short]]), more, more_first, which[short])
        return _taken(ids, first, at)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words that are not remembered, from those of their pieces."""
        data = np.frombuffer(b"\n" + b"\n".join(words) + _PAD, dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[1], ends[:-1] + 1])
        blank, cut = _blanks(data), np.zeros(len(data), dtype=bool)
        cut[2:] = (data[1:-1] == 10) & ~(blank[:-2] | blank[2:])  # after a line end
        at = np.flatnonzero(_SIGN[data])
        lead, last = data[at - 2], data[at - 1]
        latin = (lead >= 0xC3) & (lead <= 0xC9) & _LATIN[((lead & 15).astype(np.int64) << 6) | (last & 63)]
        cut[at[_ALNUM[last] | latin]] = True
        piece_starts, piece_ends = _between(cut, starts, ends)
        ids, counts = self._found(data, piece_starts, piece_ends, self.pieces, self._encode_pieces)
        return ids, np.add.reduceat(counts, np.searchsorted(piece_starts, starts))

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, by the library: one call for many that can stand beside each other."""
        kinds: tuple[list[int], ...] = ([], [], [])  # with a leading space, without, and those that stand alone
        texts = [p.decode() for p in pieces]
        for i, p in enumerate(texts):
            plain = _PLAIN(p) and "\ue000" not in p and "<|" not in p  # no special tokens
            kinds[2 if not plain else 1 if self.at_blanks or p[0] != " " else 0].append(i)
        order, ids, counts = [], [], []
        for kind, members in enumerate(kinds):
            for k in range(0, len(members), 1024):
                some = members[k : k + 1024]
                order += some
                together = self._encode_together([texts[i] for i in some], kind == 0) if kind < 2 else None
                if together is None:
                    alone = self._encode([texts[i] for i in some])
                    together = np.array([x for got in alone for x in got], dtype="<u4"), np.array([len(got) for got in alone])
                ids.append(together[0])
                counts.append(together[1])
        at = np.empty(len(pieces), dtype=np.int64)
        at[order] = np.arange(len(pieces))
        return _taken(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), at)

    def _encode_together(self, some: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray] | None:
        got = np.array(self._encode([("" if spaced else self.between).join(some)])[0], dtype="<u4")
        if spaced:  # a token begins with a space where a piece begins
            hit = np.flatnonzero(self.begins[got])
            return (got, np.diff(hit, append=len(got))) if len(hit) == len(some) and not hit[0] else None
        n, hit = len(self.mark), np.flatnonzero(got == self.mark[-1])
        hit = hit[hit >= n - 1]
        for k in range(1, n):
            hit = hit[got[hit - k] == self.mark[-1 - k]]
        if len(hit) != len(some) - 1:
            return None
        kept = np.ones(len(got), dtype=bool)
        for k in range(n):
            kept[hit - k] = False
        return got[kept], np.append(hit + 1 - n, len(got)) - np.concatenate([[0], hit + 1])

    def ids(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        if isinstance(texts, pa.Array):
            yield from self._ids(texts)
            return
        texts = iter(texts)
        while some := list(islice(texts, TOGETHER)):
            yield from self._ids(pa.array(some, pa.large_string()))

    def _ids(self, texts: pa.Array) -> Iterator[bytes]:
        if not len(texts):
            return
        kind = pa.large_string()
        data, offsets = flat_bytes(pc.binary_join_element_wise(pc.fill_null(texts.cast(kind), ""), pa.scalar("", kind), pa.scalar("\n", kind)))
        data, starts, ends = np.concatenate([np.frombuffer(b"\n", np.uint8), data, np.frombuffer(_PAD, np.uint8)]), offsets[:-1] + 1, offsets[1:]
        word_starts, word_ends = self._cut(data, starts, ends)
        found = [self._found(data, word_starts[k : k + LOOKED_UP], word_ends[k : k + LOOKED_UP], self.words, self._learn) for k in range(0, len(word_starts), LOOKED_UP)]
        raw = memoryview(np.concatenate([np.empty(0, "<u4"), *(ids for ids, _ in found)])).cast("B")
        sums = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(counts for _, counts in found)]))])
        bounds = (4 * sums[np.searchsorted(word_starts, np.append(starts, ends[-1]))]).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield bytes(raw[a:b])
