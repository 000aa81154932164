"""Words of UTF-8 texts as spans of bytes, found for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
#: Bytes of words: all but blanks; or ASCII letters and digits, and whatever is not ASCII.
NO_BLANK = ~np.isin(_ALL, [0x20, *range(0x09, 0x0E)])
ALPHANUMERIC = (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | ((_ALL >= 0x41) & (_ALL <= 0x5A))


def spans(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text) of each word; ``offsets`` cut ``data`` into texts, and no word crosses a cut."""
    inside = of[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, start, side="right") - 1


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of spans as an Arrow array; spans ascend and do not overlap."""
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[start] += 1
    np.subtract.at(step, end, 1) if len(end) else None
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    inside = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word among the distinct ones, and these."""
    found = joined(data, start, end).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def blocks(text: bytes, limit: int, of: np.ndarray, carry: int) -> list[tuple[int, int, int]]:
    """(first byte, end, own words) of pieces of about ``limit`` bytes or more, cut between words.

    A piece owns the words from its first byte on, and the first ``carry`` words of what follows are there as well.
    """
    out, at, size = [], 0, len(text)
    data = np.frombuffer(text, np.uint8)
    while at < size:
        end, reach = at, at + limit
        while True:  # a window that holds the own words and the carry
            start, stop, _ = spans(data[at:reach], np.array([0, min(reach, size) - at]), of)
            whole = len(stop) if reach >= size else int(np.searchsorted(stop, min(reach, size) - at))  # the last word may go on
            own = whole if reach >= size else whole - carry
            if own > 0 or reach >= size:
                break
            reach += reach - at  # a long word: as far again
        if reach >= size:
            if len(start):
                out.append((at, size, own))
            break
        end = at + int(stop[whole - 1])
        out.append((at, end, own))
        at += int(start[own]) if own < len(start) else end - at
    return out
