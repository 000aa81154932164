"""First words of MD5 digests of many short texts that differ in a few digits, as NumPy arrays."""

from __future__ import annotations

import hashlib
from functools import cache
from math import floor, sin

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_ADDED = [floor(abs(sin(i + 1)) * (1 << 32)) for i in range(64)]
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_MASK = (1 << 32) - 1


@cache
def _digits(first: int, last: int, at: int) -> list[np.ndarray]:
    """The little-endian words that the digits of first to last - 1 (all of one length) fill, if they begin at byte ``at`` of a word."""
    text = np.char.zfill(np.arange(first, last).astype(str), len(str(last - 1))).astype("S")
    width = len(str(last - 1))
    raw = np.zeros((last - first, -(-(at + width) // 4) * 4), dtype=np.uint8)
    raw[:, at : at + width] = text.view(np.uint8).reshape(-1, width)
    return [np.ascontiguousarray(raw[:, 4 * i : 4 * i + 4]).view("<u4").ravel() for i in range(raw.shape[1] // 4)]


def md5_words(before: str, first: int, last: int, after: str) -> np.ndarray:
    """The first 8 hex digits, as integers, of the MD5 of ``before`` + digits + ``after`` for first to last - 1.

    The digits have the length of ``last`` - 1, with zeros in front.
    """
    width = len(str(last - 1))
    head, tail = before.encode(), after.encode()
    size = len(head) + width + len(tail)
    if size > 55:  # more than one block of the digest
        return np.array([int(hashlib.md5(b"%s%0*d%s" % (head, width, k, tail)).hexdigest()[:8], 16) for k in range(first, last)], dtype=np.uint32)
    block = (head + bytes(width) + tail + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    words: list = [int.from_bytes(block[4 * i : 4 * i + 4], "little") for i in range(16)]
    varying = {len(head) // 4 + i: d for i, d in enumerate(_digits(first, last, len(head) % 4))}
    whole = {i: d | np.uint32(words[i]) for i, d in varying.items()}
    n = last - first
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in start)
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(61):  # the last three steps do not reach the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        p, s = _PLACES[i], _SHIFTS[i]
        np.add(f, a, out=f)
        if p in whole:
            np.add(f, whole[p], out=f)
            np.add(f, np.uint32(_ADDED[i]), out=f)
        else:
            np.add(f, np.uint32((words[p] + _ADDED[i]) & _MASK), out=f)
        np.left_shift(f, np.uint32(s), out=g)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(start[0])).byteswap()
