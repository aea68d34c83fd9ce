"""Vectorised words of UTF-8 text blocks: spans and 64-bit hashes.

Word classes are sets of bytes; every byte of a multi-byte character is 0x80 or above, so a class that
holds all of those (or none) splits exactly as the same class over code points.
"""

from __future__ import annotations

import numpy as np

from slicewatch.llm.common import TextBlock

_U = np.uint64
#: ASCII upper case folded to lower, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: bytes) -> np.ndarray:
    """Lookup table: True for every byte outside ``excluded``."""
    lut = np.ones(256, dtype=bool)
    lut[list(excluded)] = False
    return lut


#: Words between ASCII white space.
NON_SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: Words of ASCII digits, letters and everything beyond ASCII (after lower-casing).
ALNUM = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator: a bijection that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _powers


def spans(block: TextBlock, lut: np.ndarray, lower: bool = True):
    """(bytes, word starts, word ends, text index of each word) of a block."""
    buf = LOWER[block.buf] if lower else block.buf
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return buf, z, z, z
    inside = lut[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.starts] = True
    edge[0] = edge[n] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(block.ends, starts, side="right")
    return buf, starts, ends, doc


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial over its bytes, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens), dtype=np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    pos = np.arange(int(first[-1] + lens[-1]), dtype=np.int64) - np.repeat(first, lens)
    at = pos + np.repeat(starts, lens)
    table = _power_table(int(lens.max()))
    vals = (buf[at].astype(np.uint64) + _U(1)) * table[pos]
    return mix(np.add.reduceat(vals, first) + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def of_word(word: str) -> int:
    """The hash that ``hashes`` gives to one word."""
    raw = np.frombuffer(word.encode("utf-8"), dtype=np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def shingles(h: np.ndarray, doc: np.ndarray, k: int):
    """Hashes of every ``k`` consecutive words of one text, with the word index where each starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * _U(0xA0761D6478BD642F) + h[j:j + n])
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return out[at], at
