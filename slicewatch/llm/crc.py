"""CRC-32 of many byte spans at once, equal to ``zlib.crc32`` of each."""

from __future__ import annotations

import zlib

import numpy as np

_U = np.uint32
#: Spans longer than this are left to ``zlib``, one by one.
LONG = 64


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & _U(1), (c >> _U(1)) ^ _U(0xEDB88320), c >> _U(1))
    return c


_TABLE = _table()


def crc32_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """CRC of ``buf[starts[i]:ends[i]]`` for every i, carried on from ``begin[i]`` if given (so that
    crc(a + b) = crc(b, begin=crc(a))). The spans advance one byte a step, longest first."""
    n = len(starts)
    crc = np.zeros(n, np.uint32) if begin is None else begin.astype(np.uint32)
    if not n:
        return crc
    lens = ends - starts
    for i in np.flatnonzero(lens > LONG):
        crc[i] = zlib.crc32(buf[starts[i]:ends[i]].tobytes(), int(crc[i]))
    short = np.flatnonzero(lens <= LONG)
    short = short[np.argsort(-lens[short], kind="stable")]
    at, left, state = starts[short], -lens[short], ~crc[short]
    for j in range(int(-left[0]) if len(left) else 0):
        m = int(np.searchsorted(left, -j, side="left"))      # spans that have a byte j
        c = state[:m]
        state[:m] = _TABLE[(c ^ buf[at[:m] + j]) & _U(0xFF)] ^ (c >> _U(8))
    crc[short] = ~state
    return crc


def crc32_byte(value: int, begin: np.ndarray) -> np.ndarray:
    """CRCs carried on by one and the same byte."""
    state = ~begin.astype(np.uint32)
    return ~(_TABLE[(state ^ _U(value)) & _U(0xFF)] ^ (state >> _U(8)))
