"""CRC-32 of many byte runs at once, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

_POLYNOMIAL = np.uint32(0xEDB88320)
#: Runs of more bytes are left to zlib, one by one.
_LONG = 64

START = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ _POLYNOMIAL, table >> 1)
    return table


_TABLE = _table()


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The registers ``state`` after the bytes ``data[start[i]:end[i]]``; ``~`` of a register is the CRC.

    Runs are taken by falling length, so that each step works on those that still have a byte.
    """
    length = end - start
    capped = np.minimum(length, _LONG + 1).astype(np.uint8)
    order = np.argsort(capped, kind="stable")[::-1]
    out = state[order].astype(np.uint32)
    begin = start[order]
    has = len(order) - np.cumsum(np.bincount(capped, minlength=_LONG + 2))  # has[k]: runs of more than k bytes
    long = int(has[_LONG])
    for i in range(long):
        part = data[begin[i] : end[order[i]]]
        out[i] = ~np.uint32(zlib.crc32(part, int(~out[i])))
    for k in range(_LONG):
        n = int(has[k])
        if n <= long:
            break
        own = out[long:n]
        out[long:n] = _TABLE[(own ^ data[begin[long:n] + k]) & 255] ^ (own >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each run."""
    return ~advanced(np.full(len(start), START), data, start, end)
