"""Words and hashes of whole Arrow batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes whose hashes are built at once.
_SPAN = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64's finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, at least as many as asked for; not sent with functions."""

    def __init__(self) -> None:
        self.both: tuple[np.ndarray, ...] = (np.ones(1, U),)

    def __reduce__(self) -> tuple:
        return type(self), ()

    def __call__(self, n: int) -> tuple[np.ndarray, ...]:
        if len(self.both[0]) < n:
            size = max(_SPAN, n)
            self.both = (_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size))
        return self.both


_grown = _Powers()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (and the last ends)."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts; null texts have none.

    ``space``: for each byte value, whether it parts words instead (after lower-casing).
    ``start`` and ``end`` are byte positions in ``data``; ``first[i]`` is the number of
    text i's first word and ``first[i + 1]`` the one after its last.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, space: np.ndarray = _SPACE):
        data, self.at = raw(texts)
        self.data = _LOWER[data] if lower else data
        n = len(self.data)
        inside = ~space[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Which text each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, kept: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word. ``kept``: for each byte value, whether it counts."""
        out = np.empty(len(self), U)
        lo = 0
        while lo < len(self):
            begin = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, begin + _SPAN, "right")))
            part = self.data[begin : self.end[hi - 1]]
            s, e = self.start[lo:hi] - begin, self.end[lo:hi] - begin
            if kept is not None:
                keep = kept[part]
                place = np.concatenate([[0], np.cumsum(keep)])
                part, s, e = part[keep], place[s], place[e]
            powers, inverse = _grown(len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTE[part] * powers[: len(part)], out=total[1:])
            out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * _STEP)
            lo = hi
        return out


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours, also across texts: entry i is of i .. i+n-1."""
    out = h[: max(0, len(h) - n + 1)]
    for k in range(1, n):
        out = mix(out * U(_BASE) + h[k : len(h) - n + 1 + k] + U(k))
    return out


def runs_of_text(first: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` words that ``chained`` has, whether it lies in one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[: total - n + 1] == doc[n - 1 :]


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[pa.Array]:
    for name in names:
        yield batch.column(batch.schema.get_field_index(name))


def portions(batch: pa.RecordBatch, name: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts in column ``name`` have about ``size`` bytes, or one row."""
    (texts,) = columns(batch, name)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(batch):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
