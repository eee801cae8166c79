"""Vectorised tokenising and hashing of UTF-8 bytes.

Documents are joined into packs of about a megabyte so that NumPy's cost per call
is spread over many short texts; a text above that size is a pack of its own, and
its hashes are computed slice by slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

PACK = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
_BASE = 0xD6E8FEB86659FD93
_WORD_BASE = 0xA0761D6478BD642F

#: The six ASCII white-space bytes; class 0 is "not part of a token".
SPACE_TABLE = np.ones(256, np.uint8)
SPACE_TABLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

#: Runs of alphanumerics (and all of non-ASCII) and runs of other signs are tokens of their own.
PUNCT_TABLE = np.full(256, 2, np.uint8)
PUNCT_TABLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    PUNCT_TABLE[_lo:_hi] = 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up, self.down = (np.full(self.n + 1, b, np.uint64) for b in (self.base, self.inverse))
            for p in (self.up, self.down):
                p[0] = 1
                np.cumprod(p, out=p)
        return self.up, self.down


_bytes, _words = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spans(buf: bytes, table: np.ndarray = SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero class."""
    if not buf:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = table[np.frombuffer(buf, np.uint8)]
    edges = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
    start, end = edges[:-1], edges[1:]
    keep = c[start] != 0
    return start[keep], end[keep]


def span_hashes(buf: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs: equal for equal runs, wherever they stand."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PACK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _bytes.get(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((np.frombuffer(buf, np.uint8, hi - lo, lo).astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        out[i:j] = (sums[end[i:j] - lo] - sums[start[i:j] - lo]) * down[start[i:j] - lo]
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values of h."""
    out = np.empty(max(0, len(h) - n + 1), np.uint64)
    for lo in range(0, len(out), 1 << 17):
        m = min(1 << 17, len(out) - lo)
        up, down = _words.get(m + n)
        sums = np.zeros(m + n, np.uint64)
        np.cumsum(h[lo : lo + m + n - 1] * up[: m + n - 1], out=sums[1:])
        out[lo : lo + m] = (sums[n : n + m] - sums[:m]) * down[:m]
    return mix(out)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def packs(values: list[bytes], limit: int = PACK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of values that together have about limit bytes."""
    i, size = 0, 0
    for j, v in enumerate(values):
        size += len(v) + 1
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(values):
        yield i, len(values)


def tokens(values: list[bytes], table: np.ndarray = SPACE_TABLE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the tokens' starts and ends in them, and each value's first token (with the number of tokens last)."""
    buf = b"\n".join(values)
    start, end = spans(buf, table)
    firsts = np.cumsum([0] + [len(v) + 1 for v in values])
    return buf, start, end, np.searchsorted(start, firsts)


#: What workers keep from task to task, by how to forget it.
KEPT: list[Callable[[], None]] = []


def release(keep: bool = False) -> None:
    """Give freed memory back at a task's end: workers live on, and wait for other tasks, of which most need nothing that is kept."""
    for forget in [] if keep else KEPT:
        forget()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def batches(it: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode_gaps(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as differences of a byte each; 255 adds 255 and goes on."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    more = gaps // 255
    out = np.full(int(more.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]
