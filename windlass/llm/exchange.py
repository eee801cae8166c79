"""Messages between blocks of documents and shards of a key space, as rows of packed arrays.

A block asks each shard about its keys in sorted order, and the shard answers in the
same order, so that neither keys nor positions travel back. What is sent is grouped by
destination; blocks, shards and so groups are of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "dest long, kind int, src long, a binary, b binary, c binary, d binary"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def rows(values: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*values, strict=True)) if values else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], ["dest", "kind", "src", "a", "b", "c", "d"])


def table(values: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows(values)])


def squeeze(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def array(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(expand(data), dtype)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane, in as many bytes as the largest takes."""
    x = np.ascontiguousarray(x, "<u8")
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + squeeze(x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def pack_steps(x: np.ndarray) -> bytes:
    """Integers as differences; sorted ones take little space."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return pack(np.abs(d) * 2 + (d < 0))


def unpack_steps(data: bytes) -> np.ndarray:
    z = unpack(data)
    return np.cumsum(np.where(z & 1, -(z >> 1), z >> 1))


def bundle(arrays: list[np.ndarray]) -> bytes:
    """Any number of arrays of non-negative integers."""
    packed = [pack(x) for x in arrays]
    return np.array([len(packed), *map(len, packed)], "<i8").tobytes() + b"".join(packed)


def unbundle(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    edges = (8 + 8 * n + np.cumsum(np.concatenate(([0], np.frombuffer(data, "<i8", n + 1)[1:])))).tolist()
    return [unpack(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
