"""Removal of word passages that occur more than once in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import batches, decode_gaps, encode_gaps, mix, packs, release, span_hashes, texts, tokens, window_hashes
from .exchange import SCHEMA, array, expand, rows, squeeze, table
from .scratch import Scratch

#: The sketch: so many rows, at least so many cells a window, merged in blocks of 2**LOG2_BLOCK cells.
ROWS, CELLS, LOG2_BLOCK = 2, 4, 22
#: Words of a unit of documents; estimated repeats that the units send to a shard.
UNIT, SHARD = 2 << 20, 2_000_000
_TEXT, _ESTIMATE, _EXACT = range(3)
_SPACE = bytes(0x20 if c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D) else c for c in range(256))
_SALT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xFF51AFD7ED558CCD)]


def normal(value: bytes) -> bytes:
    """The words, unchanged, joined by one space."""
    value = value.translate(_SPACE).strip(b" ")
    return b" ".join(value.split()) if b"  " in value else value


def _windows(values: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of the texts, and their first words."""
    buf, start, end, first = tokens(values)
    h = window_hashes(span_hashes(buf, start, end), window)
    count = np.maximum(np.diff(first) - window + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return h[at], at


def _units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in units: a = doc_id, whether it is set, bytes; b = normal texts; c = number of windows of any length."""
    part, seq = TaskContext.get().partitionId(), 0
    docs, held, size = [], [], 0
    for batch in batches(it):
        for d, v in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
            v = normal(v)
            docs.append((0 if d is None else d, d is not None, len(v)))
            held.append(v)
            size += v.count(b" ") + 1
            if size >= UNIT:
                yield rows([((part << 32) + seq, _TEXT, size, squeeze(np.array(docs, "<i8")), squeeze(b"\n".join(held)), None, None)])
                docs, held, size, seq = [], [], 0, seq + 1
    if docs:
        yield rows([((part << 32) + seq, _TEXT, size, squeeze(np.array(docs, "<i8")), squeeze(b"\n".join(held)), None, None)])


class _Unit:
    """A unit's words and windows, and the order in which it asks about them."""

    def __init__(self, a: bytes, b: bytes, window: int, log2_width: int) -> None:
        self.docs, text, at, self.values = array(a, "<i8").reshape(-1, 3), expand(b), 0, []
        for n in self.docs[:, 2].tolist():
            self.values.append(text[at : at + n])
            at += n + 1
        self.buf, self.start, self.end, self.first = tokens(self.values)
        h, firsts = [], []
        for i, j in packs(self.values):
            w, at = _windows(self.values[i:j], window)
            h.append(w)
            firsts.append(at + self.first[i])
        self.at = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
        self.h = np.concatenate(h) if h else np.empty(0, np.uint64)
        self.window, self.log2_width = window, log2_width
        self.log2_block = min(LOG2_BLOCK, log2_width)

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows in order of their cells, these, and where each block's begin."""
        c = (mix(self.h ^ _SALT[row]) >> np.uint64(64 - self.log2_width)).astype(np.int64)
        order = np.argsort(c, kind="stable")
        c = c[order]
        return order, c, np.searchsorted(c, np.arange((1 << self.log2_width >> self.log2_block) + 1) << self.log2_block)

    def estimated(self, answers: list[dict]) -> np.ndarray:
        """Windows whose cells all have a count of two or more."""
        out, by = np.ones(len(self.h), bool), {r["src"]: r["a"] for r in answers}
        for row in range(ROWS):
            order, c, edges = self.cells(row)
            bits = np.zeros(len(c), bool)
            for k in np.flatnonzero(np.diff(edges)):
                n = edges[k + 1] - edges[k]
                bits[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(by[(row << 40) + int(k)], np.uint8), count=n)
            out[order[~bits]] = False
        return np.flatnonzero(out)

    def keys(self, some: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 128-bit hashes of these windows' words, sorted by shard; which of them each window has; where each shard's begin."""
        digest, at = xxhash.xxh3_128_digest, self.at[some]
        raw = b"".join([digest(self.buf[s:e]) for s, e in zip(self.start[at].tolist(), self.end[at + self.window - 1].tolist(), strict=True)])
        full = np.frombuffer(raw, "<u8").reshape(-1, 2)
        order = np.lexsort((full[:, 1], full[:, 0]))
        s = full[order]
        new = np.concatenate((np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]).any(1)))
        which = np.empty(len(s), np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = s[new]
        return distinct, which, np.searchsorted(_shard(distinct[:, 0], shards), np.arange(shards + 1))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _thrifty(f: Callable) -> Callable:
    """The same function of a group, after which the worker gives its memory back."""

    def run(group: pa.Table) -> pa.Table:
        out = f(group)
        release()
        return out

    return run


def _send_cells(window: int, log2_width: int) -> Callable:
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                unit = _Unit(r["a"], r["b"], window, log2_width)
                for row in range(ROWS):
                    _, c, edges = unit.cells(row)
                    yield rows([((row << 40) + int(k), _ESTIMATE, r["dest"], encode_gaps(c[edges[k] : edges[k + 1]] - (int(k) << unit.log2_block)), None, None, None) for k in np.flatnonzero(np.diff(edges))])

    return send


def _count_cells(group: pa.Table) -> pa.Table:
    """A block of the merged sketch; to each unit, for its cells in order, whether the count is two or more."""
    asked = [(r["src"], r["dest"], decode_gaps(r["a"])) for r in group.to_pylist()]
    counts = np.zeros(1 + max(int(c[-1]) for *_, c in asked), np.uint8)  # two stands for more
    for *_, c in asked:
        twice = c[1:][c[1:] == c[:-1]]
        counts[c] = np.minimum(counts[c] + 1, 2)
        counts[twice] = 2
    return table([(unit, _ESTIMATE, block, np.packbits(counts[c] == 2).tobytes(), None, None, None) for unit, block, c in asked])


def _send_keys(window: int, log2_width: int, shards: int) -> Callable:
    def send(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        text = next(r for r in parts if r["kind"] == _TEXT)
        unit = _Unit(text["a"], text["b"], window, log2_width)
        distinct, which, edges = unit.keys(unit.estimated([r for r in parts if r["kind"] == _ESTIMATE]), shards)
        more = np.bincount(which, minlength=len(distinct)) > 1
        return table([(int(k), _EXACT, text["dest"], distinct[edges[k] : edges[k + 1]].tobytes(), np.packbits(more[edges[k] : edges[k + 1]]).tobytes(), None, None) for k in np.flatnonzero(np.diff(edges))])

    return send


def _count_keys(group: pa.Table) -> pa.Table:
    """A shard of windows: to each unit, for its hashes in order, whether the window occurs more than once."""
    asked = group.to_pylist()
    keys = [np.frombuffer(r["a"], "<u8").reshape(-1, 2) for r in asked]
    full = np.concatenate(keys)
    own = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(k)) for r, k in zip(asked, keys, strict=True)]).astype(np.int64) + 1
    order = np.lexsort((full[:, 1], full[:, 0]))
    s = full[order]
    group_of = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).any(1).astype(np.int64))))
    several = np.empty(len(s), bool)
    several[order] = np.bincount(group_of, own[order])[group_of] > 1
    edges = np.cumsum([0] + [len(k) for k in keys])
    return table([(r["src"], _EXACT, r["dest"], np.packbits(several[a:b]).tobytes(), None, None, None) for r, a, b in zip(asked, edges[:-1], edges[1:], strict=True)])


def _remove(window: int, log2_width: int, shards: int, with_text: bool) -> Callable:
    def remove(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        text = next(r for r in parts if r["kind"] == _TEXT)
        unit = _Unit(text["a"], text["b"], window, log2_width)
        some = unit.estimated([r for r in parts if r["kind"] == _ESTIMATE])
        distinct, which, edges = unit.keys(some, shards)
        several = np.zeros(len(distinct), bool)
        for r in parts:
            if r["kind"] == _EXACT:
                a, b = edges[r["src"]], edges[r["src"] + 1]
                several[a:b] = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=b - a)
        at = unit.at[some][several[which]]
        cover = np.bincount(at, minlength=len(unit.start) + window + 1) - np.bincount(at + window, minlength=len(unit.start) + window + 1)
        gone = np.cumsum(cover)[: len(unit.start)] > 0
        total, removed, digests, kept = np.diff(unit.first), [], [], []
        for d, value in enumerate(unit.values):
            lo, hi = unit.first[d], unit.first[d + 1]
            cut = gone[lo:hi]
            removed.append(int(cut.sum()))
            if removed[-1]:
                value = b" ".join([unit.buf[s:e] for s, e in zip(unit.start[lo:hi][~cut].tolist(), unit.end[lo:hi][~cut].tolist(), strict=True)])
            digests.append(hashlib.sha256(value).hexdigest())
            kept.append(value.decode() if with_text else None)
        ids = pa.array(unit.docs[:, 0], pa.int64(), mask=unit.docs[:, 1] == 0)
        return pa.Table.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return remove


def remove_repeats(docs: DataFrame, *, window: int = 35, cells: int = CELLS, with_text: bool = True) -> DataFrame:
    """Remove each word that a repeated window covers.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept`` for every document; kept is
    the remaining words joined by one space (null unless with_text).

    Documents are packed into units once. Pass one: each unit sketches its windows and
    sends the sketch's cells, as sorted differences of about a byte each, to blocks of
    cells; these merge all units' sketches into one count-min sketch and answer with a bit a
    cell: two or more, or not. The sketch has ``cells`` cells a window in each of its
    rows, so its blocks grow in number with the corpus and not in size, nothing is
    broadcast, and the share of overestimates stays the same. It loses no repeated window.
    Pass two: only windows estimated repeated are sent on, as 128-bit hashes of their words,
    once a unit, and are counted exactly in shards; a window that occurs everywhere is one
    entry a unit. The answers, again bits, tell each unit what to remove.

    Windows are judged on the input. Texts shorter than a window lose nothing; null and
    empty texts have no words. Repeated rows count as occurrences each, so both lose
    their windows. A null doc_id is kept as it is; other columns are ignored; an empty
    table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "repeats")
    units = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_units, SCHEMA), "units")
    words = units.agg(F.sum("src")).first()[0] or 0  # with kind _TEXT, src is the number of words
    log2_width = max(16, int(cells * words).bit_length())
    shards = max(8, -(-words // (8 * SHARD)))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = units.mapInArrow(_send_cells(window, log2_width), SCHEMA).repartition(n, "dest")
    estimates = scratch.cut(asked.groupBy("dest").applyInArrow(_thrifty(_count_cells), SCHEMA), "estimates")
    keys = units.unionByName(estimates).groupBy("dest").applyInArrow(_thrifty(_send_keys(window, log2_width, shards)), SCHEMA)
    exact = scratch.cut(keys.groupBy("dest").applyInArrow(_thrifty(_count_keys), SCHEMA), "exact")
    everything = units.unionByName(estimates).unionByName(exact)
    out = everything.groupBy("dest").applyInArrow(_thrifty(_remove(window, log2_width, shards, with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else scratch.cut(out, "out")
