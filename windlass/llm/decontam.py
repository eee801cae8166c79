"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard's array orders all its suffixes by their words. Every suffix of every benchmark
item is searched in it: where it would stand, its neighbours hold its longest verbatim
match. Words are compared by 64-bit hashes and what is found by the words themselves.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import packs, release, span_hashes, spans, texts
from .scratch import Scratch

#: Benchmark text that a task holds at once; a larger benchmark is worked off block by block.
BLOCK_BYTES = 16 << 20
#: Text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:0x100] = 1
_SCHEMA = "doc_id long, text_key long, n_words long, starts array<int>, ends array<int>, items array<string>, longest int, longest_at int"


def words(value: bytes) -> list[bytes]:
    value = value.translate(_LOWER)
    return [value[s:e] for s, e in zip(*spans(value, _WORD), strict=True)]


def _hashed(values: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined lower-case bytes, the words' starts and ends in them, each value's first word, and the words' hashes, none of them 0."""
    low = [v.translate(_LOWER) for v in values]
    buf = b"\n".join(low)
    start, end = spans(buf, _WORD)
    return buf, start, end, np.searchsorted(start, np.cumsum([0] + [len(v) + 1 for v in low])), span_hashes(buf, start, end) | np.uint64(1)


class Items:
    """A block of benchmark items: their words, and each item's windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.names = [name for name, _ in items]
        self.buf, self.start, self.end, first, h = _hashed([text for _, text in items])
        size = np.diff(first)
        self.item, self.left = np.repeat(np.arange(len(items)), size), np.repeat(first[1:], size) - np.arange(len(h))
        self.longest = int(size.max()) if len(size) else 0
        self.words = np.concatenate((h, np.zeros(self.longest + 1, np.uint64)))
        #: Words of the window that begins at a place; 0 where none does.
        self.window = np.where(self.left >= window, window, np.where(self.left == np.repeat(size, size), self.left, 0))


class SuffixArray:
    """All suffixes of a shard's texts in the order of their words' hashes, to a depth of at least so many words.

    By prefix doubling: suffixes ordered by k words are ordered by 2k with the ranks of the
    suffixes k words on; only those still tied are sorted again.
    """

    def __init__(self, values: list[bytes], depth: int) -> None:
        self.buf, self.start, self.end, self.first, h = _hashed(values)
        n = len(h)
        # One 0 after each text ends its suffixes.
        place = np.arange(n) + np.repeat(np.arange(len(values)), np.diff(self.first))
        size = n + len(values)
        self.words = np.zeros(size + depth + 1, np.uint64)
        self.words[place] = h
        self.word = np.cumsum(self.words != 0) - 1
        kinds, rank = np.unique(self.words[:size], return_inverse=True)
        follow = np.zeros_like(rank)
        follow[:-1] = rank[1:]
        key = rank * len(kinds) + follow
        self.array = np.argsort(key)
        key, k = key[self.array], 2
        rank = np.empty(size + 1, np.int64)
        rank[size] = -1
        tied = np.arange(size)
        while True:
            # The suffixes at these places of the array; equal keys stand together.
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
            head = tied[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else tied
            rank[self.array[tied]] = head
            alone = new & np.concatenate((new[1:], [True])) if len(new) else new
            tied, head = tied[~alone], head[~alone]
            if k >= depth or not len(tied):
                break
            at = self.array[tied]
            key = head * (size + 1) + rank[np.minimum(at + k, size)] + 1
            order = np.argsort(key)
            self.array[tied], key = at[order], key[order]
            k *= 2
        # The 0s come first and begin nothing.
        self.array = self.array[len(values) :]

    def search(self, items: Items, at: np.ndarray, size: np.ndarray, after: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the runs of words at places of the items would stand, before or after their equals, and how many words they share with the suffix before and after that place."""
        first = self.words[self.array]
        lo, hi = np.searchsorted(first, items.words[at], "left"), np.searchsorted(first, items.words[at], "right")
        before, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(some := np.flatnonzero(lo < hi)):
            middle = (lo[some] + hi[some]) // 2
            p, q, n = self.array[middle], at[some], size[some]
            same = np.maximum(1, np.minimum(before[some], behind[some]))
            on = np.arange(len(some))
            while len(on):
                on = on[(same[on] < n[on]) & (self.words[p[on] + np.minimum(same[on], n[on])] == items.words[q[on] + np.minimum(same[on], n[on])])]
                same[on] += 1
            less = self.words[p + np.minimum(same, n)] < items.words[q + np.minimum(same, n)]
            right = np.where(same >= n, after, less)
            lo[some[right]], before[some[right]] = middle[right] + 1, same[right]
            hi[some[~right]], behind[some[~right]] = middle[~right], same[~right]
        return lo, before, behind

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Of every suffix of the items, the words of its longest verbatim match and its place in words (-1 without one)."""
        at = np.arange(len(items.left))
        place, before, behind = self.search(items, at, items.left)
        n, found = np.maximum(before, behind), np.full(len(at), -1)
        some = np.flatnonzero(n)
        found[some] = self.word[self.array[place[some] - (before[some] >= behind[some])]]
        return n, found

    def hits(self, items: Items, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place of every window of the items, given their suffixes' longest matches: words of the shard, places of the items."""
        at = np.flatnonzero((items.window > 0) & (n >= items.window))
        lo, hi = (self.search(items, at, items.window[at], after)[0] for after in (False, True))
        count = hi - lo
        which = np.repeat(at, count)
        found = self.word[self.array[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]]
        same = np.fromiter((all(self.buf[self.start[p + k] : self.end[p + k]] == items.buf[items.start[q + k] : items.end[q + k]] for k in range(m)) for p, q, m in zip(found.tolist(), which.tolist(), items.window[which].tolist(), strict=True)), bool, len(which))
        return found[same], which[same]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals sorted by start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))]


def _runs(doc: np.ndarray, word: np.ndarray, place: np.ndarray, size: np.ndarray, window: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and first word of the longest run that each document shares with an item, the first of equals; windows that follow each other in both are one run."""
    order = np.lexsort((word, word - place, size == window, doc))
    doc, word, place, size = doc[order], word[order], place[order], size[order]
    joins = (doc[1:] == doc[:-1]) & (word[1:] == word[:-1] + 1) & (place[1:] == place[:-1] + 1) & (size[1:] == window) & (size[:-1] == window)
    begin = np.flatnonzero(np.concatenate(([True], ~joins))) if len(doc) else np.empty(0, np.int64)
    length = size[begin] + np.diff(np.concatenate((begin, [len(doc)]))) - 1
    longest, at = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    best = np.lexsort((-word[begin], length))  # the last written stays
    longest[doc[begin][best]], at[doc[begin][best]] = length[best], word[begin][best]
    return longest, at


@lru_cache(maxsize=1)
def _items(path: str, window: int) -> Items:
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as f:
        return Items(pickle.loads(f.read()), window)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[list[str], int]:
    """Files in the shared folder with about block_bytes of the items each, and the words of the longest item."""
    from pyarrow import fs

    uri = Scratch(benchmark.sparkSession, "benchmark").path
    system, root = fs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    paths, some, size, longest = [], [], 0, 0

    def flush() -> None:
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{root}/{name}") as f:
            f.write(pickle.dumps(some))
        paths.append(f"{uri}/{name}")

    for r in items.toLocalIterator():
        some.append((r.item, bytes(r.text)))
        size, longest = size + len(r.text), max(longest, len(words(bytes(r.text))))
        if size >= block_bytes:
            flush()
            some, size = [], 0
    if some or not paths:
        flush()
    return paths, longest


def _shard_hits(array: SuffixArray, blocks: list[str], window: int) -> Iterator[tuple[Items, np.ndarray, np.ndarray]]:
    for path in blocks:
        items = _items(path, window)
        yield items, *array.hits(items, array.longest(items)[0])


def _report(array: SuffixArray, docs: int, blocks: list[str], window: int) -> Iterator[tuple[int, list, list, list[str], int, int]]:
    """Of each document of a shard: its words, merged spans, items, and the longest run with its first word."""
    starts, ends, names = ([[] for _ in range(docs)] for _ in range(3))
    longest, at = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for items, word, place in _shard_hits(array, blocks, window):
        doc = np.searchsorted(array.first, word, "right") - 1
        word, size = word - array.first[doc], items.window[place]
        n, first = _runs(doc, word, place, size, window, docs)
        better = (n > longest) | ((n == longest) & (first < at))
        longest, at = np.where(better, n, longest), np.where(better, first, at)
        order = np.lexsort((word, doc))
        doc, word, place, size = doc[order], word[order], place[order], size[order]
        edges = np.searchsorted(doc, np.arange(docs + 1))
        for d in np.flatnonzero(np.diff(edges)):
            x = slice(edges[d], edges[d + 1])
            starts[d].append(word[x])
            ends[d].append(word[x] + size[x])
            names[d] += {items.names[i] for i in np.unique(items.item[place[x]])}
    for d, n in enumerate(np.diff(array.first).tolist()):
        s, e = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts[d], ends[d]))
        order = np.argsort(s, kind="stable")
        s, e = _merged(s[order], e[order])
        yield n, s.tolist(), e.tolist(), sorted(set(names[d])), int(longest[d]), int(at[d])


def _shards(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int | None], list[int]]]:
    """Rows until their texts reach SHARD_BYTES, whatever the batches."""
    values, ids, keys, size = [], [], [], 0
    for b in it:
        found = texts(b["text"])
        for v, d, k in zip(found, b["doc_id"].to_pylist(), b["text_key"].to_pylist(), strict=True):
            values.append(v)
            ids.append(d)
            keys.append(k)
            size += len(v) + 1
            if size >= SHARD_BYTES:
                yield values, ids, keys
                values, ids, keys, size = [], [], [], 0
    if values:
        yield values, ids, keys


_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.int32())


def _scanner(blocks: list[str], depth: int, window: int) -> Callable:
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, ids, keys in _shards(it):
            rows = [(d, k, *found) for d, k, found in zip(ids, keys, _report(SuffixArray(values, depth), len(values), blocks, window), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], ["doc_id", "text_key", "n_words", "starts", "ends", "items", "longest", "longest_at"])
        release()

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which documents hold windows of benchmark items, and where.

    Returns a row for each document: ``doc_id, text_key, n_words, n_hit, n_items,
    items_sha256, contaminated`` and ``starts, ends`` (merged spans of hit words),
    ``items`` (ids as text, sorted), ``longest`` and ``longest_at`` (words of
    the longest run shared with one item, and its first word; 0 where there is none).

    Each shard (about 4 MB of text) gets a suffix array over all its words, ordered to the
    length of the longest item. Every suffix of every item is found in it by binary search
    with its longest verbatim match; where that is a window or more, all places of the
    window are. Documents are scanned once and are not shuffled; memory is bounded by a
    shard and a block of the benchmark, which tasks read from the shared folder in turn.

    An item with fewer words than a window is one window; one without words, or with
    null text, has none. Null or empty text has no words. A null item_id counts as the
    text "null"; equal item_ids count once. Repeated documents each have their row.
    An empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found = rows.mapInArrow(_scanner(*_blocks(benchmark, window, block_bytes), window), _SCHEMA)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "text_key", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "starts", "ends", "items", "longest", "longest_at"
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, words, item_at, doc_id, doc_at``: each item's longest verbatim match in the documents.

    item_at and doc_at are the match's first words in the item and the document. Of equal
    matches it is that of the least doc_id (null first), then doc_at, then item_at. Items
    of one id are one item; one that shares no word has no row. Each shard gives one row an
    item. Null and empty texts have no words; a null item_id counts as the text "null".
    """
    blocks, depth = _blocks(benchmark, 1, block_bytes)
    schema = "item_id string, words long, item_at long, doc_id long, doc_at long"

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, ids, _ in _shards(it):
            array = SuffixArray(values, depth)
            for path in blocks:
                items = _items(path, 1)
                # Of equal matches, the least document: all places of the best suffixes.
                n, _ = array.longest(items)
                best = np.zeros(len(items.names), np.int64)
                np.maximum.at(best, items.item, n)
                at = np.flatnonzero((n > 0) & (n == best[items.item]))
                lo, hi = (array.search(items, at, n[at], after)[0] for after in (False, True))
                which = np.repeat(at, hi - lo)
                word = array.word[array.array[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)]).astype(int)]] if len(at) else at
                doc = np.searchsorted(array.first, word, "right") - 1
                least = {}
                for q, w, d in zip(which.tolist(), (word - array.first[doc]).tolist(), doc.tolist(), strict=True):
                    item = int(items.item[q])
                    row = (ids[d] is not None, ids[d] or 0, w, q - int(np.searchsorted(items.item, item)))
                    least[item] = min(least.get(item, row), row)
                rows = [(items.names[i], int(best[i]), at, d if named else None, w) for i, (named, d, w, at) in least.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), *[pa.int64()] * 4), strict=True)], ["item_id", "words", "item_at", "doc_id", "doc_at"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("text_key"))
    order = F.struct((-F.col("words")).alias("n"), "doc_id", "doc_at", "item_at")
    best = rows.mapInArrow(scan, schema).groupBy("item_id").agg(F.min(order).alias("m"))
    return best.select("item_id", (-F.col("m.n")).alias("words"), "m.item_at", "m.doc_id", "m.doc_at")


def _holds(blocks: list[str], depth: int, window: int) -> Column:
    def holds(text: pa.Array) -> pa.Array:
        values, out = texts(text), []
        for i, j in packs(values, SHARD_BYTES):
            array, hit = SuffixArray(values[i:j], depth), np.zeros(j - i, bool)
            for _, word, _ in _shard_hits(array, blocks, window):
                hit[np.searchsorted(array.first, word, "right") - 1] = True
            out += hit.tolist()
        return pa.array(out, pa.bool_())

    return F.arrow_udf(holds, "boolean")("text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which :func:`contamination` finds nothing; odd rows and empty tables as there."""
    return docs.where(~_holds(*_blocks(benchmark, window, block_bytes), window))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
