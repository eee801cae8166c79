"""A hierarchical Pitman-Yor bigram model of the corpus, and every document's score by it.

Bigram restaurants (one for each preceding word) share the unigram restaurant as their
parent, whose base is the smoothed unigram distribution. Both levels have discount 1/2,
at which all that the sampler draws has a closed form, whatever the number of customers.

Documents are packed into blocks of token indices. Blocks, shards of bigrams and parts of
the vocabulary exchange sorted arrays of word numbers; each sweep of the sampler is two
exchanges between the shards and the parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import batches, mix, packs, release, span_hashes, texts, tokens
from .exchange import SCHEMA, array, bundle, pack, pack_steps, rows, squeeze, unbundle, unpack, unpack_steps
from .scratch import Scratch

#: Tokens of a block; bigrams that the blocks send to a shard; words that they send to a part of the vocabulary.
BLOCK, SHARD, PART = 1 << 19, 750_000, 750_000
#: Bytes of messages after which a worker gives its memory back.
LARGE = 1 << 21
#: A context with more tokens is dealt to several shards by the next word.
SPLIT = 1 << 20
_END = np.uint64(0x5851F42D4C957F2D)
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
_TEXT, _PAIRS, _WORDS, _ROOMS, _ASKED, _HEARD, _ACTIVE, _SUMS, _SPLIT, _VOCABULARY, _PARENT, _TOTALS = range(12)


@dataclass(frozen=True)
class Settings:
    """Strengths of the bigram and the unigram level, and the sampler's sweeps; both discounts are 1/2."""

    strength: float = 100.0
    parent_strength: float = 1000.0
    burn_in: int = 6
    samples: int = 4
    seed: int = 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


# The sampler


def draw_tables(customers: np.ndarray, rate: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn from P(t) in proportion to rate^t S(customers, t).

    S are the generalised Stirling numbers of discount 1/2, for which
    S(c, t + 1) / S(c, t) = 4 (c - t) / (t (2c - t - 1)). The draw goes from the mode
    upwards and downwards until a weight is below 1e-18 of the mode's, so its steps grow
    with the spread of t, not with the customers.
    """
    c, a = customers.astype(float), rate
    b = 2 * c - 1 + 4 * a
    mode = np.clip(np.floor(8 * a * c / (b + np.sqrt((2 * c - 1) ** 2 + 16 * a * a - 8 * a))) + 1, 1, c)
    out, total = mode.copy(), np.ones(len(c))
    for up in (True, False):
        at, t, w = np.arange(len(c)), mode, np.ones(len(c))
        while True:
            inside = np.flatnonzero((t < c[at] if up else t > 1) & (w > 1e-18))
            if not len(inside):
                break
            at, t, w = at[inside], t[inside], w[inside]
            x, y = c[at], a[at]
            if up:
                w = w * 4 * y * (x - t) / (t * (2 * x - t - 1))
                t = t + 1
            else:
                w = w * (t - 1) * (2 * x - t) / (4 * y * (x - t + 1))
                t = t - 1
            total[at] += w
            take = rng.random(len(at)) * total[at] < w
            out[at[take]] = t[take]
    return out.astype(np.int64)


def draw_masses(customers: np.ndarray, tables: np.ndarray, base: np.ndarray, gamma: float, rng: np.random.Generator) -> np.ndarray:
    """The parent's mass at each word, up to a common factor: that of its tables, and that of all dishes not yet served.

    Given gamma, words are independent; the second mass is that of a generalised gamma
    process of index 1/2 at the word's base, which is inverse Gaussian.
    """
    m = gamma * base
    served = customers > 0
    out = rng.wald(m / 2, m * m / 2)
    out[served] += rng.standard_gamma(customers[served] - tables[served] / 2)
    return out


# Blocks


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks: a = doc_id, its validity, number of tokens, held out; b = sorted word hashes; c = token indices; src = place of the end token."""
    part, seq = TaskContext.get().partitionId(), 0
    hashes, docs, size = [], [], 0

    def flush() -> pa.RecordBatch:
        vocabulary, index = np.unique(np.concatenate(hashes), return_inverse=True)
        return rows([((part << 32) + seq, _TEXT, int(np.searchsorted(vocabulary, _END)), squeeze(np.array(docs, "<i8")), vocabulary.astype("<u8").tobytes(), pack(index), None)])

    for b in batches(it):
        values, ids = [v.translate(_LOWER) for v in texts(b["text"])], b["doc_id"].to_pylist()
        for i, j in packs(values):
            buf, start, end, first = tokens(values[i:j])
            h = span_hashes(buf, start, end)
            hashes.append(np.insert(h, first[1:], _END))
            docs += [(0 if d is None else d, d is not None, n + 1, held_out(d)) for d, n in zip(ids[i:j], np.diff(first).tolist(), strict=True)]
            size += len(hashes[-1])
            if size >= BLOCK:
                yield flush()
                hashes, docs, size, seq = [], [], 0, seq + 1
    if docs:
        yield flush()
    del hashes, docs
    release()


def _sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for r in b.to_pylist():
            d = array(r["a"], "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"train": [int(d[d[:, 3] == 0, 2].sum())], "tokens": [int(d[:, 2].sum())], "words": [len(r["b"]) // 8]})


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts of the vocabulary are ranges of the hash."""
    return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _send_words(parts: int) -> Callable:
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                words, docs = np.frombuffer(r["b"], "<u8"), array(r["a"], "<i8").reshape(-1, 4)
                counts = np.bincount(unpack(r["c"])[np.repeat(docs[:, 3] == 0, docs[:, 2])], minlength=len(words))
                at = np.searchsorted(_part(words, parts), np.arange(parts + 1))
                yield rows([(int(k), _WORDS, r["dest"], words[at[k] : at[k + 1]].tobytes(), pack(counts[at[k] : at[k + 1]]), None, None) for k in np.flatnonzero(np.diff(at))])

    return send


def _number_words(group: pa.Table) -> pa.Table:
    """A part of the vocabulary: counts summed; to each block the numbers of its words within the part, and their counts."""
    asked = [(r, np.frombuffer(r["a"], "<u8")) for r in sorted(group.to_pylist(), key=lambda r: r["src"])]
    words, where = np.unique(np.concatenate([x for _, x in asked]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([unpack(r["b"]) for r, _ in asked]), len(words)).astype(np.int64)
    part, at = asked[0][0]["dest"], 0
    out = [(-1, _TOTALS, part, np.array([len(words), np.count_nonzero(counts)], "<i8").tobytes(), None, None, None), (part, _VOCABULARY, part, pack(counts), None, None, None)]
    for r, x in asked:
        i = where[at : at + len(x)]
        at += len(x)
        out.append((r["src"], _WORDS, part, pack_steps(i), pack(counts[i]), None, None))
    return pa.Table.from_batches([rows(out)])


def _name(bases: list[int], total: int, kinds: int) -> Callable:
    """A block with numbers for its words, the block's most frequent first, and with what the base says about its documents."""

    def name(group: pa.Table) -> pa.Table:
        data = group.to_pylist()
        text = next(r for r in data if r["kind"] == _TEXT)
        words = sorted((r for r in data if r["kind"] == _WORDS), key=lambda r: r["src"])  # ranges of the sorted hashes
        ids = np.concatenate([bases[r["src"]] + unpack_steps(r["a"]) for r in words])
        counts = np.concatenate([unpack(r["b"]) for r in words])
        docs, index = array(text["a"], "<i8").reshape(-1, 4), unpack(text["c"])
        first = np.cumsum(docs[:, 2]) - docs[:, 2]
        low = np.log10((counts + 1) / (total + kinds + 1))
        base, known = np.add.reduceat(low[index], first), np.add.reduceat((counts > 0).astype(np.int64)[index], first)
        order = np.lexsort((ids, -np.bincount(index, minlength=len(ids))))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        a = np.column_stack((docs, known, base.view("<i8")))
        return pa.Table.from_batches([rows([(text["dest"], _TEXT, int(place[text["src"]]), squeeze(a.astype("<i8")), pack_steps(ids[order]), pack(place[index]), pack(counts[order]))])])

    return name


class _Block:
    """A named block's documents, and its distinct bigrams in the order in which they are sent: by shard, context and word."""

    def __init__(self, r: dict, shards: int, split: int) -> None:
        self.docs = array(r["a"], "<i8").reshape(-1, 6)
        ids, index = unpack_steps(r["b"]), unpack(r["c"])
        order = np.argsort(ids)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.ids, self.counts = ids[order], unpack(r["d"])[order]
        index = place[index]
        n = self.docs[:, 2]
        self.first = np.cumsum(n) - n
        before = np.empty_like(index)
        before[1:] = index[:-1]
        before[self.first] = place[r["src"]]
        size = len(ids)
        pair, self.token_pair = np.unique(before * size + index, return_inverse=True)
        u, w = np.divmod(pair, size)
        pieces = (self.counts // split + 1).astype(np.uint64)[u]
        piece = mix(self.ids[w].astype(np.uint64)) % pieces
        shard = (mix(mix(self.ids[u].astype(np.uint64)) + piece) % np.uint64(shards)).astype(np.min_scalar_type(shards))
        by = np.argsort(shard, kind="stable")
        self.u, self.w = u[by], w[by]
        self.rank = np.empty_like(by)
        self.rank[by] = np.arange(len(by))
        self.uses = np.bincount(self.token_pair[np.repeat(self.docs[:, 3] == 0, n)], minlength=len(pair))[by]
        self.edges = np.searchsorted(shard[by], np.arange(shards + 1))


def _send_pairs(shards: int, split: int) -> Callable:
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                block, out = _Block(r, shards, split), []
                for k in np.flatnonzero(np.diff(block.edges)):
                    x = slice(int(block.edges[k]), int(block.edges[k + 1]))
                    u = block.u[x]
                    new = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                    follow = np.diff(np.concatenate((new, [len(u)])))
                    out.append((int(k), _PAIRS, r["dest"], pack_steps(block.ids[u[new]]), bundle([follow, block.counts[u[new]]]), pack(block.ids[block.w[x]]), pack(block.uses[x])))
                yield rows(out)
        release()

    return send


# Shards of bigrams


def _by_part(ids: np.ndarray, bases: list[int]) -> Iterator[tuple[int, slice]]:
    """Which of the sorted word numbers belong to each part of the vocabulary."""
    at = np.searchsorted(ids, bases + [np.iinfo(np.int64).max])
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), slice(int(at[k]), int(at[k + 1]))


def _seat_pairs(bases: list[int], words: int, split: int) -> Callable:
    """A shard's restaurants from what the blocks send, each customer at one table with its like.

    Rooms: all bigrams asked about, sorted. Heard: where among them a block's are. Asked:
    the words that the final answers need, and how many bigrams of one customer serve them.
    Active: the bigrams of several customers, whose tables vary.
    """

    def seat(group: pa.Table) -> pa.Table:
        data = sorted(group.to_pylist(), key=lambda r: r["src"])
        shard, keys, contexts = data[0]["dest"], [], {}
        for r in data:
            u, (follow, seen) = unpack_steps(r["a"]), unbundle(r["b"])
            keys.append(np.repeat(u, follow) * words + unpack(r["c"]))
            contexts[r["src"]] = (u, seen)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, np.concatenate([unpack(r["d"]) for r in data]), len(key)).astype(np.int64)
        out, at = [], 0
        for r, x in zip(data, keys, strict=True):
            out.append((shard, _HEARD, r["src"], pack_steps(where[at : at + len(x)]), None, None, None))
            at += len(x)
        context, w = np.divmod(key, words)
        u, first, follow = np.unique(context, return_index=True, return_counts=True)
        known, of = np.unique(np.concatenate([x for x, _ in contexts.values()]), return_index=True)
        seen = np.concatenate([x for _, x in contexts.values()])[of]
        assert len(known) == len(u)
        out.append((shard, _ROOMS, 0, pack_steps(u), bundle([follow, seen]), pack(w), pack(count)))
        kind, which = np.unique(w, return_inverse=True)
        lone = np.bincount(which[count == 1], minlength=len(kind))
        for k, x in _by_part(kind, bases):
            out.append((k, _ASKED, shard, pack_steps(kind[x]), pack(lone[x]), None, None))
        several = np.flatnonzero(count > 1)
        room, kept = np.repeat(np.arange(len(u)), follow)[several], seen >= split
        kept[room] = True
        ones = np.add.reduceat((count == 1).astype(np.int64), first)[kept]
        active = _Active(u[kept], ones, (seen[kept] >= split).astype(np.int64), (np.cumsum(kept) - 1)[room], w[several], count[several], np.ones(len(several), np.int64), [], [])
        out += active.rows(shard, bases)
        return pa.Table.from_batches([rows(out)])

    return seat


@dataclass
class _Active:
    """A shard's contexts with varying tables or with a part in other shards: their other tables, whether they are shared; the bigrams; samples so far."""

    contexts: np.ndarray
    ones: np.ndarray
    shared: np.ndarray
    room: np.ndarray
    words: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    samples: list[np.ndarray]
    #: Of each sample, the tables that the shared contexts have in all shards.
    totals: list[np.ndarray]

    @staticmethod
    def read(r: dict) -> "_Active":
        contexts, ones, shared, room = unbundle(r["a"])
        words, customers, tables = unbundle(r["b"])
        return _Active(np.cumsum(contexts), ones, shared, np.cumsum(room), words, customers, tables, unbundle(r["c"]), unbundle(r["d"]))

    def rows(self, shard: int, bases: list[int]) -> list[tuple]:
        """The state, and what the parts of the vocabulary are told: tables by word, and those of contexts in several shards."""
        state = (bundle([np.diff(self.contexts, prepend=0), self.ones, self.shared, np.diff(self.room, prepend=0)]), bundle([self.words, self.customers, self.tables]), bundle(self.samples), bundle(self.totals))
        out = [(shard, _ACTIVE, shard, *state)]
        kind, which = np.unique(self.words, return_inverse=True)
        sums = np.bincount(which, self.tables, len(kind)).astype(np.int64)
        out += [(k, _SUMS, shard, pack_steps(kind[x]), pack(sums[x]), None, None) for k, x in _by_part(kind, bases)]
        here = np.flatnonzero(self.shared)
        own = self.seated(self.tables)[here]
        return out + [(k, _SPLIT, shard, pack_steps(self.contexts[here][x]), pack(own[x]), None, None) for k, x in _by_part(self.contexts[here], bases)]

    def seated(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each context within the shard."""
        return self.ones + np.bincount(self.room, tables, len(self.ones)).astype(np.int64)


def _sum_splits(data: list[dict]) -> np.ndarray:
    found = sorted((r for r in data if r["kind"] == _SPLIT), key=lambda r: r["src"])
    return np.concatenate([unpack(r["b"]) for r in found]) if found else np.empty(0, np.int64)


def _sweep_pairs(s: Settings, sweep: int, bases: list[int]) -> Callable:
    """One Gibbs step for all tables of each bigram restaurant, given the parent's distribution.

    With y ~ Gamma(2 strength + tables) drawn for a context, the tables of its words are
    independent of each other, so all of them are drawn at once, and alike in every shard
    that holds a part of the context.
    """

    def sweep_shard(group: pa.Table) -> pa.Table:
        data = group.to_pylist()
        state = next(r for r in data if r["kind"] == _ACTIVE)
        active, shard = _Active.read(state), state["src"]
        rng = np.random.default_rng([s.seed, sweep, 0, shard])
        seated, totals = active.seated(active.tables), _sum_splits(data)
        here = np.flatnonzero(active.shared)
        seated[here] = totals
        y = rng.standard_gamma(2 * s.strength + seated)
        for k in here:
            y[k] = np.random.default_rng([s.seed, sweep, 2, int(active.contexts[k])]).standard_gamma(2 * s.strength + seated[k])
        answers = sorted((r for r in data if r["kind"] == _PARENT), key=lambda r: r["src"])
        parent = np.concatenate([np.frombuffer(r["a"], "<f8") for r in answers]) if answers else np.empty(0)
        if sweep > s.burn_in:
            active.totals.append(totals)
        which = np.unique(active.words, return_inverse=True)[1]
        active.tables = draw_tables(active.customers, y[active.room] / 2 * parent[which], rng)
        if sweep >= s.burn_in:
            active.samples.append(active.tables)
        return pa.Table.from_batches([rows(active.rows(shard, bases))])

    return sweep_shard


# Parts of the vocabulary


def _seat_words(s: Settings, sweep: int, bases: list[int], base_of: Callable, gamma: float) -> Callable:
    """The parent's customers, which are the bigrams' tables, and a Gibbs step for its own tables given gamma."""

    def seat(group: pa.Table) -> pa.Table:
        data = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["src"]))
        part, out = data[0]["dest"], []
        held = next(r for r in data if r["kind"] == _VOCABULARY)
        counts = unpack(held["a"])
        if held["b"] is None:  # customers that never vary: the bigrams that occur once
            lone = np.zeros(len(counts), np.int64)
            for r in data:
                if r["kind"] == _ASKED:
                    lone[unpack_steps(r["a"]) - bases[part]] += unpack(r["b"])
            samples = []
        else:
            lone, *samples = unbundle(held["b"])
        customers, asked = lone.copy(), []
        for r in data:
            if r["kind"] == _SUMS:
                at = unpack_steps(r["a"]) - bases[part]
                customers[at] += unpack(r["b"])
                asked.append((r["src"], at))
        rng, some = np.random.default_rng([s.seed, sweep, 1, part]), np.flatnonzero(customers > 1)
        tables = np.minimum(customers, 1)
        tables[some] = draw_tables(customers[some], gamma / 2 * base_of(counts[some]), rng)
        if sweep >= s.burn_in:
            samples += [customers, tables]
        ask = bundle([np.array([x for x, _ in asked], np.int64), np.array([len(x) for _, x in asked], np.int64), np.concatenate([x for _, x in asked]) if asked else np.empty(0, np.int64)])
        out.append((part, _VOCABULARY, part, held["a"], bundle([lone, *samples]), bundle([customers, tables]), ask))
        out.append((-1, _TOTALS, part, np.array([tables.sum(), customers.sum()], "<i8").tobytes(), None, None, None))
        splits = [(r["src"], unpack_steps(r["a"]), unpack(r["b"])) for r in data if r["kind"] == _SPLIT]
        if splits:
            u, where = np.unique(np.concatenate([x for _, x, _ in splits]), return_inverse=True)
            total, at = np.bincount(where, np.concatenate([n for _, _, n in splits]), len(u)).astype(np.int64), 0
            for shard, x, _ in splits:
                out.append((shard, _SPLIT, part, None, pack(total[where[at : at + len(x)]]), None, None))
                at += len(x)
        return pa.Table.from_batches([rows(out)])

    return seat


def _masses(r: dict, s: Settings, sweep: int, base_of: Callable, gamma: float) -> np.ndarray:
    counts, (customers, tables) = unpack(r["a"]), unbundle(r["c"])
    out, known = np.zeros(len(counts)), np.flatnonzero(counts)
    out[known] = draw_masses(customers[known], tables[known], base_of(counts[known]), gamma, np.random.default_rng([s.seed, sweep, 3, r["dest"]]))
    return out


def _mass_sums(s: Settings, sweep: int, base_of: Callable, gamma: float) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_pydict({"part": b["dest"], "mass": pa.array([_masses(r, s, sweep, base_of, gamma).sum() for r in b.to_pylist()], pa.float64())})

    return run


def _tell_masses(s: Settings, sweep: int, base_of: Callable, gamma: float, whole: float) -> Callable:
    """The parent's distribution, as drawn, to every shard that asks for some of it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                p, out, lo = _masses(r, s, sweep, base_of, gamma) / whole, [], 0
                shards, sizes, at = unbundle(r["d"])
                for shard, n in zip(shards.tolist(), sizes.tolist(), strict=True):
                    out.append((shard, _PARENT, r["dest"], p[at[lo : lo + n]].astype("<f8").tobytes(), None, None, None))
                    lo += n
                yield rows(out)

    return run


# The score


def _answer_words(bases: list[int]) -> Callable:
    """Each shard's words: their counts, and customers and tables of every sample."""

    def answer(group: pa.Table) -> pa.Table:
        data = group.to_pylist()
        held = next(r for r in data if r["kind"] == _VOCABULARY)
        table = [unpack(held["a"]), *unbundle(held["b"])[1:]]
        out = []
        for r in data:
            if r["kind"] == _ASKED:
                at = unpack_steps(r["a"]) - bases[r["dest"]]
                out.append((r["src"], _PARENT, r["dest"], bundle([x[at] for x in table]), None, None, None))
        return pa.Table.from_batches([rows(out)])

    return answer


def _answer_pairs(s: Settings, base_of: Callable, totals: list[tuple[int, int]]) -> Callable:
    """Each block's bigrams: the predictive probabilities, averaged over the samples of the seating."""

    def answer(group: pa.Table) -> pa.Table:
        data = group.to_pylist()
        rooms, active = (next(r for r in data if r["kind"] == k) for k in (_ROOMS, _ACTIVE))
        active = _Active.read(active)
        u, (follow, seen), w, count = unpack_steps(rooms["a"]), unbundle(rooms["b"]), unpack(rooms["c"]), unpack(rooms["d"])
        room, which = np.repeat(np.arange(len(u)), follow), np.unique(w, return_inverse=True)[1]
        answers = sorted((r for r in data if r["kind"] == _PARENT), key=lambda r: r["src"])
        words = [np.concatenate(x) for x in zip(*(unbundle(r["a"]) for r in answers), strict=True)]
        base, several, at = base_of(words[0]), np.flatnonzero(count > 1), np.searchsorted(u, active.contexts)
        p, ones = np.zeros(len(count)), np.bincount(room[count == 1], minlength=len(u))
        for k, ((kinds, customers), tables) in enumerate(zip(totals, active.samples, strict=True)):
            parent = (words[1 + 2 * k] - words[2 + 2 * k] / 2 + (s.parent_strength + kinds / 2) * base) / (s.parent_strength + customers)
            seated, own = ones.copy(), active.seated(tables)
            own[active.shared > 0] = active.totals[k] if k < len(active.totals) else _sum_splits(data)
            seated[at] = own
            left = np.minimum(count, 1)
            left[several] = tables
            p += (count - left / 2 + (s.strength + seated[room] / 2) * parent[which]) / (s.strength + seen[room])
        p = (p / len(active.samples)).astype("<f4")
        return pa.Table.from_batches([rows([(r["src"], _PAIRS, r["dest"], p[unpack_steps(r["a"])].tobytes(), None, None, None) for r in data if r["kind"] == _HEARD])])

    return answer


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(shards: int, split: int) -> Callable:
    def score(group: pa.Table) -> pa.Table:
        data = group.to_pylist()
        block = _Block(next(r for r in data if r["kind"] == _TEXT), shards, split)
        p = np.concatenate([np.frombuffer(r["a"], "<f4") for r in sorted((r for r in data if r["kind"] == _PAIRS), key=lambda r: r["src"])])
        d, value = block.docs, np.add.reduceat(np.log10(p.astype(float))[block.rank][block.token_pair], block.first)
        columns = [pa.array(d[:, 0], pa.int64(), mask=d[:, 1] == 0), pa.array(d[:, 3] == 1), pa.array(d[:, 2]), pa.array(d[:, 4]), pa.array(np.ascontiguousarray(d[:, 5]).view("<f8")), pa.array(value)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def _base(total: int, kinds: int) -> Callable:
    return lambda counts: (counts + 1) / (total + kinds + 1)


def score_documents(docs: DataFrame, settings: Settings = Settings(), *, split: int = SPLIT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    Learns from the documents whose crc32(doc_id as text) mod 7 is not 2; a null doc_id
    counts as the empty text there. Null and empty texts are one end token. A text's first
    token follows the end token. Repeated rows count and score each; without training
    tokens all probabilities are those of an unseen word. An empty table gives an empty
    result; other columns are ignored.

    The seating is sampled by blocked Gibbs steps. Given the parent's distribution, all
    tables of a bigram restaurant are drawn at once from their joint conditional; the
    bigrams' tables, summed over all shards after each sweep, are the customers of the one
    unigram restaurant; its tables are drawn given them, and then its distribution. No step
    depends on the number of shards or on the size of a restaurant, and a context with more
    than ``split`` tokens, which several shards hold, is one restaurant. After ``burn_in``
    sweeps, the predictive probabilities of ``samples`` seatings are averaged; they sum to
    one over the training words and one unseen word. Counts are exact; words are told apart
    by 64-bit hashes. The driver sees one row of totals for each part of the vocabulary.
    """
    spark, s = docs.sparkSession, settings
    scratch = Scratch(spark, "pitmanyor")
    blocks = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, SCHEMA), "blocks")
    sizes = blocks.mapInArrow(_sizes, "train long, tokens long, words long").agg(F.sum("train"), F.sum("tokens"), F.sum("words")).first()
    total, size, asked = (int(x or 0) for x in sizes)
    shards, parts = max(8, -(-size * 7 // 10 // SHARD)), max(8, -(-asked // PART))
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def grouped(df: DataFrame, groups: int, f: Callable, schema: str = SCHEMA) -> DataFrame:
        def run(group: pa.Table) -> pa.Table:
            out = f(group)
            if len(group) > 1 and group.nbytes > LARGE:
                release()
            return out

        return df.repartition(min(groups, max(session, 4096)), "dest").groupBy("dest").applyInArrow(run, schema)

    def of(df: DataFrame, *kinds: int) -> DataFrame:
        return df.where(F.col("kind").isin(*kinds))

    def summed(df: DataFrame) -> dict[int, np.ndarray]:
        return {r.src: np.frombuffer(r.a, "<i8") for r in of(df, _TOTALS).select("src", "a").toLocalIterator()}

    numbered = scratch.cut(grouped(blocks.mapInArrow(_send_words(parts), SCHEMA), parts, _number_words), "numbered")
    held = summed(numbered)
    words, kinds = (int(sum(x[k] for x in held.values())) for k in (0, 1))
    bases = np.concatenate(([0], np.cumsum([held[k][0] if k in held else 0 for k in range(parts)])[:-1])).astype(int).tolist()
    base_of = _base(total, kinds)
    count = max(8, blocks.count())
    named = scratch.cut(grouped(blocks.unionByName(of(numbered, _WORDS)), count, _name(bases, total, kinds)), "named")
    scratch.drop("blocks")
    rooms = scratch.cut(grouped(named.mapInArrow(_send_pairs(shards, split), SCHEMA), shards, _seat_pairs(bases, words, split)), "rooms")

    pairs, parent = of(rooms, _ACTIVE, _SUMS, _SPLIT), of(numbered, _VOCABULARY).unionByName(of(rooms, _ASKED))
    rng, found, gamma = np.random.default_rng([s.seed, 4]), [], 0.0
    for sweep in range(s.burn_in + s.samples):
        gamma = gamma or float(rng.standard_gamma(2 * s.parent_strength + kinds))
        seated = scratch.cut(grouped(parent.unionByName(of(pairs, _SUMS, _SPLIT)), parts, _seat_words(s, sweep, bases, base_of, gamma)), f"words{sweep}")
        tables, customers = (int(sum(x[k] for x in summed(seated).values())) for k in (0, 1))
        if sweep >= s.burn_in:
            found.append((tables, customers))
        parent = of(seated, _VOCABULARY)
        if sweep:
            scratch.drop(f"words{sweep - 1}")
        if sweep == s.burn_in + s.samples - 1:
            break
        gamma = float(rng.standard_gamma(2 * s.parent_strength + tables))
        m = gamma * float(base_of(0))  # of the one unseen word
        whole = float(rng.wald(m / 2, m * m / 2)) + (parent.mapInArrow(_mass_sums(s, sweep, base_of, gamma), "part long, mass double").agg(F.sum("mass")).first()[0] or 0.0)
        told = parent.mapInArrow(_tell_masses(s, sweep, base_of, gamma, whole), SCHEMA)
        pairs = scratch.cut(grouped(of(pairs, _ACTIVE).unionByName(told).unionByName(of(seated, _SPLIT)), shards, _sweep_pairs(s, sweep + 1, bases)), f"pairs{sweep + 1}")
        if sweep:
            scratch.drop(f"pairs{sweep}")

    heard = grouped(parent.unionByName(of(rooms, _ASKED)), parts, _answer_words(bases))
    heard = heard.unionByName(of(rooms, _ROOMS, _HEARD)).unionByName(of(pairs, _ACTIVE)).unionByName(of(seated, _SPLIT)) if size else heard
    answers = scratch.cut(grouped(heard, shards, _answer_pairs(s, base_of, found)), "answers")
    scratch.drop("rooms")
    scored = grouped(named.unionByName(answers), count, _score(shards, split), _RESULT)
    return scored.withColumn("train_tokens", F.lit(total).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
