"""Approximate nearest neighbours by inner product over learned partitions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import batches
from .sampling import hash_sample
from .scratch import Scratch

#: Numbers that the sample on the driver may hold, and its rows.
SAMPLE_NUMBERS, SAMPLE_ROWS = 1 << 22, 8192
#: Partitions, the least sample rows for each, and the rows beyond which one is cut again.
PARTS, LEAST, LEAF = 32, 64, 1 << 16
#: Rows of a partition that a task holds, queries that it compares with them, and queries scored at once.
SLICE, QUERIES, SCORED = 32_768, 32_768, 128
GRAPH, HIDDEN, EPOCHS = 10, 96, 30


def _top(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    out = []
    for lo in range(0, len(q), 1024):
        s = q[lo : lo + 1024] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[lo : lo + 1024]] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, x: np.ndarray, m: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of a neighbour graph.

    Starts from balanced nearest centres and then moves nodes to the part that holds
    most of their neighbours, best gains first, while that part has room.
    """
    n, most = len(x), -(-len(x) * 105 // (100 * m))
    part = np.full(n, -1)
    centres = x[rng.choice(n, m, replace=False)]
    for _ in range(8):
        score = x @ centres.T
        part[:], room = -1, np.full(m, most)
        for i in np.argsort(np.sort(score, 1)[:, -2] - score.max(1)) if m > 1 else range(n):
            for k in np.argsort(-score[i]):
                if room[k]:
                    part[i], room[k] = k, room[k] - 1
                    break
        centres = np.stack([x[part == k].mean(0) if (part == k).any() else centres[k] for k in range(m)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        near = np.bincount(np.concatenate((a * m + part[b], b * m + part[a])), minlength=n * m).reshape(n, m)
        best, size = near.argmax(1), np.bincount(part, minlength=m)
        gain = near[np.arange(n), best] - near[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer that gives a vector's probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Fit the parts' shares among each vector's neighbours with Adam."""
    d, m = x.shape[1], target.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, m)), np.zeros(m)]
    mean, var, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            xs, ys = x[order[lo : lo + 128]], target[order[lo : lo + 128]]
            hidden = np.maximum(xs @ p[0] + p[1], 0)
            error = (Router(*p)(xs) - ys) / len(xs)
            back = (error @ p[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((xs.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                g = g + 1e-5 * p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (1 - epoch / EPOCHS) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit_router(x: np.ndarray, *, parts: int, seed: int = 3) -> Router | None:
    """The exact neighbour graph of x is cut into balanced parts, and a classifier learns where a vector's neighbours lie; None for too few rows."""
    m = min(parts, len(x) // LEAST)
    if m < 2:
        return None
    rng = np.random.default_rng(seed)
    scale = np.linalg.norm(x, axis=1).mean()
    graph = _top(x, x, min(GRAPH, len(x) - 1), np.arange(len(x)))
    part = balanced_parts(graph, x / scale, m, rng)
    target = np.zeros((len(x), m))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.7 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.3
    router = train_router(x / scale, target, rng)
    router.w1 = router.w1 / scale
    return router


@dataclass
class Tree:
    """A router, and routers of its large parts; leaves are numbered part by part."""

    top: Router | None
    below: dict[int, Router]

    def __post_init__(self) -> None:
        self.parts = len(self.top.b2) if self.top else 1
        sizes = [len(self.below[p].b2) if p in self.below else 1 for p in range(self.parts)]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.leaves = int(self.first[-1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the leaves: those of the parts times those within them."""
        top = self.top(x) if self.top else np.ones((len(x), 1))
        return np.concatenate([top[:, p : p + 1] * (self.below[p](x) if p in self.below else 1) for p in range(self.parts)], 1)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.top(x).argmax(1) if self.top else np.zeros(len(x), np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        part = self.part(x)
        out = self.first[part]
        for p in np.unique(part):
            if p in self.below:
                mine = part == p
                out[mine] += self.below[p](x[mine]).argmax(1)
        return out


def leaves_for(tree: Tree, base: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """How many of its most probable leaves a query must search for the recall wanted of queries that fitted nothing."""
    if tree.leaves == 1 or not len(queries):
        return tree.leaves
    home, true, reached = tree.home(base), _top(base, queries, min(k, len(base))), []
    for lo in range(0, len(queries), 64):
        rank = np.argsort(np.argsort(-tree(queries[lo : lo + 64]), axis=1, kind="stable"), axis=1)
        reached.append(np.take_along_axis(rank, home[true[lo : lo + 64]], 1).ravel())
    reached = np.sort(np.concatenate(reached))
    return min(tree.leaves, int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]) + 1)


def _usable(v: Column, dim: int) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & good & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _homes(tree, dim: int, whole: bool) -> Callable:
    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = _matrix(b["v"], dim)
                at = tree.value.home(x) if whole else tree.value.part(x)
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(at.astype(np.int32))], ["vec_id", "v", "part"])

    return assign


def _fit_below(dim: int, parts: int) -> Callable:
    """A router for one part from its sample."""

    def fit(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        router = fit_router(_matrix(group.sort_by([("vec_id", "ascending")])["v"], dim), parts=parts, seed=3 + part)
        return pa.Table.from_pydict({"part": pa.array([part], pa.int32()), "router": pa.array([pickle.dumps(router)], pa.binary())})

    return fit


def _routes(tree, dim: int, probes: int, k: int, sizes: list[int]) -> Callable:
    """Each query goes to its most probable leaves, and on until they hold more than k rows."""

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array(sizes)
        for whole in it:
            for b in batches([whole], 256):
                order = np.argsort(-tree.value(_matrix(b["v"], dim)), axis=1, kind="stable")
                want = np.maximum(probes, (np.cumsum(size[order], 1) <= k).sum(1) + 1)
                row = np.repeat(np.arange(b.num_rows), np.minimum(want, order.shape[1]))
                part = np.concatenate([o[:n] for o, n in zip(order, want, strict=True)])
                yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(row)) for c in ("vec_id", "v", "key")), pa.array(part.astype(np.int32))], ["vec_id", "v", "key", "part"])

    return route


def _rerank(dim: int, k: int) -> Callable:
    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            q, c = _matrix(left["v"], dim), _matrix(right["v"], dim)
            qid, cid, key = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["key"].to_numpy()
            slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
            for lo in range(0, len(q), SCORED):
                s = q[lo : lo + SCORED] @ c.T
                s[qid[lo : lo + SCORED][:, None] == cid[None, :]] = -np.inf
                n = min(k, s.shape[1])
                floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                for i in range(len(s)):
                    at = np.flatnonzero((s[i] >= floor[i] - slack[lo + i]) & (s[i] > -np.inf))
                    exact = np.cumsum(c[at] * q[lo + i], axis=1)[:, -1]  # in the order of the components, so equal vectors score alike
                    best = np.lexsort((cid[at], -exact))[:k]
                    found.append((np.full(len(best), qid[lo + i]), np.full(len(best), key[lo + i]), cid[at][best], exact[best]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "key", "vec_id", "score"])

    return rank


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, parts: int = PARTS, recall: float = 0.97, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product found for each query row.

    ``queries`` is a condition on ``vec_id``. A bounded sample (chosen by hash) fits the
    index: its exact neighbour graph is cut into balanced parts, and a small classifier
    learns where a vector's neighbours lie. Every row goes to its most probable part. A part
    of more than ``leaf`` rows is cut again in the same way, by a sample of its own rows in
    a task of its own; so leaves grow in number with the table and not in size, up to
    ``parts`` x ``parts`` of them, whose routers are broadcast. A query goes to as many of
    its most probable leaves as reach the recall wanted for held-out queries within the
    sample. There all rows are compared, in slices of a leaf (so that a leaf with many rows,
    or many equal vectors, fills no task), with the leaf's queries in blocks; rows are sent
    once for each block of their own leaf. The best k are rescored exactly in double
    precision, component by component.

    Vectors that are null, zero, not of the most frequent length, or hold null or
    non-finite components take no part. A row is no candidate for queries of its own
    vec_id; repeated rows are candidates each, but ask once; rows of one vec_id with
    different vectors ask each for itself. Ties go to the smaller vec_id. A table
    with fewer than 2 x 64 usable rows is one part, so its result is exact; a null vec_id
    takes no part. An empty table gives an empty result; other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    lengths = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = max(1, lengths[0].n if lengths else 1)
    rows = rows.where(_usable(F.col("v"), dim))
    most = max(LEAST, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
    sample = hash_sample(rows, F.col("vec_id"), most).toArrow()
    x = _matrix(sample["v"], dim) if sample.num_rows else np.empty((0, dim))
    held, base = x[: min(len(x) // 8, 512)], x[min(len(x) // 8, 512) :]
    tree = Tree(fit_router(base, parts=parts), {})
    shared, schema = spark.sparkContext.broadcast(tree), "vec_id long, v array<double>, part int"
    homes = scratch.cut(rows.mapInArrow(_homes(shared, dim, False), schema), "homes")
    counted = {r.part: r["count"] for r in homes.groupBy("part").count().collect()}
    if large := {p: n for p, n in counted.items() if n > leaf}:
        share = F.element_at(F.create_map(*(F.lit(y) for p, n in large.items() for y in (p, min(1.0, 2 * most / n)))), F.col("part"))
        hashed = homes.where(F.col("part").isin(list(large))).withColumn("_h", F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 11) / float(1 << 53))
        first = F.row_number().over(Window.partitionBy("part").orderBy("_h", "vec_id"))
        some = hashed.where(F.col("_h") < share).withColumn("_r", first).where(F.col("_r") <= most).select("vec_id", "v", "part")
        fitted = some.groupBy("part").applyInArrow(_fit_below(dim, parts), "part int, router binary").collect()
        below = {r.part: router for r in fitted if (router := pickle.loads(r.router)) is not None}
        tree = Tree(tree.top, below)
        shared = spark.sparkContext.broadcast(tree)
        homes = scratch.cut(homes.select("vec_id", "v").mapInArrow(_homes(shared, dim, True), schema), "leaves")
        scratch.drop("homes")
        counted = {r.part: r["count"] for r in homes.groupBy("part").count().collect()}
    probes = leaves_for(tree, base, held, k, recall)
    sizes = [counted.get(p, 0) for p in range(tree.leaves)]
    distinct = homes.where(queries).select("vec_id", "v", F.xxhash64("v").alias("key")).dropDuplicates(["vec_id", "v"])
    asked = scratch.cut(distinct.mapInArrow(_routes(shared, dim, probes, k, sizes), "vec_id long, v array<double>, key long, part int"), "asked")
    cuts = {r.part: (max(1, -(-sizes[r.part] // SLICE)), -(-r["count"] // QUERIES)) for r in asked.groupBy("part").count().collect()}
    if not cuts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    slices, blocks = (F.element_at(F.create_map(*(F.lit(y) for p, c in cuts.items() for y in (p, c[i]))), F.col("part")) for i in (0, 1))
    dealt = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key", "vec_id"), blocks).cast("int")).withColumn("piece", dealt(slices))
    candidates = homes.where(F.col("part").isin(list(cuts))).withColumn("piece", F.pmod(F.xxhash64("vec_id", "v"), slices).cast("int")).withColumn("block", dealt(blocks))
    keys = ["part", "piece", "block"]
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_rerank(dim, k), "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
