"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import PUNCT_TABLE, batches, packs, release, span_hashes, texts, tokens, window_hashes
from .sampling import hash_sample
from .scratch import RUN, Scratch, settings

#: Buckets of unigrams and bigrams; counts travel in blocks of 2**LOG2_BLOCK.
LOG2_BUCKETS, LOG2_BLOCK = 12, 10
#: Labelled documents that may fit the target model, chosen by hash.
LABELLED = 20_000
#: The raw model's weight in the target model: so many n-grams for each bucket, and this share of the target's own.
PRIOR, SHARE = 128.0, 0.5
#: Keys are compared in steps of 2**-STEP from -2**OFFSET on, 48 bits in all.
OFFSET, STEP = 27, 20
SEED = 11


def ngrams(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all uni- and bigrams, and the value each belongs to.

    Tokens are runs of letters and digits, and runs of other signs, in their own case.
    A token that follows itself is one bigram, whatever the token.
    """
    buf, start, end, first = tokens(values, PUNCT_TABLE)
    h = span_hashes(buf, start, end)
    doc = np.repeat(np.arange(len(values)), np.diff(first))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = window_hashes(h, 2)[pair] if len(h) > 1 else np.empty(0, np.uint64)
    two[h[pair] == h[pair + 1]] = 0
    shift = np.uint64(64 - LOG2_BUCKETS)
    return np.concatenate((h >> shift, two >> shift)).astype(np.int64), np.concatenate((doc, doc[pair]))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target model's probability of each bucket over the raw model's.

    The target model is mixed with the raw one, so that a bucket of which the target
    documents say little is neutral; otherwise a long text's sum would be that of the
    errors of many rare buckets.
    """
    p, own = np.maximum(raw, 1) / max(1.0, raw.sum()), target.sum()
    mixed = PRIOR * len(raw) + SHARE * own
    return np.log((target + mixed * p) / (own + mixed)) - np.log(p)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-gram counts, raw (kind 0) and of target documents (kind 1), in blocks."""
    total = np.zeros((2, 1 << LOG2_BUCKETS), np.int64)
    for b in batches(it):
        values, good = texts(b["text"]), np.array([bool(x) for x in b["good"].to_pylist()])
        for i, j in packs(values):
            bucket, doc = ngrams(values[i:j])
            total[0] += np.bincount(bucket, minlength=total.shape[1])
            if good[i:j].any():
                total[1] += np.bincount(bucket[good[i:j][doc]], minlength=total.shape[1])
    release()
    rows = [(kind << 32 | k, block.tobytes()) for kind in (0, 1) for k, block in enumerate(total[kind].reshape(-1, 1 << LOG2_BLOCK)) if block.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "counts"])


def _add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in it:
        for k, data in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])


def _scorer(ratio) -> Callable:
    def score(text: pa.Array) -> pa.Array:
        r, values = ratio.value, texts(text)
        n, s = np.zeros(len(values), np.int64), np.zeros(len(values))
        for i, j in packs(values):
            bucket, doc = ngrams(values[i:j])
            n[i:j] = np.bincount(doc, minlength=j - i)
            s[i:j] = np.bincount(doc, r[bucket], minlength=j - i)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(s)], ["n", "s"])

    return F.arrow_udf(score, "struct<n:long,s:double>")


@dataclass
class QualityModel:
    """What decides on a document: the n-grams' log ratios and the key's cut."""

    ratio: object
    cut: int = 0

    def scores(self, docs: DataFrame) -> DataFrame:
        """docs with ``n_grams, log_weight`` and ``code`` (the key in steps)."""
        scored = docs.withColumn("_s", _scorer(self.ratio)("text")).withColumns({"n_grams": F.col("_s.n"), "log_weight": F.col("_s.s")}).drop("_s")
        return scored.withColumn("code", _code(F.col("log_weight") + gumbel(F.col("doc_id"))))

    def kept(self) -> Column:
        return (F.col("n_grams") > 0) & (F.col("code") >= self.cut)


def gumbel(key: Column) -> Column:
    """Gumbel noise that depends on the key alone, so reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _code(key: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << 48) - 1), F.floor((key + float(1 << OFFSET)) * float(1 << STEP)).cast("long"))).cast("long")


def _cut(codes: DataFrame, k: int) -> int:
    """The k-th largest code: a histogram of its highest 16 bits, then of the next in the bucket at the boundary, then of the last."""
    prefix, left = 0, k
    for shift in (32, 16, 0):
        bucket = F.shiftright("code", shift)
        part = codes if shift == 32 else codes.where(F.shiftright("code", shift + 16) == prefix)
        for b, n in sorted((tuple(r) for r in part.groupBy(bucket.alias("b")).count().collect()), reverse=True):
            prefix = b
            if n >= left:
                break
            left -= n
    return prefix


def fit_quality(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, scratch: Scratch | None = None) -> tuple[QualityModel, DataFrame]:
    """Fit the models on ``docs`` and ``labels`` (doc_id, quality); also gives all documents' scores.

    The raw model counts the n-grams of all documents; the target model those of good
    documents among at most ``labelled`` labelled ones. A document's log importance weight
    is the sum of its n-grams' log ratios. As many are kept as the sum of min(1, weight):
    a document at least as likely under the target counts once, another in proportion.
    They are those of largest log weight plus Gumbel noise, which samples without
    replacement in proportion to the weights. Nothing is sorted.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.min("quality").alias("quality"))
    known = scratch.cut(known, "labels")
    known = scratch.cut(hash_sample(known, F.col("d"), labelled), "known")
    marked = rows.join(F.broadcast(known), F.col("doc_id") == F.col("d"), "left")  # at most `labelled` rows of 12 bytes
    parts = marked.select("text", (F.col("quality") == 1).alias("good")).mapInArrow(_count, "block long, counts binary")
    counts = np.zeros((2, 1 << LOG2_BUCKETS), np.int64)
    with settings(spark, RUN):
        sums = parts.repartition(16, "block").mapInArrow(_add, "block long, counts binary").collect()
    for r in sums:
        counts[r.block >> 32].reshape(-1, 1 << LOG2_BLOCK)[r.block & 0xFFFFFFFF] = np.frombuffer(r.counts, np.int64)
    model = QualityModel(spark.sparkContext.broadcast(log_ratio(counts[1].astype(float), counts[0].astype(float))))
    scores = scratch.cut(model.scores(rows).select("doc_id", "n_grams", "log_weight", "code"), "scores")
    if counts[1].any():
        k = scores.where("n_grams > 0").agg(F.round(F.sum(F.exp(F.least(F.lit(0.0), "log_weight")))).cast("long")).first()[0] or 0
        model.cut = _cut(scores.where("n_grams > 0").select("code"), k) if k else 1 << 48
    return model, scores


def quality_scores(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> DataFrame:
    """``doc_id, n_grams, log_weight, kept`` for every document.

    Null and empty texts have no n-grams and are not kept. Documents with equal doc_id and
    text share their noise and are kept or left together. A label that is null or not 0
    or 1 is ignored; of several for a document the worst counts. Without good labelled
    documents there is nothing to tell by, and every document with text is kept. An empty
    table gives an empty result; other columns are ignored.
    """
    model, scores = fit_quality(docs, labels, labelled=labelled)
    return scores.select("doc_id", "n_grams", "log_weight", model.kept().alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> DataFrame:
    """The documents that :func:`quality_scores` keeps, with their own columns; odd rows and empty tables as there."""
    model, _ = fit_quality(docs, labels, labelled=labelled)
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return model.scores(own).where(model.kept()).select("row.*")
