"""SimHash fingerprints and their near-duplicate classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import batches, packs, release, texts, tokens
from .components import components
from .scratch import Scratch

#: Segments of four bits; their bit counts are the coordinates of the grid.
SEGMENTS, SEGMENT_BITS = 16, 4
#: Cells with more fingerprints are linked through flipped bits instead of pairs.
CROWD = 32
_PLAIN = bytearray(range(256))
_PLAIN[0x41:0x5B] = range(0x61, 0x7B)
for _c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D):
    _PLAIN[_c] = 0x20
_PLAIN = bytes(_PLAIN)


def normal(value: bytes) -> bytes:
    """A-Z in lower case, words joined by one space."""
    value = value.translate(_PLAIN).strip(b" ")
    return b" ".join(value.split()) if b"  " in value else value


def fingerprints(values: list[bytes], shingle: int = 3) -> np.ndarray:
    """The 64-bit fingerprints of normal() texts."""
    buf, start, end, first = tokens(values)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)  # a text of fewer words is one shingle
    edge = np.cumsum(count) - count
    a = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(edge, count)
    b = np.minimum(a + shingle, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(buf[s:e], 42) for s, e in zip(start[a].tolist(), end[b].tolist(), strict=True)], np.uint64)
    out = np.zeros(len(values), np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for d in np.flatnonzero(count):
        bits = np.zeros(64, np.int64)
        for lo in range(edge[d], edge[d] + count[d], 1 << 16):
            part = h[lo : min(lo + (1 << 16), edge[d] + count[d])]
            bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[d] = weight[2 * bits > count[d]].sum(dtype=np.uint64)
    return out


def _printer(shingle: int, carried: list[str]) -> Callable:
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            values = [normal(v) for v in texts(b["text"])]
            fp = np.concatenate([fingerprints(values[i:j], shingle) for i, j in packs(values)])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carried), pa.array(fp.view(np.int64))], [*carried, "fp"])
        release()

    return scan


def _cell(fp: Column) -> Column:
    """The segments' bit counts, three bits each."""
    parts = [F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("long"), 3 * k) for k in range(SEGMENTS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _around(cell: Column) -> Column:
    """The grid points at Manhattan distance 0 or 1."""
    near = [cell]
    for k in range(SEGMENTS):
        c = F.shiftright(cell, 3 * k).bitwiseAND(F.lit(7))
        near += [F.when(c < SEGMENT_BITS, cell + F.lit(1 << 3 * k)), F.when(c > 0, cell - F.lit(1 << 3 * k))]
    return F.array_compact(F.array(*near))


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints with 2 or fewer differing bits.

    A segment's bit counts differ by no more than its bits, so such fingerprints lie at
    Manhattan distance 2 or less on the grid of counts, and so share a grid point at
    distance 1 or less of both. Each fingerprint is dealt to these points (33 at most);
    what meets at a point is verified exactly. A point with more than CROWD
    fingerprints emits no pairs: its fingerprints are dealt to the 65 values within one
    flipped bit, and those that share one differ in 2 bits or fewer, so a star to the
    least of them connects them all. No link is lost either way, and the work is linear
    in the number of distinct fingerprints.
    """
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few files hold many fingerprints
    cells = spread.select("fp", F.explode(_around(_cell(F.col("fp")))).alias("cell"))
    shared = scratch.cut(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "shared")
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 2
    two = shared.where((F.col("n") == 2) & close(F.col("a"), F.col("b"))).select("a", "b")
    more = scratch.cut(cells.join(shared.where("n > 2").select(F.col("cell").alias("c"), "n"), F.col("cell") == F.col("c")).select("cell", "n", "fp"), "more")
    few = more.where(F.col("n") <= CROWD).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y < x) & close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    crowd = more.where(F.col("n") > CROWD).select("fp").distinct()
    flips = crowd.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - ((1 << 64) if k == 63 else 0))) for k in range(64)))).alias("key"))
    stars = flips.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "b")
    star = flips.join(stars, F.col("key") == F.col("k")).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return two.unionByName(few).unionByName(star)


def _roots(prints: DataFrame, least: Column, scratch: Scratch) -> DataFrame:
    """``fp, least, root`` for every distinct fingerprint: an aggregate of its rows, and the fingerprint that stands for its component."""
    distinct = scratch.cut(prints.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = components(links(distinct, scratch), scratch)
    inside = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return scratch.cut(distinct.join(inside, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every document.

    fp is the SimHash of the text's word shingles (XXH64, seed 42) as a signed long.
    Fingerprints link at 2 or fewer differing bits; component_id is the least doc_id of
    all that links reach. Only distinct fingerprints are linked, so a group of exact
    copies counts once however large it is.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id gets
    a row and a component but never names one; a component of null ids only has a null
    component_id. Repeated rows each have their row. An empty table gives an empty
    result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_printer(shingle, ["doc_id"]), "doc_id long, fp long"), "prints")
    named = _roots(prints, F.min("doc_id"), scratch)
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    classes = scratch.cut(named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "classes")
    return prints.join(classes, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """One row, with all its columns, of each component that :func:`near_duplicates` links.

    It is the row of the least doc_id (null last), then fingerprint, then hash of the text;
    rows with equal doc_id and text are alike. A component counts whatever its rows' doc_id
    are: rows without one, or that share one, are told apart by their texts.
    """
    scratch, key = Scratch(docs.sparkSession, "keep_one"), ["unnamed", "id", "text_key"]
    keyed = docs.withColumns({"unnamed": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text_key": F.xxhash64(F.lit(1), "text")})
    prints = scratch.cut(keyed.select(*key, "text").mapInArrow(_printer(shingle, key), "unnamed boolean, id long, text_key long, fp long"), "prints")
    named = _roots(prints, F.min(F.struct("unnamed", "id", "fp", "text_key")), scratch)
    kept = named.groupBy("root").agg(F.min("least").alias("k")).select(*(F.col(f"k.{c}").alias(c) for c in key))
    return keyed.dropDuplicates(key).join(kept, key, "left_semi").select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
