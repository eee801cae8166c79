"""Jaro and Jaro-Winkler similarity with un-floored transpositions and an unconditional prefix boost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of a window that are compared, characters of each text, and weight of a shared prefix character (4 at most).
PAIRS, CHARS, BOOST, PREFIX = 24, 128, 0.1, 4


def jaro(left: str, right: str) -> float:
    """1 for equal texts (two empty ones too), 0 if one is empty."""
    if left == right:
        return 1.0
    if not left or not right:
        return 0.0
    reach = max(0, max(len(left), len(right)) // 2 - 1)
    free, chosen = [True] * len(right), []
    pairs = []
    for i, c in enumerate(left):
        j = next((j for j in range(max(0, i - reach), min(len(right), i + reach + 1)) if free[j] and right[j] == c), None)
        if j is not None:
            free[j] = False
            pairs.append(c)
            chosen.append(j)
    m = len(pairs)
    if not m:
        return 0.0
    half = sum(c != right[j] for c, j in zip(pairs, sorted(chosen), strict=True)) / 2
    return (m / len(left) + m / len(right) + (m - half) / m) / 3


def jaro_winkler(left: str, right: str) -> float:
    j, shared = jaro(left, right), 0
    for a, b in zip(left[:PREFIX], right[:PREFIX], strict=False):
        if a != b:
            break
        shared += 1
    return j + BOOST * shared * (1 - j)


def sampled(n: int, most: int = PAIRS) -> list[int]:
    """Indices of n adjacent pairs: all, or ``most`` at equal steps."""
    return list(range(n)) if n <= most else [int(round(i * (n - 1) / (most - 1))) for i in range(most)]


def _adjacent(texts: pa.Array) -> pa.Array:
    out, seen = [], {}
    for row in texts.to_pylist():
        if row is None or len(row) < 2:
            out.append(None)
            continue
        row = [(x or "")[:CHARS] for x in row]
        values = []
        for i in sampled(len(row) - 1):
            pair = row[i], row[i + 1]
            if pair not in seen:
                seen[pair] = jaro_winkler(*pair)
            values.append(seen[pair])
        out.append(float(np.mean(values)))
    return pa.array(out, pa.float64())


def adjacent_jaro_winkler(ordered: Column) -> Column:
    """Mean similarity of neighbours in an ordered array of texts; NULL for fewer than two."""
    return F.arrow_udf(_adjacent, "double")(ordered)


def similarity(left: Column, right: Column) -> Column:
    """Jaro-Winkler of two text columns."""

    def pairwise(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(pairwise, "double")(left, right)
