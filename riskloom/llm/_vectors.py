"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def sample_matrix(rows: DataFrame, vector: str, key: str, most: int) -> np.ndarray:
    """At most ``most`` vectors, those with the smallest hashes of the key."""
    picked = rows.select(vector).orderBy(F.xxhash64(F.lit("sample"), key), key).limit(most) if key in rows.columns else rows
    got = [r[0] for r in picked.collect()]
    return np.array(got, np.float64).reshape(len(got), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, balance: float = 0.0, seed: int = 7) -> np.ndarray:
    """Unit centroids of the rows' directions; ``balance`` draws points away from large cells."""
    rng = np.random.default_rng(seed)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    penalty = np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate([(part @ centres.T - penalty).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = counts == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        penalty = penalty + balance * (counts / max(1.0, len(x) / k) - 1).clip(-1, 1)
    return centres
