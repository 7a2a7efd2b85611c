"""Centroid clustering: exact integer k-means, nearest centroids found by progressive search of Walsh-Hadamard coefficients.

Vectors become integers, and both vectors and centroids their Walsh-Hadamard transforms, whose squared distance is
``DIMENSIONS`` times that of the integers. Coefficient differences are added up from coarse to fine; a centroid whose
partial sum is already greater than the whole distance of another goes, the rest are finished over all coefficients.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import staged

DIMENSIONS = 64
SCALE = 1024
# Coefficients up to each of these are added before centroids are sorted out again.
BANDS = (2, 8, 20, DIMENSIONS)
# Below this magnitude a sum of squared coefficient differences fits 64 bits; beyond it numbers are Python's own.
EXACT = 2**21
LONGEST = 2**63 - 1


def _sequency_order(n: int) -> list[int]:
    """Rows of the transform by their number of sign changes, that is from coarse to fine."""
    rows = hadamard(np.eye(n, dtype=np.int64), range(n))
    return list(np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1)))


def hadamard(x: np.ndarray, order: Iterable[int]) -> np.ndarray:
    """Exact transform of each row, coefficients in the given order."""
    n = x.shape[1]
    width = 1
    while width < n:
        halves = x.reshape(len(x), n // (2 * width), 2, width)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(x), n)
        width *= 2
    return x[:, list(order)]


SEQUENCY = _sequency_order(DIMENSIONS)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: 64-bit where every distance between such rows fits, else Python's integers."""
    if not x.size or np.abs(x).max() < EXACT // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[_floor(float(v)) for v in row] for row in x], dtype=object).reshape(x.shape)


def _floor(v: float) -> int:
    top, bottom = v.as_integer_ratio()
    return SCALE * top // bottom


def _fitting(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in one kind of number that holds all distances."""
    small = all(abs(v) < EXACT for c in centroids for v in c)
    if small and x.dtype != object:
        return x, np.array(centroids, dtype=np.int64)
    return x.astype(object), np.array(centroids, dtype=object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance; ties go to the smaller number."""
    x, c = _fitting(x, centroids)
    hx, hc = hadamard(x, SEQUENCY), hadamard(c, SEQUENCY)
    partial = np.zeros((len(x), len(c)), dtype=x.dtype)
    alive = np.ones(partial.shape, dtype=bool)
    bound = None
    done = 0
    for upto in BANDS:
        rows, cells = np.nonzero(alive)
        gaps = hx[rows, done:upto] - hc[cells, done:upto]
        partial[rows, cells] += (gaps * gaps).sum(axis=1)
        done = upto
        if done == hx.shape[1]:
            break
        if bound is None:
            # The whole distance of the centroid that is nearest so far: none beyond it can be the nearest.
            gaps = hx - hc[partial.argmin(axis=1)]
            bound = (gaps * gaps).sum(axis=1)
        alive &= partial <= bound[:, None]
    beyond = partial.max() + 1 if partial.size else 0
    partial[~alive] = beyond
    own = partial.argmin(axis=1)
    return own, partial[np.arange(len(x)), own] // hx.shape[1]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMENSIONS)


def _is_kept(vector: str) -> Column:
    c = F.col(vector)
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(c) == DIMENSIONS) & whole, F.lit(False))


def _partial_sums(centroids: list[list[int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * DIMENSIONS for _ in centroids]
        counts = [0] * len(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(_matrix(batch.column("vector")))
            own, _ = nearest(x, centroids)
            for k in range(len(centroids)):
                mine = x[own == k]
                if len(mine):
                    counts[k] += len(mine)
                    sums[k] = [a + int(b) for a, b in zip(sums[k], mine.sum(axis=0))]
        used = [k for k, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array([counts[k] for k in used], pa.int64()),
                pa.array([[str(v) for v in sums[k]] for k in used], pa.list_(pa.string())),
            ],
            ["cluster", "n", "sums"],
        )

    return run


def _floored_mean(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    n = int(parts["n"].sum())
    sums = [sum(int(row[i]) for row in parts["sums"]) for i in range(DIMENSIONS)]
    return pd.DataFrame({"cluster": [key[0]], "centroid": [[str(s // n) for s in sums]]})


def _assignments(centroids: list[list[int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, distance = nearest(whole_numbers(_matrix(batch.column("vector"))), centroids)
            fits = pa.array([int(d) if d <= LONGEST else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ident"), pa.array(own, pa.int32()), fits], ["ident", "cluster", "distance"]
            )

    return run


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Cluster, squared distance and inertia of every usable vector, in exact integers.

    Usable are vectors of 64 components, none null or non-finite; a component x counts as floor(1024 * x). The first
    centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:ident``; each round assigns all vectors and
    replaces every centroid that has some by their floored mean, and a last assignment follows. Rounds after which
    no centroid changed are not repeated, as they would give the same again.

    Each round is one pass in which a task sends one sum per cluster, so a cluster with most of the rows weighs no
    more than any other; the driver holds ``k`` centroids only.

    Odd rows: vectors that are null, of another length, or hold null, NaN or infinity give no row. Repeated rows count
    as often as they come. A null ident counts as empty text in the hash; equal hashes are ordered by their components.
    With fewer than ``k`` vectors there are as many centroids as vectors; an empty table gives no rows. Distances or
    inertias beyond 63 bits are null, though clusters are exact for numbers of any size. Other columns are ignored.
    """
    kept = vectors.where(_is_kept(vector)).select(F.col(ident).alias("ident"), F.col(vector).alias("vector"))
    points = staged(kept, "points")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("ident").cast("string"), F.lit("")))
    first = points.select("vector", F.sha2(text.cast("binary"), 256).alias("hash")).orderBy("hash", "vector").limit(k)
    drawn = np.array([[float(v) for v in r["vector"]] for r in first.collect()], np.float64).reshape(-1, DIMENSIONS)
    centroids = [[int(v) for v in row] for row in whole_numbers(drawn)]
    if centroids:
        for _ in range(rounds):
            sums = points.mapInArrow(_partial_sums(centroids), "cluster int, n long, sums array<string>")
            means = sums.groupBy("cluster").applyInPandas(_floored_mean, "cluster int, centroid array<string>")
            # At most k rows.
            moved = {r["cluster"]: [int(v) for v in r["centroid"]] for r in means.collect()}
            new = [moved.get(i, c) for i, c in enumerate(centroids)]
            if new == centroids:
                break
            centroids = new
    kind = vectors.schema[ident].dataType.simpleString()
    schema = f"ident {kind}, cluster int, distance long"
    assigned = staged(points.mapInArrow(_assignments(centroids), schema), "assigned")
    inertia = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    found = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(inertia.alias("inertia")).collect()}
    whole = None if None in found.values() else sum(int(v) for v in found.values())

    def fitting(v) -> int | None:
        return None if v is None or v > LONGEST else int(v)

    rows = [
        (i, fitting(found[i]), fitting(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), [str(v) for v in c])
        for i, c in enumerate(centroids)
        if i in found
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<string>"
    # One row a cluster: k at most.
    named = F.broadcast(assigned.sparkSession.createDataFrame(rows, schema))
    return assigned.join(named, "cluster").select(
        F.col("ident").alias(ident), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
