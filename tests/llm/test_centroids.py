"""Exact clustering against plain integer k-means."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, ident int"


def plain(rows, k=8, rounds=10, seed=3):
    """{(vec_id, components): (cluster, distance)}, inertias and centroids of a literal reading of the rules."""
    kept = [
        (i, [math.floor(1024 * Fraction(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def assigned():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)))
        return out

    for _ in range(rounds):
        own = [j for _, j in assigned()]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = assigned()
    inertia = [sum(d for d, j in last if j == c) for c in range(len(cents))]
    return sorted(
        (str(i), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
        for (i, _), (d, j) in zip(kept, last)
    )


def found(df):
    return sorted(
        (str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()
    )


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(2**20), 2**20, (2, 50, 64))
    gaps = centroids.hadamard(x, centroids.SEQUENCY) - centroids.hadamard(y, centroids.SEQUENCY)
    assert ((gaps * gaps).sum(axis=1) == 64 * ((x - y) ** 2).sum(axis=1)).all()


@pytest.mark.parametrize("spread", [0.0, 0.001, 3.0])
def test_search_is_exact(spread):
    rng = np.random.default_rng(2)
    cents = rng.integers(-3000, 3000, (8, 64))
    cents[5] = cents[2]  # a tie in every distance
    x = (cents[rng.integers(0, 8, 400)] + spread * 1024 * rng.normal(size=(400, 64))).astype(np.int64)
    own, distance = centroids.nearest(x, cents.tolist())
    every = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_equals_plain_clustering(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 64))
    rows = [(i, (middle[i % 6] + 0.4 * rng.normal(size=64)).tolist()) for i in range(300)]
    rows += [(1000 + i, middle[0].tolist()) for i in range(200)]  # a third of all rows are one vector
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[9][1]), (5000, [0.0] * 64)]
    rows += [(6000, None), (6001, [1.0] * 63), (6002, [1.0] * 65), (6003, [None] + [1.0] * 63), (6004, [math.nan] + [1.0] * 63)]
    rows += [(6005, [math.inf] + [1.0] * 63), (6006, [])]
    df = table_of(spark, rows).repartition(5)
    assert found(centroids.cluster(df)) == plain(rows)
    floats = df.withColumn("embedding", df["embedding"].cast("array<float>"))
    as_floats = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(centroids.cluster(floats)) == plain(as_floats)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i % 30)] + [0.1 * i] * 63) for i in range(40)]
    got = [r[:2] for r in found(centroids.cluster(table_of(spark, rows)))]
    wanted = plain(rows)
    assert got == [r[:2] for r in wanted]
    fits = {r[0]: r[2] for r in found(centroids.cluster(table_of(spark, rows)))}
    assert all(fits[r[0]] == (r[2] if r[2] < 2**63 else None) for r in wanted)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    assert found(centroids.cluster(table_of(spark, rows))) == plain(rows)
    assert centroids.cluster(table_of(spark, [])).isEmpty()
    assert centroids.cluster(table_of(spark, [(1, None)])).isEmpty()
