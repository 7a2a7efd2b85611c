"""Operators on vectors against brute force."""

import numpy as np

from riskloom.llm import ann, embedding_dedup
from riskloom.queries.registry import table

BAD = [(900, None, 1), (901, [0.0, 0.0, 0.0], 1), (902, [1.0, float("nan"), 0.0], 1), (903, [None, 1.0, 0.0], 1), (904, [1.0, 0.0, 0.0], None),
       (905, [float("inf"), 0.0, 0.0], 1), (906, [], 1), (None, [1.0, 0.0, 0.0], 1), (907, [1.0, 0.0], 1)]
SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_of_nearest_neighbours(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), list_rows=100, probes=14).collect()
    rows = vectors.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = asked = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        own = sorted((r for r in found if r.query_id == ids[q]), key=lambda r: r["rank"])
        score = x @ x[q]
        score[q] = -np.inf
        top = ids[np.lexsort((ids, -score))[:20]].tolist()
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(a.score >= b.score for a, b in zip(own, own[1:]))
        hits, asked = hits + len(set(top) & {r.vec_id for r in own}), asked + 20
    assert hits >= 0.9 * asked


def test_recall_with_many_more_lists_than_probes(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()
    x, label, rng = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]), np.random.default_rng(1)
    drawn = rng.choice(label, 16_000)
    mean, spread = ({k: f(x[label == k]) for k in set(label.tolist())} for f in (lambda v: v.mean(axis=0), lambda v: v.std(axis=0)))
    v = np.stack([mean[k] + rng.normal(size=x.shape[1]) * spread[k] for k in drawn.tolist()])
    vectors = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 160 = 0"), list_rows=8).collect():  # 2,000 lists
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(v), 160):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(got.get(q, set()) & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 100, hits / 2000


def test_nearest_ties_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0], 0) for i in range(60)] + [(100, [0.5, 0.5, 0.0], 0)] + BAD
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = ann.search(vectors, vectors.where("vec_id IN (0, 40, 100, 900, 901)"), nearest=5).collect()
    of = lambda q: [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
    assert of(0) == [1, 2, 3, 4, 5] and of(40) == [0, 1, 2, 3, 4] and of(100) == [0, 1, 2, 3, 4] and not of(900) and not of(901)
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(empty, empty).isEmpty()


def links_plainly(rows, least=0.93):
    n, part = {}, {r[0]: r[0] for r in rows}
    for a in rows:
        u = np.array(a[1], float)
        near = [b[0] for b in rows if b[0] != a[0] and b[2] == a[2] and np.dot(u, b[1]) / np.linalg.norm(u) / np.linalg.norm(b[1]) >= least]
        n[a[0]] = near
    changed = True
    while changed:
        changed = False
        for i, near in n.items():
            low = min([part[i], *(part[j] for j in near)])
            changed |= low != part[i]
            part[i] = low
    return {i: (len(near), part[i], part[i] == i) for i, near in n.items()}


def test_links_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.25, 8)).astype(np.float32).tolist(), i % 2) for i in range(240)]
    rows += [(500 + i, rows[0][1], 0) for i in range(5)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    expected = links_plainly(rows)
    for options in ({}, {"block_rows": 16}, {"cell_rows": 60, "block_rows": 32}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors, **options).collect()}
        if "cell_rows" in options:
            assert sum(g[0] for g in got.values()) >= 0.9 * sum(e[0] for e in expected.values())
        else:
            assert got == expected


def test_links_found_over_hundreds_of_cells(spark):
    # Pairs just above the threshold in directions without clusters, in 400 cells of which a vector goes to 4.
    rng = np.random.default_rng(11)
    a, noise = rng.normal(0, 1, (2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.935 * a + np.sqrt(1 - 0.935**2) * noise
    rows = [(2 * i + k, x.tolist(), 0) for i in range(4000) for k, x in enumerate((a[i], b[i]))]
    schema = SCHEMA.replace("array<float>", "array<double>")
    vectors = spark.createDataFrame(rows, schema).repartition(8)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(vectors, cell_rows=20).collect()}
    # No other two of these vectors are as near, so every link found is one of the pairs.
    assert set(got.values()) <= {0, 1} and sum(got.values()) >= 0.99 * 8000


def test_vectors_that_take_no_part(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(BAD, SCHEMA)).collect()}
    assert all(v == (0, k, True) for k, v in got.items() if k is not None) and got[None] == (0, None, False) and len(got) == len(BAD)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).isEmpty()
