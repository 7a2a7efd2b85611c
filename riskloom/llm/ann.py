"""Approximate nearest neighbours by balanced posting lists and an in-memory graph of their centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._common import staged
from riskloom.llm._vectors import is_usable, matrix, sample_matrix

SAMPLE = 16_384
MOST_LISTS = 4096
FIRST = 8  # nearest lists of a query, whose scores rule out most vectors of the others
READ_SHARE = 8  # a query reads one list of so many at least: a fixed number would lose recall as the lists grow in number


class CentroidGraph:
    """Centroids with links to their nearest ones and a few others, searched best first."""

    def __init__(self, centres: np.ndarray, degree: int = 16, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.centres, k = centres, len(centres)
        self.norms = (centres**2).sum(axis=1)
        near = np.empty((k, min(degree, k)), np.int64)
        for a in range(0, k, 1024):
            d = self.norms[None, :] - 2 * centres[a : a + 1024] @ centres.T
            near[a : a + 1024] = np.argsort(d, axis=1)[:, : near.shape[1]]
        # Long links from each centroid, so that every part of the graph can be reached.
        self.links = np.concatenate([near, rng.integers(0, k, (k, min(8, k)))], axis=1)
        self.entry = np.unique(rng.integers(0, k, max(8, int(4 * np.sqrt(k)))))

    def search(self, x: np.ndarray, want: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of the ``want`` nearest centroids found, nearest first.

        All rows advance together: each expands its nearest centroid that it has not expanded yet.
        """
        k, n = len(self.centres), len(x)
        want = min(want, k)
        width = min(k, max(2 * want, 16))
        own = (x**2).sum(axis=1)
        if want * READ_SHARE >= k:  # a walk would meet most centroids, so all distances are cheaper, and exact
            distance = np.maximum(own[:, None] + self.norms - 2 * x @ self.centres.T, 0)
            got = np.argsort(distance, axis=1, kind="stable")[:, :want]
            return got, np.take_along_axis(distance, got, axis=1)
        distance = np.full((n, k), np.inf)
        expanded = np.zeros((n, k), bool)
        distance[:, self.entry] = own[:, None] + self.norms[self.entry] - 2 * x @ self.centres[self.entry].T
        rows = np.arange(n)
        for _ in range(min(rounds + width, k)):
            bound = np.partition(distance, width - 1, axis=1)[:, width - 1] if width < k else np.full(n, np.inf)
            open_ = np.where(expanded, np.inf, distance)
            best = open_.argmin(axis=1)
            live = rows[(open_[rows, best] < np.inf) & (open_[rows, best] <= bound)]
            if not len(live):
                break
            expanded[live, best[live]] = True
            to = self.links[best[live]]
            distance[live[:, None], to] = own[live, None] + self.norms[to] - 2 * np.einsum("nd,nkd->nk", x[live], self.centres[to])
        got = np.argsort(distance, axis=1, kind="stable")[:, :want]
        return got, np.maximum(np.take_along_axis(distance, got, axis=1), 0)


def balanced_centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means whose large clusters lose points to their neighbours: distances grow with a list's excess."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    scale = max(float(x.var(axis=0).sum()), 1e-12)
    price = np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate(
            [((centres**2).sum(axis=1) - 2 * p @ centres.T + price).argmin(axis=1) for p in np.array_split(x, max(1, len(x) // 4096))]
        )
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
        price = np.maximum(0, price + 0.05 * scale * (counts * k / len(x) - 1.5))
    return centres


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """One more component that makes all norms equal: the largest inner product becomes the nearest point."""
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _lists_of(graph: CentroidGraph, x: np.ndarray, most: int, ratio: float, replicas: bool) -> list[list[int]]:
    """The nearest lists of a query; for a stored vector, those whose centroid is at most (1 + ratio) times as far as the nearest one.

    For a stored vector, a centroid is left out where one already taken is much nearer to it than the vector is: the vector
    would lie in two lists that are searched together anyway.
    """
    got, d = graph.search(x, most)
    if not replicas:
        return got.tolist()
    close = d <= (1 + ratio) ** 2 * d[:, :1] + 1e-12
    out = []
    for g, c, row in zip(got, close, d, strict=True):
        taken = [int(g[0])]
        for j in np.nonzero(c)[0][1:]:
            apart = ((graph.centres[taken] - graph.centres[g[j]]) ** 2).sum(axis=1)
            if (apart >= 0.2 * row[j]).all():
                taken.append(int(g[j]))
        out.append(taken)
    return out


def search(
    vectors: DataFrame, queries: DataFrame, ident: str = "vec_id", vector: str = "embedding", nearest: int = 20,
    list_rows: int = 400, replicas: int = 3, probes: int = 96, ratio: float = 0.15, block_rows: int = 1024,
) -> DataFrame:
    """(query_id, rank, ident, score): each query's ``nearest`` rows by largest inner product.

    ``queries`` has the ident and vector columns; a query's own ident is no candidate. Vectors are lifted to
    equal norms, so that inner products order like distances. Centroids of about ``list_rows`` vectors
    each are fitted on SAMPLE vectors (at most MOST_LISTS centroids), with prices that balance the lists,
    and searched by a graph in the memory of each task. A vector near a boundary goes to up to
    ``replicas`` lists within ``ratio`` of its nearest centroid; a query reads ``probes`` lists or one in
    READ_SHARE of all, whichever is more, however far they are. Lists are stored in blocks, and a query block meets a list block in a row of its own,
    so long lists are spread over tasks. Scores are the inner products of the original vectors in double
    precision; ties go to the smaller ident. Equal vectors are stored once with their ``nearest`` + 1
    smallest idents, which is all that any query can return of them. Vectors that are null, empty, zero
    or hold null or non-finite components take no part, nor do null idents; vectors of different
    lengths never meet. Queries with fewer candidates get them all; no candidate gives no row. Repeated
    (ident, vector) rows count once.
    """
    def usable(rows: DataFrame) -> DataFrame:
        plain = rows.select(F.col(ident).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
        return plain.where(F.col("_id").isNotNull() & is_usable("_vector"))

    keep = nearest + 1
    # The smallest idents of equal vectors: first within slices of the idents, then over the slices, so that a
    # vector that a third of all rows have meets nowhere as a whole.
    slices = usable(vectors).select("*", F.pmod(F.xxhash64("_id"), F.lit(256)).alias("_slice"))
    first = Window.partitionBy("_vector", "_slice").orderBy("_id")
    cut = slices.withColumn("_place", F.dense_rank().over(first)).where(F.col("_place") <= keep)
    packed = cut.groupBy("_vector", "_slice").agg(F.collect_set("_id").alias("_ids"))
    stored = packed.groupBy("_vector").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_ids"))), 1, keep).alias("_ids")
    ).select(F.size("_vector").alias("_size"), "_vector", "_ids", F.col("_ids")[0].alias("_rep"))
    stored = staged(stored, "distinct-vectors")
    asked = staged(
        usable(queries).groupBy("_vector").agg(F.min("_id").alias("_query")).select(F.size("_vector").alias("_size"), "_vector", "_query"),
        "query-vectors",
    )
    answers = []
    widest = stored.groupBy("_size").agg(
        F.count("*"), F.max(F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x * x)))
    ).collect()
    for size, count, largest in sorted(tuple(r) for r in widest):
        own, ask = stored.where(F.col("_size") == size), asked.where(F.col("_size") == size)
        x = _lifted(sample_matrix(own.select("_rep", "_vector"), "_vector", "_rep", SAMPLE), largest)
        centres = balanced_centres(x, min(MOST_LISTS, -(-count // list_rows)))
        reads = max(probes, -(-len(centres) // READ_SHARE))
        answers.append(_scan(own, ask, CentroidGraph(centres), largest, keep, replicas, reads, ratio, block_rows))
    schema = f"query_id long, rank int, `{ident}` long, score double"
    if not answers:
        return vectors.sparkSession.createDataFrame([], schema)
    found = answers[0]
    for a in answers[1:]:
        found = found.unionByName(a)
    # Several lists may give one vector; all its idents follow, and the best are kept for each distinct query.
    place = Window.partitionBy("_query").orderBy(F.desc("score"), "_rep")
    best = found.groupBy("_query", "_rep").agg(F.max("score").alias("score"), F.first("_ids").alias("_ids"))
    best = best.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= keep)
    each = best.select("_query", "score", F.explode("_ids").alias("_hit"))
    order = Window.partitionBy("_query").orderBy(F.desc("score"), "_hit")
    each = staged(each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep), "answers")
    lists = staged(
        each.groupBy("_query").agg(F.sort_array(F.collect_list(F.struct(F.col("_n"), F.col("_hit"), F.col("score")))).alias("_hits")),
        "answer-lists",
    )
    # Back to every query row with that vector: its own ident goes, ranks close up.
    named = staged(asked.join(lists, "_query").select(F.col("_vector").alias("_v"), "_hits"), "answers-by-vector")
    rows = usable(queries).distinct().join(named, F.col("_vector") == F.col("_v"))
    others = F.slice(F.filter("_hits", lambda h: h["_hit"] != F.col("_id")), 1, nearest)
    return rows.select(F.col("_id").alias("query_id"), F.posexplode(others).alias("_r", "_h")).select(
        "query_id", (F.col("_r") + 1).cast("int").alias("rank"), F.col("_h._hit").alias(ident), F.col("_h.score").alias("score")
    )


def _scan(
    stored: DataFrame, asked: DataFrame, graph: CentroidGraph, largest: float, keep: int,
    replicas: int, probes: int, ratio: float, block_rows: int,
) -> DataFrame:
    """(_query, _rep, _ids, score): candidates of each query from its lists, the ``keep`` best among them.

    The nearest FIRST lists of a query give the score that a candidate of its other lists has to reach, so those send the
    few that do, however many lists are read.
    """

    def listed(rows: DataFrame, most: int, within: float, stores: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    x = matrix(part.column("_vector"))
                    lifted = _lifted(x, largest) if stores else np.concatenate([x * (largest / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))], axis=1)
                    lists = _lists_of(graph, lifted, most, within, stores)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*part.schema.names, "_lists"])

        spread = rows.mapInArrow(run, rows.selectExpr("*", "array(0) AS _lists").schema)
        return staged(spread.select(*[c for c in rows.columns if c != "_size"], F.posexplode("_lists").alias("_place", "_list")), "lists")

    def blocks(rows: DataFrame, key: str, columns: list[str], out: str) -> tuple[DataFrame, DataFrame]:
        # One count per list: MOST_LISTS rows at most, so they are broadcast.
        sizes = rows.groupBy("_list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"_n{out}"))
        sizes = staged(sizes, "list-sizes")
        block = F.pmod(F.xxhash64(key), F.col(f"_n{out}").cast("long")).cast("int").alias(f"_{out}")
        cut = rows.join(F.broadcast(sizes), "_list").select("_list", block, F.struct(*columns).alias("m"))
        return sizes, cut.groupBy("_list", f"_{out}").agg(F.collect_list("m").alias(out))

    list_sizes, list_blocks = blocks(listed(stored, replicas, ratio, True), "_rep", ["_rep", "_ids", "_vector"], "a")
    reads = listed(asked, probes, 0.0, False)

    def met(queries: DataFrame) -> DataFrame:
        query_sizes, query_blocks = blocks(queries, "_query", ["_query", "_vector", "_least"], "b")
        pairs = list_sizes.join(F.broadcast(query_sizes), "_list").select(
            "_list", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("_a"), "_nb"
        ).select("_list", "_a", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_b"))
        both = pairs.join(list_blocks, ["_list", "_a"]).join(query_blocks, ["_list", "_b"]).select("a", "b")
        return both.mapInArrow(run, "_query long, _rep long, _ids array<long>, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = a.values, b.values
                x, q = matrix(a.field("_vector")), matrix(b.field("_vector"))
                reps, least = a.field("_rep").to_numpy(), b.field("_least").to_numpy()
                order = np.argsort(reps)
                x, reps = x[order], reps[order]
                # One way of adding up for each pair of vectors, whatever block it is in.
                scores = q @ x.T
                n = min(keep, len(reps))
                edge = np.maximum(np.partition(scores, len(reps) - n, axis=1)[:, len(reps) - n], least)
                at, hit = np.nonzero(scores >= edge[:, None] - 1e-9)
                exact = np.einsum("nd,nd->n", q[at], x[hit])
                rank = np.lexsort((reps[hit], -exact, at))
                at, hit, exact = at[rank], hit[rank], exact[rank]
                first = np.searchsorted(at, np.arange(len(q)))
                kept = (np.arange(len(at)) - first[at] < n) & (exact >= least[at])
                at, hit, exact = at[kept], hit[kept], exact[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.field("_query").to_numpy()[at], pa.int64()), pa.array(reps[hit], pa.int64()),
                     a.field("_ids").take(pa.array(order[hit])), pa.array(exact, pa.float64())],
                    names=["_query", "_rep", "_ids", "score"],
                )

    unbounded = F.lit(float("-inf")).alias("_least")
    near = staged(met(reads.where(F.col("_place") < FIRST).select("*", unbounded)), "near-candidates")
    place = Window.partitionBy("_query").orderBy(F.desc("score"), "_rep")
    # A vector may be in several lists: distinct ones count. With fewer than ``keep`` nothing is ruled out.
    ranked = near.groupBy("_query", "_rep").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(place))
    least = ranked.where(F.col("_n") == keep).select("_query", F.col("score").alias("_bound"))
    rest = reads.where(F.col("_place") >= FIRST).join(least, "_query", "left")
    bound = F.coalesce("_bound", F.lit(float("-inf"))).alias("_least")
    far = met(rest.select(*reads.columns, bound))
    return near.unionByName(far)
