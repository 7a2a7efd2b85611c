"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._blocks import block_pairs, spanning_links
from riskloom.llm._common import staged
from riskloom.llm._components import connected_components
from riskloom.llm._vectors import is_usable, matrix, sample_matrix, spherical_kmeans

SAMPLE = 16_384
MOST_CELLS = 4096


def _cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray, nearest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("_vector"))
        if len(x):
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            m = min(nearest, len(centres))
            close = np.sort(np.argpartition(-(x @ centres.T), m - 1, axis=1)[:, :m].astype(np.int32), axis=1)
        else:
            close = np.zeros((0, 1), np.int32)
        cells = pa.array(close.tolist(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "_cells"])


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, links): links of u counted in this pair of blocks, or a link that connects u and v."""
    for batch in batches:
        u, v, links = [], [], []
        for cell, a, b in zip(batch.column("_cell").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
            parts = [p.values for p in (a, b) if p.is_valid]
            first = len(parts[0])
            ids, copies = (np.concatenate([p.field(c).to_numpy() for p in parts]) for c in ("_rep", "_copies"))
            x = np.concatenate([matrix(p.field("_vector")) for p in parts])
            cells = np.concatenate([matrix(p.field("_cells"), np.int64) for p in parts])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if len(parts) == 2:  # pairs inside a block belong to that block's own row
                near[:first, :first] = near[first:, first:] = False
            i, j = np.nonzero(near)
            for k in range(0, len(i), 1 << 18):  # a pair counts in the first cell that both vectors are in
                ci, cj = cells[i[k : k + (1 << 18)]], cells[j[k : k + (1 << 18)]]
                same = np.where(ci[:, :, None] == cj[:, None, :], ci[:, :, None], np.iinfo(np.int64).max)
                other = same.min(axis=(1, 2)) != cell
                near[i[k : k + (1 << 18)][other], j[k : k + (1 << 18)][other]] = False
            counts = near @ copies
            hit = np.nonzero(counts)[0]
            u += ids[hit].tolist()
            v += [None] * len(hit)
            links += counts[hit].tolist()
            if len(hit):
                tree = spanning_links(near)
                u += [int(ids[i]) for i, _ in tree]
                v += [int(ids[j]) for _, j in tree]
                links += [0] * len(tree)
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(links, pa.int64())})


def near_duplicates(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93,
    cell_rows: int = 1500, nearest: int = 4, block_rows: int = 1024,
) -> DataFrame:
    """(ident, n_links, component_id, kept) for each row; kept is the one row of a group with its component's id.

    Rows of one label link at a cosine of ``least`` or more, in double precision. Directions are cut into cells by
    spherical k-means on a sample of SAMPLE vectors; every vector goes to its ``nearest`` cells, and
    pairs that share one of them are compared, in blocks, so a cell of any size is whole and spread over
    tasks. Up to ``cell_rows`` vectors there is one cell and the result is exact; beyond, links between
    vectors without a common cell are missed (test_vectors measures the recall in 400 cells). Equal vectors are one node
    with a count. Rows with a null label, or a vector that is null, empty, zero or holds null or non-finite
    components, link with nothing, and neither do vectors of different lengths. Idents are taken to be
    unique; rows with a null ident come back without links. An empty table gives an empty result.
    """
    plain = vectors.select(
        F.col(ident).cast("long").alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_vector")
    )
    usable = plain.where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & is_usable("_vector"))
    # Equal vectors of a label meet under one hash of all their components, and are told apart by value.
    nodes = staged(
        usable.groupBy("_label", F.size("_vector").alias("_size"), "_vector").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")),
        "distinct-vectors",
    )
    pieces = []
    for size, count in sorted((r[0], r[1]) for r in nodes.groupBy("_size").count().collect()):
        own = nodes.where(F.col("_size") == size)
        cells = min(MOST_CELLS, -(-count // cell_rows))
        centres = spherical_kmeans(sample_matrix(own.select("_rep", "_vector"), "_vector", "_rep", SAMPLE), cells)

        def run(it: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            return _cells(it, centres, nearest)

        schema = own.selectExpr("*", "array(0) AS _cells").schema
        members = own.mapInArrow(run, schema).select("*", F.explode("_cells").alias("_cell"))
        blocks = block_pairs(members, ["_size", "_label", "_cell"], "_rep", ["_rep", "_copies", "_vector", "_cells"], block_rows)
        pieces.append(staged(blocks.select("_cell", "a", "b").mapInArrow(lambda it: _compare(it, least), "u long, v long, links long"), "links"))
    if not pieces:
        return plain.select(F.col("_id").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    found = pieces[0]
    for p in pieces[1:]:
        found = found.unionByName(p)
    counted = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("_links"))
    parts = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    linked = nodes.join(counted, F.col("_rep") == F.col("u"), "left").join(parts, F.col("_rep") == F.col("node"), "left")
    # Only vectors with a link or a copy need to be found again from their rows.
    named = staged(
        linked.select(
            F.col("_label").alias("_l"), F.col("_vector").alias("_v"),
            (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("component", "_rep").alias("_component"),
        ).where("n_links > 0"),
        "linked-vectors",
    )
    back = plain.join(named, (F.col("_label") == F.col("_l")) & (F.col("_vector") == F.col("_v")) & F.col("_id").isNotNull(), "left")
    component = F.coalesce("_component", "_id")
    return back.select(
        F.col("_id").alias(ident), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(False)).alias("kept"),
    )
