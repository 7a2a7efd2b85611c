"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import staged


def _mins(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node; written out, so that the join below shuffles both sides plainly
    and adaptive execution can split the rows of a node with very many links."""
    return staged(pairs.groupBy("u").agg(F.min("v").alias("m")), "smallest").withColumnRenamed("u", "_u")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has a link.

    ``links`` has long columns u and v. Large-star and small-star steps alternate until the links no
    longer change; each round is written to the shared folder. Rounds grow with the logarithm of the
    longest path. Loops and repeated links are allowed; nodes without a link are not returned.
    """
    edges = staged(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_mins(both), F.col("u") == F.col("_u"))
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = staged(large, "large")
        # Every link now leads from the larger node to the smaller one.
        small = large.join(_mins(large), F.col("u") == F.col("_u")).select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        small = small.select("e.*").where(F.col("u") != F.col("v")).distinct()
        edges = staged(small, "small")
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("links still change; raise max_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
