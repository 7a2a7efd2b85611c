"""Compare the members of each bucket in blocks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import staged


def block_pairs(
    members: DataFrame, keys: list[str], ident: str, columns: list[str], rows: int, weight: Column | None = None, most: int = 1
) -> DataFrame:
    """One row per pair of blocks of a bucket: keys, block_a, block_b, a, b (arrays of structs).

    A bucket of n members is cut into ceil(n / rows) blocks by a hash of ``ident``; each unordered pair
    of blocks is a row of its own, dealt to tasks by bucket and block, so that a bucket with a third
    of all members is spread over many tasks and no task holds it. ``b`` is null where both blocks are
    the same one. Buckets of one member are left out. With ``weight``, a block has about ``most`` of it or less.
    """
    members = staged(members, "members")
    sizes = staged(
        members.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.lit(0) if weight is None else weight).alias("_weight")).where("_n > 1"), "bucket-sizes"
    )
    sizes = sizes.withColumn("_blocks", F.greatest(F.ceil(F.col("_n") / rows), F.ceil(F.col("_weight") / most)).cast("int")).drop("_weight")
    blocked = members.join(sizes, keys).withColumn(
        "_block", F.pmod(F.xxhash64(ident), F.col("_blocks").cast("long")).cast("int")
    )
    packs = staged(
        blocked.groupBy(*keys, "_blocks", "_block").agg(
            F.collect_list(F.struct(*columns)).alias("members")
        ),
        "blocks",
    )
    alone = packs.select(
        *keys, F.col("_block").alias("block_a"), F.col("_block").alias("block_b"),
        F.col("members").alias("a"), F.lit(None).cast(packs.schema["members"].dataType).alias("b"),
    )
    pairs = (
        sizes.where("_blocks > 1")
        .select(*keys, "_blocks", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 2)).alias("block_a"))
        .select(*keys, "block_a", F.explode(F.sequence(F.col("block_a") + 1, F.col("_blocks") - 1)).alias("block_b"))
    )
    several = packs.where("_blocks > 1")
    left = several.select(*keys, F.col("_block").alias("block_a"), F.col("members").alias("a"))
    right = several.select(*keys, F.col("_block").alias("block_b"), F.col("members").alias("b"))
    paired = pairs.join(left, [*keys, "block_a"]).join(right, [*keys, "block_b"])
    return alone.unionByName(paired.select(alone.columns))


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix connects: one fewer than nodes in each part."""
    n = len(near)
    label = np.arange(n)
    while True:
        lowest = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        lowest = lowest[lowest]
        if (lowest == label).all():
            break
        label = lowest
    return [(i, int(label[i])) for i in np.nonzero(label != np.arange(n))[0]]
