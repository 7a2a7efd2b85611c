"""Aggregation by key that neither inflates the shuffle nor piles a hot key on one task.

A feature aggregate has hundreds of buffers, many times the width of its input row, while most
keys have a few dozen rows spread over all input files. Combining before the shuffle would then
send more bytes than the rows themselves. So rows are shuffled as they are and aggregated where
they meet, except for hot keys, which are combined map-side first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import field
from riskloom.operators.joins import HOT_ROWS, join_back
from riskloom.session import materialise
from riskloom.sources.tables import stage, stage_buckets

# Lists of hot keys up to this length are broadcast; longer ones are joined with salts.
BROADCAST_KEYS = 100_000
# Sampled rows by which a key at the limit is recognised.
_SAMPLE_HITS = 1000
ABOUT = "_about"


def not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping key is complete; the others belong to no group."""
    return df.where(reduce(lambda a, b: a & b, [field(k).isNotNull() for k in keys]))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and about how many, found on a sample of the key columns.

    The sample decides only how a key is processed, never its result. A key at the limit is
    expected ``_SAMPLE_HITS`` times and flagged from half of that. The checkpoint keeps the choice
    the same for every later task.
    """
    fraction = min(1.0, _SAMPLE_HITS / max(hot_rows, 1))
    found = not_null_keys(df.select(*[field(k) for k in keys]), keys)
    limit = hot_rows
    if fraction < 1.0:
        found, limit = found.sample(fraction, seed=7), _SAMPLE_HITS // 2
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias(ABOUT))
    return materialise(counts.where(F.col(ABOUT) > limit).withColumn(ABOUT, F.ceil(F.col(ABOUT) / fraction)))


@dataclass(frozen=True)
class Clustered:
    """Rows with a complete key, those of hot keys apart, after one search for hot keys.

    ``usual`` is clustered by the key where it is ``stored``, so that any number of aggregates by that key, or by more columns,
    read it without a shuffle. At most (all rows / HOT_ROWS) keys are ``hot``.
    """

    keys: tuple[str, ...]
    usual: DataFrame
    frequent: DataFrame | None
    hot: DataFrame
    n_hot: int
    stored: bool = False

    def select(self, change: Callable[[DataFrame], DataFrame]) -> Clustered:
        """The same clustering of rows changed one by one."""
        frequent = None if self.frequent is None else change(self.frequent)
        return replace(self, usual=change(self.usual), frequent=frequent)

    @property
    def rows(self) -> DataFrame:
        return self.usual if self.frequent is None else self.usual.unionByName(self.frequent)


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, keys_from: DataFrame | Clustered | None = None
) -> Clustered:
    """Look for hot keys once, and part the rows accordingly.

    ``keys_from`` names a cheaper table with the same rows per key to look in, or one whose hot keys are known.
    """
    keys = list(keys)
    df = not_null_keys(df, keys)
    if isinstance(keys_from, Clustered):
        hot, found = keys_from.hot, keys_from.n_hot
    else:
        hot = hot_keys(df if keys_from is None else keys_from, keys, hot_rows)
        found = hot.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return Clustered(tuple(keys), df, None, hot, found)
    if found > BROADCAST_KEYS:
        marked = join_back(df, hot.withColumn("_hot", F.lit(True)), keys, ABOUT, hot_rows)
        usual, frequent = marked.where(F.col("_hot").isNull()), marked.where(F.col("_hot"))
        return Clustered(tuple(keys), usual.drop("_hot"), frequent.drop("_hot"), hot, found)
    short = F.broadcast(hot.drop(ABOUT))
    return Clustered(tuple(keys), df.join(short, keys, "left_anti"), df.join(short, keys, "left_semi"), hot, found)


def cluster(df: DataFrame | Clustered, keys: Sequence[str], name: str, hot_rows: int = HOT_ROWS) -> Clustered:
    """Rows written once in buckets of their key for several aggregates; rows of hot keys are written as they are."""
    parted = df if isinstance(df, Clustered) else split_hot(df, keys, hot_rows)
    frequent = None if parted.frequent is None else stage(parted.frequent, f"{name}_hot")
    return replace(parted, usual=stage_buckets(parted.usual, name, keys), frequent=frequent, stored=True)


def by_key(
    df: DataFrame | Clustered,
    keys: Sequence[str],
    build: Callable[[DataFrame], DataFrame],
    hot_rows: int = HOT_ROWS,
    keys_from: DataFrame | Clustered | None = None,
    build_hot: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Apply a per-key aggregation to rows clustered by key, hot keys apart.

    ``build`` must give one row per key from any set of rows that holds whole keys. Hot keys go
    through ``build_hot`` (by default ``build``) without clustering, so that Spark combines them
    before the shuffle. ``df`` may be parted or clustered already, by these keys or by the first of them.
    """
    if isinstance(df, Clustered):
        parted = df.select(lambda rows: not_null_keys(rows, keys))
    else:
        parted = split_hot(df, keys, hot_rows, keys_from)
    usual = parted.usual if parted.stored else parted.usual.repartition(*[field(k) for k in parted.keys])
    if parted.frequent is None:
        return build(usual)
    return build(usual).unionByName((build_hot or build)(parted.frequent))
