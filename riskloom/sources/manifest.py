"""Stages of a build that are found again: a build that died goes on where it stopped, and leaves nothing behind once it is done."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import quoted
from riskloom.session import exists, remove, shared_dir
from riskloom.sources.tables import register_buckets, write_buckets


def fingerprint_of_files(spark: SparkSession, path: str) -> str:
    """Of the names, sizes and times of all files under a path; contents are not read, and no file list is collected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    said = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    # Two independent sums of hashes: free of order, one row.
    sums = [F.sum(F.xxhash64(F.lit(seed), said).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    found = files.agg(F.count("*").cast("string"), *sums).first()
    return hashlib.sha256("|".join(str(v) for v in found).encode()).hexdigest()


class Manifest:
    """Stages of one build under one folder of the shared one, each named by what it was made from.

    A stage is complete where its writer says so, and is then read instead of made. Change ``version`` when the meaning
    of a stage changes.
    """

    def __init__(self, spark: SparkSession, build: str, version: str = "1"):
        self.spark, self.version = spark, version
        self.root = f"{shared_dir(spark).rstrip('/')}/riskloom-build/{hashlib.sha256(build.encode()).hexdigest()[:32]}"
        self.made: list[str] = []
        self.found: list[str] = []

    def key(self, name: str, *inputs: str) -> str:
        return hashlib.sha256("|".join([self.version, name, *inputs]).encode()).hexdigest()

    def stage(
        self, name: str, inputs: Sequence[str], make: Callable[[], DataFrame], keys: Sequence[str] = (), dealt: bool = False
    ) -> DataFrame:
        """The stage, read. With ``keys`` it lies in buckets, as many as it was written in."""
        path = f"{self.root}/{name}-{self.key(name, *inputs)[:32]}"
        if exists(self.spark, f"{path}/_SUCCESS"):
            self.found.append(name)
        else:
            self.made.append(name)
            df = make()
            if keys:
                buckets = write_buckets(df, f"{path}", keys, dealt)
                self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}.buckets")
            else:
                df.write.mode("overwrite").parquet(path)
        if not keys:
            return self.spark.read.parquet(path)
        written = self.spark.read.parquet(path)
        buckets = self.spark.read.parquet(f"{path}.buckets").first()["buckets"]
        return register_buckets(self.spark, path, written.schema, keys, buckets).selectExpr(*map(quoted, written.columns))

    def finish(self) -> None:
        """Remove all stages; call it once what was built from them is written."""
        remove(self.spark, self.root)
