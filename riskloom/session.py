"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the plans are written for. On a cluster pass them to spark-submit and size
# spark.sql.shuffle.partitions so that a shuffle partition holds 100-200 MB.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # One aggregate node carries a few hundred feature columns; the default of 100 fields
    # would switch whole-stage code generation off for it.
    "spark.sql.codegen.maxFields": "400",
    # The JVM never compiles a method above 8000 bytes of bytecode; a plan that generates one runs
    # faster on Spark's split-up projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans of a thousand columns are built here; recording the Python call site of each column
    # operation would take longer than analysing them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_own_dirs: dict[str, str] = {}


def build_session(app_name: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = SESSION_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would lose data with its executor, so that raises instead.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="riskloom-")
        configured = _own_dirs[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


@contextmanager
def compiled_settings(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside the block make no methods that the JVM leaves uncompiled, whatever the session was started with."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, SESSION_CONF[name])
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small result: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused between runs."""
    scope = f"{_scopes[-1]}/" if _scopes else ""
    return f"{shared_dir(spark).rstrip('/')}/riskloom-stage/{scope}{uuid.uuid4().hex}/{name}"


_scopes: list[str] = []


@contextmanager
def stages_removed(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside the block are removed when it ends, with or without an error.

    What the block returns must not read them: write the result first.
    """
    _scopes.append(uuid.uuid4().hex)
    folder = f"{shared_dir(spark).rstrip('/')}/riskloom-stage/{_scopes[-1]}"
    try:
        yield
    finally:
        _scopes.pop()
        remove(spark, folder)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own, if it is there."""
    files, where = _file_system(spark, path)
    files.delete(where, True)
