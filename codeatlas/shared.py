"""Tables in the folder that driver and executors share, to cut lineage without relying on any executor's disk."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster that is its place on the executors, or use --py-files."""
    home, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs in one process, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="codeatlas-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor need the executors that made it.

    The files stay until `drop`, or the end of a `scratch` that they were written in.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _scope.get()) is not None:
        own.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut` returned and that nothing reads any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            delete(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is cut within: for a piece of work whose result is written elsewhere."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            delete(spark, path)


@contextmanager
def outside() -> Iterator[None]:
    """Within a `scratch`: what is cut here stays."""
    token = _scope.set(None)
    try:
        yield
    finally:
        _scope.reset(token)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with 0, 1, 2 ... in that order, which must be total: ranges are numbered apart and shifted by the sizes before them."""
    part = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dict(part.groupBy("part").count().collect())
    starts, at = [], 0
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    shift = df.sparkSession.createDataFrame(starts, "part int, shift long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return part.withColumn(name, own).join(F.broadcast(shift), "part").withColumn(name, F.col(name) + F.col("shift")).drop("part", "shift")
