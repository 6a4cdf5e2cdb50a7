"""Shared folder and bounded-read helpers."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, Row, SparkSession


FEW_SPLITS = 64
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="promptveil-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for one run's tables."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fix(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably so that later readers see the same rows even if executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read back, so that several uses do its work once."""
    folder = run_folder(df.sparkSession, name)
    if (passing_ones := _PASSING.get()) is not None:
        passing_ones.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``written`` stores inside is removed at the end, for work whose results are stored by then. The JVM collects its
    garbage too, as shuffle files stay until it does."""
    folders: list[str] = []
    outer = _PASSING.set(folders)
    try:
        yield
    finally:
        _PASSING.reset(outer)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark._jvm.System.gc()


def read_bounded(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows when there are at most ``limit`` of them, otherwise None (the caller then joins)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def settled(df: DataFrame, limit: int = 100_000) -> DataFrame | None:
    """The rows of a small summary, worked out once: kept in the plan up to ``limit`` rows, stored beyond; None when
    there are none."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return fix(df)
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows else None


def spread(df: DataFrame) -> DataFrame:
    """Use more cores for a small input: splits can be fewer than cores, and all but one of a file with a single row group
    are empty. Inputs of ``FEW_SPLITS`` or more, some gigabytes, stay as they were read."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def worker_cache() -> dict:
    """A dictionary of this process. Functions reach workers by value, so a global of theirs would start anew with
    every task; what is slow to build stays here from task to task."""
    name = "_promptveil_worker_cache"
    if name not in sys.modules:
        holder = types.ModuleType(name)
        holder.kept = {}
        sys.modules[name] = holder
    return sys.modules[name].kept
