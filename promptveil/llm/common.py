"""Table access and batch sizes shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from promptveil.session import worker_cache  # noqa: F401  for the operators here

BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session sending Python workers few rows and bytes at a time: texts may be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8, one at a time; null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def pieces(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at ASCII white space, so that words stay whole."""
    start = 0
    while len(data) - start > size:
        cut = _SPACE.search(data, start + size)
        if cut is None:
            break
        yield data[start:cut.start()]
        start = cut.start()
    yield data[start:] if start else data


def give_back() -> None:
    """Returns what a task has freed to the system: workers live on, and other stages need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)
