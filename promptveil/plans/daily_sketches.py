"""Latencies and users per day and stage as sketches that are stored batch by batch and merged on reading.

A batch of audit rows gives one narrow row per day and stage: counts, a KLL sketch of latencies and an HLL sketch of users.
Any period is answered from these rows alone; the audit is not read again. The size of a row does not grow with the rows
it stands for, and merging sketches gives what one sketch of all rows would.

Bounds: the rank of a quantile is off by at most ``RANK_BOUND`` (three times the error that a KLL sketch of ``KLL_SIZE``
keeps to in 99 of 100 cases), a number of users by ``USERS_BOUND`` of it (four standard deviations of an HLL sketch of
2 ** ``HLL_BITS`` registers). An audit row counts in each batch that holds it, so give every row to one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.sources.batch_store import BatchStore

KLL_SIZE = 800
RANK_BOUND = 0.01
HLL_BITS = 14
USERS_BOUND = 0.04
TABLES = {"days": T.StructType([
    T.StructField("day", T.DateType()), T.StructField("stage", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("timed", T.LongType()), T.StructField("latencies", T.BinaryType()), T.StructField("users", T.BinaryType())])}


def sketch_store(spark: SparkSession, path: str) -> BatchStore:
    """The stored sketches below ``path``."""
    return BatchStore(spark, path, TABLES)


def summarised(audit: DataFrame) -> DataFrame:
    """One row per day and stage of the given audit rows. Rows without latency count in ``n`` alone, rows without user in
    no sketch of users, rows without time under the day null."""
    return (audit.select(F.to_date("ts").alias("day"), F.coalesce("terminating_stage", F.lit("none")).alias("stage"),
                         F.col("latency_ms").cast("double").alias("latency_ms"), "user_id")
            .groupBy("day", "stage")
            .agg(F.count("*").alias("n"), F.count("latency_ms").alias("timed"),
                 F.kll_sketch_agg_double("latency_ms", F.lit(KLL_SIZE)).alias("latencies"),
                 F.hll_sketch_agg("user_id", HLL_BITS).alias("users")))


def add_batch(store: BatchStore, batch: int, audit: DataFrame) -> bool:
    """Store the sketches of one batch of audit rows; False if it is there already."""
    return store.commit(batch, {"days": summarised(audit)})


def merged(days: DataFrame, *by: str) -> DataFrame:
    """Stored rows put together by any of ``day`` and ``stage``; by none, all of them in one row. Partial merges come
    before the shuffle."""
    return days.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("timed").alias("timed"),
        F.kll_merge_agg_double("latencies", F.lit(KLL_SIZE)).alias("latencies"), F.hll_union_agg("users").alias("users"))


def answers(rows: DataFrame, marks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """For merged rows: ``n``, the number of users, and the latency at each mark (``p50`` and so on; null without one)."""
    keys = [c for c in rows.columns if c in ("day", "stage")]
    at = lambda mark: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("latencies", F.lit(mark)))
    return rows.select(*keys, "n", F.hll_sketch_estimate("users").alias("users"),
                       *[at(mark).alias(f"p{mark * 100:g}") for mark in marks])
