"""Hourly rollups of audit rows that keep arriving, and what came too late for them.

``hourly_shares`` closes an hour when the watermark has passed it and appends its row, once for each user, to a table; so
rows of the table never change, and state is kept for open hours only. Rows behind the watermark are dropped by the
stream. ``late_counts`` finds them again: in hours that are closed, what the audit holds beyond what the table counted.
``amended`` adds both up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from promptveil.sources.audit_store import STORED

LATE = "1 hour"
SHARES = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("hour", T.TimestampType()),
                       T.StructField("n", T.LongType()), T.StructField("denied", T.LongType())])


def arriving_audit(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of an audit store as a stream, batch by batch as its files arrive. Batches must not be written anew."""
    return spark.readStream.schema(STORED).options(**options).parquet(path.rstrip("/"))


def _counts(audit: DataFrame) -> DataFrame:
    return (audit.where(F.col("jwt_valid")).groupBy("user_id", F.window("ts", "1 hour").alias("window"))
            .agg(F.count("*").alias("n"), F.count_if("rate_limited").alias("denied"))
            .select("user_id", F.col("window.start").alias("hour"), "n", "denied"))


def hourly_shares(audit: DataFrame, path: str, checkpoint: str, late: str = LATE, **trigger) -> StreamingQuery:
    """Append (user_id, hour, n, denied) of every closed hour to ``path``: requests that reached the bucket, and those it
    denied. An hour closes when a row that reached the bucket ``late`` past its end has been seen. Rows without time are in
    no hour; a null user is one of its own."""
    return (_counts(audit.withWatermark("ts", late)).writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """The closed hours."""
    return spark.read.schema(SHARES).parquet(path)


def late_counts(audit: DataFrame, shares: DataFrame) -> DataFrame:
    """(user_id, hour, n, denied) of rows that the stream dropped: those of closed hours that it did not count. Hours close
    in the order of time, for all users together, so all up to the last one in ``shares`` are closed. ``audit`` holds every
    row that has arrived."""
    last = shares.agg(F.max("hour").alias("last__"))  # one row
    closed = _counts(audit).join(last, F.col("hour") <= F.col("last__")).drop("last__")
    less = shares.select("user_id", "hour", (-F.col("n")).alias("n"), (-F.col("denied")).alias("denied"))
    return (closed.unionByName(less).groupBy("user_id", "hour").agg(F.sum("n").alias("n"), F.sum("denied").alias("denied"))
            .where("n <> 0"))


def amended(audit: DataFrame, shares: DataFrame) -> DataFrame:
    """(user_id, hour, n, denied, share) of the closed hours, late rows included."""
    both = shares.unionByName(late_counts(audit, shares))
    return both.groupBy("user_id", "hour").agg(F.sum("n").alias("n"), F.sum("denied").alias("denied")).withColumn(
        "share", F.col("denied") / F.col("n"))
