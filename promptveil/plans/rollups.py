"""Audit rollups. All are hash aggregates that combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_decision(audit: DataFrame) -> DataFrame:
    """Requests by day, stage and status, with subtotals per (day, stage), per day, and in all."""
    days = audit.select(F.to_date("ts").alias("day"), F.coalesce("terminating_stage", F.lit("none")).alias("stage"),
                        "status_code")
    return (days.rollup("day", "stage", "status_code")
            .agg(F.count("*").alias("n"), F.grouping_id().alias("level")))


def by_user(audit: DataFrame) -> DataFrame:
    """Hits and redactions per user."""
    redactions = F.aggregate(F.map_values("redaction_counts"), F.lit(0), lambda total, n: total + n)
    return audit.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("ingress_hits").alias("ingress_hits"),
        F.sum("egress_hits").alias("egress_hits"), F.sum(redactions).alias("redactions"))


def by_label(audit: DataFrame) -> DataFrame:
    """Redactions and requests per label."""
    return (audit.select(F.explode("redaction_counts").alias("label", "n"))
            .groupBy("label").agg(F.sum("n").alias("redactions"), F.count("*").alias("requests")))


def denied_share(audit: DataFrame) -> DataFrame:
    """Per user and hour: requests that reached the bucket, and the share it denied. Also runs on a stream."""
    return (audit.where(F.col("jwt_valid"))
            .groupBy("user_id", F.window("ts", "1 hour").alias("hour"))
            .agg(F.count("*").alias("n"), F.count_if("rate_limited").alias("denied"))
            .select("user_id", F.col("hour.start").alias("hour"), "n", "denied",
                    (F.col("denied") / F.col("n")).alias("share")))


def latency(audit: DataFrame) -> DataFrame:
    """Latency percentiles per stage, from a mergeable summary of bounded size."""
    marks = F.percentile_approx("latency_ms", F.lit([0.5, 0.95, 0.99]), 10_000)
    return (audit.groupBy(F.coalesce("terminating_stage", F.lit("none")).alias("stage"))
            .agg(F.count("latency_ms").alias("n"), marks.alias("marks"))
            .select("stage", "n", F.get("marks", F.lit(0)).alias("p50"), F.get("marks", F.lit(1)).alias("p95"),
                    F.get("marks", F.lit(2)).alias("p99")))
