"""One decision per request, and the audit row made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.operators.redact import counts_by_label

# Stages in order with their status, and messages that must agree.
STAGES = {"auth": 401, "ratelimit": 429, "threatscan": 403, "proxy": 502, "egress": 502}
RATE_DETAIL = "Rate limit exceeded."
THREAT_DETAIL = "Request blocked: prohibited content detected."
LEAK_DETAIL = "Response blocked: potential internal-data leak detected."


def first_failure(failed: dict[str, Column]) -> Column:
    """Name of the first stage, in order, whose test is true; null when none is."""
    stage = F.lit(None).cast("string")
    for name in reversed(STAGES):
        if name in failed:
            stage = F.when(F.coalesce(failed[name], F.lit(False)), F.lit(name)).otherwise(stage)
    return stage


def status_of(stage: Column) -> Column:
    status = F.when(stage.isNull(), F.lit(200))
    for name, code in STAGES.items():
        status = status.when(stage == name, F.lit(code))
    return status


def reached(stage: Column, name: str) -> Column:
    """True if the request got past every stage before ``name``."""
    earlier = list(STAGES)[:list(STAGES).index(name)]
    return stage.isNull() | ~stage.isin(*earlier) if earlier else F.lit(True)


def decide(checked: DataFrame) -> DataFrame:
    """Add ``stage`` (the terminating one), ``decision``, ``status_code``, ``detail`` and ``headers``.

    Expects auth, allowed, retry_after_header, ingress_hits, proxy_detail, egress_hits.
    """
    stage = first_failure({
        "auth": ~F.col("auth.ok"),
        "ratelimit": ~F.col("allowed"),
        "threatscan": F.col("ingress_hits") > 0,
        "proxy": F.col("proxy_detail").isNotNull(),
        "egress": F.col("egress_hits") > 0,
    })
    out = checked.withColumn("stage", stage)
    detail = (F.when(F.col("stage") == "auth", F.col("auth.detail"))
              .when(F.col("stage") == "ratelimit", F.lit(RATE_DETAIL))
              .when(F.col("stage") == "threatscan", F.lit(THREAT_DETAIL))
              .when(F.col("stage") == "proxy", F.col("proxy_detail"))
              .when(F.col("stage") == "egress", F.lit(LEAK_DETAIL)))
    headers = F.when(F.col("stage") == "ratelimit", F.create_map(
        F.lit("Retry-After"), F.col("retry_after_header").cast("string"))).otherwise(F.create_map())
    return out.withColumns({
        "decision": F.when(F.col("stage").isNull(), F.lit("allowed")).otherwise(F.lit("rejected")),
        "status_code": status_of(F.col("stage")),
        "detail": detail,
        "headers": headers.cast("map<string,string>"),
    })


def audit_rows(decided: DataFrame, provider: str, store_redacted_prompt: bool = False,
               counts: Column | None = None) -> DataFrame:
    """The audit row of each request. Fields of stages a request did not get to keep their defaults, and no text or
    original value is in it unless the scrubbed prompt was asked for. ``counts`` are taken from the vault if not given.
    """
    counts = counts_by_label(F.col("vault")) if counts is None else counts
    stage = F.col("stage")
    no_counts = F.create_map().cast("map<string,int>")
    scrubbed = reached(stage, "proxy")
    prompt = F.when(scrubbed, F.array_join("scrubbed_texts", "\n")) if store_redacted_prompt else F.lit(None)
    return decided.select(
        "request_id", "ts",
        F.col("auth.user_id").alias("user_id"),
        "client_ip", "decision", stage.alias("terminating_stage"), "status_code",
        F.col("auth.ok").alias("jwt_valid"),
        F.coalesce(stage == "ratelimit", F.lit(False)).alias("rate_limited"),
        F.when(reached(stage, "threatscan"), F.col("ingress_hits")).otherwise(0).cast("int").alias("ingress_hits"),
        F.when(reached(stage, "egress"), F.col("egress_hits")).otherwise(0).cast("int").alias("egress_hits"),
        F.when(scrubbed, counts).otherwise(no_counts).alias("redaction_counts"),
        F.lit(provider).alias("provider"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        prompt.cast("string").alias("redacted_prompt"))


def responses_out(decided: DataFrame) -> DataFrame:
    """What the callers of allowed requests get back."""
    return decided.where(F.col("stage").isNull()).select(
        "request_id", "model", F.col("restored_text").alias("content"), F.size("vault").alias("redactions"))


def rejections_out(decided: DataFrame) -> DataFrame:
    """What the callers of rejected requests get back; the request id is internal and left blank."""
    return decided.where(F.col("stage").isNotNull()).select(
        F.lit("").alias("request_id"), "stage", "status_code", "detail", "headers")
