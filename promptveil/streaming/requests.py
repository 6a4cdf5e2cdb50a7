"""The request flow over files that keep arriving.

The token bucket is keyed state; the stages after it are the batch plan over each micro-batch, which lands in the audit
table under its batch number, so a repeated micro-batch replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptveil.operators import providers
from promptveil.plans import requests as plan
from promptveil.plans.requests import Dictionaries
from promptveil.session import written
from promptveil.settings import Settings
from promptveil.sources.audit_store import write_audit
from promptveil.streaming.token_bucket import replay_stream


def audit_stream(requests: DataFrame, words: Dictionaries, settings: Settings, audit_path: str, checkpoint: str,
                 responses: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Start the flow, with stored ``responses`` or, for the provider "mock", the echo responder.

    Authenticated requests travel through the bucket as part of its rows, since a stream cannot join its own outcome
    back as the batch plan does; the rest go around it.
    """
    checked = plan.authenticated(requests, settings)
    checked = checked.withColumn("model", providers.resolved_model(F.col("model"), settings.provider_model))
    known = checked.where(F.col("auth.ok"))
    packed = known.select("request_id", F.col("auth.user_id").alias("user_id"), "ts",
                          F.to_json(F.struct(*checked.columns)).alias("row"))
    outcome = replay_stream(packed, settings.rate_capacity, settings.rate_refill_per_sec, event_id="request_id",
                            carry=("row",))
    unpacked = F.from_json("row", checked.drop("ts").schema)
    limited = (outcome.withColumn("row", unpacked)
               .select("ts", *[F.col(f"row.{c}").alias(c) for c in checked.columns if c != "ts"],
                       "allowed", "retry_after", "retry_after_header"))
    unknown = checked.where(~F.col("auth.ok")).withColumns({
        "allowed": F.lit(None).cast("boolean"), "retry_after": F.lit(None).cast("double"),
        "retry_after_header": F.lit(None).cast("int")})
    limited = limited.unionByName(unknown).withColumn("latency_ms", F.lit(None).cast("double"))

    def land(batch: DataFrame, batch_id: int) -> None:
        # the rest is the batch plan over the micro-batch, stored because more than one join may read it
        decided = plan.decided_from(written(batch, "micro-batch"), words, settings, responses)
        write_audit(plan.audit(decided, settings), audit_path, batch_id)

    return (limited.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
