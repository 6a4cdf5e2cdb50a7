"""The request flow for requests of any size: one call that splits them, runs both routes and unites the results.

Inputs are those of ``long_requests``. Tokens are taken once for all requests; then requests that fit a row go through
the whole-row stages and the others through the message-row stages. Both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptveil.operators import decisions, entities, message_rows, redact, scan
from promptveil.plans import long_requests
from promptveil.plans.requests import Dictionaries, decided_from
from promptveil.session import written
from promptveil.settings import Settings
from promptveil.sources.requests import MAX_MESSAGES, assemble

MAX_BYTES = 64 << 20
COLUMNS = ("request_id", "ts", "auth", "client_ip", "model", "max_tokens", "latency_ms", "allowed", "retry_after_header",
           "ingress_hits", "egress_hits", "proxy_detail", "response_text", "restored_text", "stage", "decision",
           "status_code", "detail", "headers", "counts")


@dataclass(frozen=True)
class Outcome:
    decided: DataFrame   # one row per valid request: COLUMNS
    messages: DataFrame  # (request_id, pos from 0, role, content): scrubbed, of requests past the ingress scan
    vault: DataFrame     # (request_id, label, idx, placeholder, original)


def decide_all(envelopes: DataFrame, messages: DataFrame, injection: DataFrame, internal: DataFrame, settings: Settings,
               responses: DataFrame | None = None, names: DataFrame | None = None, max_messages: int = MAX_MESSAGES,
               max_bytes: int = MAX_BYTES) -> Outcome:
    """Requests over ``max_messages`` messages or ``max_bytes`` bytes of content stay message rows."""
    limited = long_requests.metered_envelopes(envelopes, messages, settings)
    if "latency_ms" not in limited.columns:
        limited = limited.withColumn("latency_ms", F.lit(None).cast("double"))
    size = messages.groupBy("request_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    long = written(size.where((F.col("n") > max_messages) | (F.col("bytes") > max_bytes)).select("request_id"), "long")
    none = F.create_map().cast("map<string,int>")

    words = Dictionaries(scan.usable(injection), scan.usable(internal), None if names is None else entities.usable(names))
    whole = assemble(messages.join(long, "request_id", "left_anti"), "request_id", "msg_idx", "role", "content")
    rows = written(decided_from(limited.join(whole, "request_id"), words, settings, responses), "decided")
    texts = F.arrays_zip(F.col("messages.role").alias("role"), F.col("scrubbed_texts").alias("content"))
    said = rows.select("request_id", F.posexplode(F.when(F.col("scrubbed_texts").isNotNull(), texts)).alias("pos", "m")).select(
        "request_id", "pos", "m.role", "m.content")
    held = redact.vault_rows(rows, "request_id").select("request_id", "label", "idx", "placeholder", "original")
    decided = rows.withColumn("counts", redact.counts_by_label(F.col("vault"))).select(*COLUMNS)

    rest = long_requests.decide_limited(limited.join(long, "request_id", "left_semi"),
                                        messages.join(long, "request_id", "left_semi"), injection, internal, settings,
                                        responses, names)
    placed = message_rows.positions(written(rest.messages, "messages")).select(
        "request_id", (F.col("pos__") - 1).cast("int").alias("pos"), "role", "content")
    more = rest.decided.withColumn("counts", F.coalesce("counts", none)).select(*COLUMNS)
    return Outcome(decided.unionByName(more), said.unionByName(placed), held.unionByName(rest.vault.select(*held.columns)))


def audit_rows(outcome: Outcome, provider: str) -> DataFrame:
    """Audit rows; scrubbed prompts are the message table."""
    return decisions.audit_rows(outcome.decided, provider, counts=F.col("counts"))
