"""The request flow for requests kept as message rows, because they may be too long for one row.

Inputs are an envelope table (request_id, ts, authorization, client_ip, model, max_tokens) and a message table
(request_id, msg_idx, role, content). Only counts, the answer and the values the answer refers to are brought together
per request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptveil.functions.patterns import PLACEHOLDER
from promptveil.functions.text import extract_all
from promptveil.operators import auth, decisions, message_rows, providers, redact, scan, token_bucket
from promptveil.schemas import VAULT_ENTRY
from promptveil.session import written
from promptveil.settings import MAX_TOKENS_LIMIT, ROLES, Settings
from promptveil.sources.requests import with_defaults


@dataclass(frozen=True)
class LongOutcome:
    decided: DataFrame   # one row per valid request, as from the whole-row flow but without texts
    messages: DataFrame  # scrubbed messages of the requests that got past the ingress scan
    vault: DataFrame     # (request_id, label, idx, placeholder, original)


def valid_envelopes(envelopes: DataFrame, messages: DataFrame) -> DataFrame:
    """Envelopes whose limits and messages are all in order."""
    bad = (~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))) | F.col("content").isNull()
    sound = messages.groupBy("request_id").agg(F.count_if(bad).alias("bad")).where(F.col("bad") == 0)
    return (with_defaults(envelopes).where(F.col("max_tokens").between(1, MAX_TOKENS_LIMIT))
            .join(sound.select("request_id"), "request_id", "left_semi"))


def metered_envelopes(envelopes: DataFrame, messages: DataFrame, settings: Settings) -> DataFrame:
    """Valid envelopes with ``auth`` and the bucket's outcome, stored."""
    checked = auth.authenticate(valid_envelopes(envelopes, messages), settings, F.col("ts"))
    checked = written(checked.withColumn("model", providers.resolved_model(F.col("model"), settings.provider_model)),
                      "envelope")
    takers = checked.where(F.col("auth.ok")).select("request_id", F.col("auth.user_id").alias("user_id"), "ts")
    outcomes = token_bucket.replay(takers, settings.rate_capacity, settings.rate_refill_per_sec, event_id="request_id")
    return written(checked.join(outcomes.select("request_id", "allowed", "retry_after", "retry_after_header"),
                                "request_id", "left"), "metered")


def decide_long(envelopes: DataFrame, messages: DataFrame, injection: DataFrame, internal: DataFrame,
                settings: Settings, responses: DataFrame | None = None, names: DataFrame | None = None) -> LongOutcome:
    """``injection`` and ``internal`` are signature tables, ``names`` a name list if entities are to be redacted.
    Request ids are unique."""
    return decide_limited(metered_envelopes(envelopes, messages, settings), messages, injection, internal, settings,
                          responses, names)


def decide_limited(limited: DataFrame, messages: DataFrame, injection: DataFrame, internal: DataFrame, settings: Settings,
                   responses: DataFrame | None = None, names: DataFrame | None = None) -> LongOutcome:
    """The stages after the bucket."""
    admitted = limited.where(F.col("allowed")).select("request_id")
    threats = message_rows.hit_counts(messages.join(admitted, "request_id", "left_semi"), injection)
    gated = written(limited.join(threats.withColumnRenamed("n_hits", "ingress_hits"), "request_id", "left")
                    .fillna(0, ["ingress_hits"]), "gated")
    live = gated.where(F.col("allowed") & (F.col("ingress_hits") == 0))

    texts, vault = message_rows.redact_messages(messages.join(live.select("request_id"), "request_id", "left_semi"))
    if names is not None:
        texts, named = message_rows.redact_names(written(texts, "scrubbed"), names)
        vault = vault.unionByName(named)
    vault = written(vault, "vault")
    if settings.provider.lower() == "mock":
        said = texts.where(F.col("role") == "user").groupBy("request_id").agg(
            F.max_by("content", "msg_idx").alias("said"))
        replied = live.join(said, "request_id", "left").select(
            "request_id", F.lit(None).cast("string").alias("proxy_detail"),
            F.concat(F.lit(providers.ECHO_PREFIX), F.coalesce("said", F.lit(""))).alias("response_text"))
    else:
        replied = providers.with_responses(live.select("request_id"), responses, settings.provider)
    replied = written(replied, "replied")
    answers = replied.where(F.col("response_text").isNotNull())
    leaks = scan.hit_counts(answers, internal, "request_id", "response_text").withColumnRenamed("n_hits", "egress_hits")

    # of a long vault only what the answer refers to
    tokens = answers.select("request_id", F.explode(F.array_distinct(
        extract_all(F.col("response_text"), PLACEHOLDER))).alias("placeholder"))
    used = tokens.join(vault, ["request_id", "placeholder"]).groupBy("request_id").agg(
        F.collect_list(F.struct("label", "idx", "placeholder", "original")).alias("used"))
    counts = message_rows.label_counts(vault).groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.col("n").cast("int").alias("n")))).alias("counts"))

    none = F.array().cast(f"array<{VAULT_ENTRY}>")
    joined = gated
    for part in (replied, leaks, used, counts):
        joined = joined.join(part, "request_id", "left")
    joined = joined.withColumns({"egress_hits": F.coalesce("egress_hits", F.lit(0)), "used": F.coalesce("used", none)})
    passed = F.col("response_text").isNotNull() & (F.col("egress_hits") == 0)
    joined = joined.withColumn("restored_text", F.when(passed, redact.restore("response_text", "used")))
    if "latency_ms" not in joined.columns:
        joined = joined.withColumn("latency_ms", F.lit(None).cast("double"))
    return LongOutcome(decisions.decide(joined), texts, vault)


def audit_rows(outcome: LongOutcome, provider: str) -> DataFrame:
    """Audit rows; the scrubbed prompt of a long request is its message table, never a column."""
    return decisions.audit_rows(outcome.decided, provider, counts=F.coalesce(
        "counts", F.create_map().cast("map<string,int>")))
