"""The whole request flow as one batch plan.

Stages are columns: nothing stops a request, but each costly stage looks only at requests that got that far. Texts are
exchanged once, on request_id, which the bucket's outcome and the response join share; all other exchanges are of narrow
columns, and scan, redaction and restoration are projections. Request ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptveil.operators import auth, decisions, entities, providers, redact, scan, token_bucket
from promptveil.schemas import VAULT_ENTRY
from promptveil.session import written
from promptveil.settings import Settings
from promptveil.sources.requests import CORRUPT, contents, scan_text, valid_requests, with_defaults


@dataclass(frozen=True)
class Dictionaries:
    """The two signature sets, and the name list if entities are to be redacted (None: they are not). Each is held in
    the plan or, when it is too large for that, a table that the flow joins; ``scan.usable`` and ``entities.usable``
    choose, and the results are the same."""

    injection: scan.Dictionary | DataFrame
    internal: scan.Dictionary | DataFrame
    names: entities.Gazetteer | DataFrame | None = None

    def __post_init__(self):
        if self.injection is None or self.internal is None:
            raise TypeError("a signature set is missing; scan.usable() gives one for a table of any size")

    @property
    def joined(self) -> bool:
        return any(isinstance(words, DataFrame) for words in (self.injection, self.internal, self.names))


def authenticated(requests: DataFrame, settings: Settings) -> DataFrame:
    return auth.authenticate(valid_requests(requests), settings, F.col("ts"))


def metered(requests: DataFrame, settings: Settings) -> DataFrame:
    """Valid requests with ``auth`` and the bucket's outcome.

    Only authenticated requests take tokens; later stages do not give them back. Validity and tokens are checked once,
    into a narrow table that the bucket reads and that the requests are then joined with.
    """
    envelope = written(authenticated(requests, settings).select("request_id", "ts", "auth"), "envelope")
    takers = envelope.where(F.col("auth.ok")).select("request_id", F.col("auth.user_id").alias("user_id"), "ts")
    outcomes = token_bucket.replay(takers, settings.rate_capacity, settings.rate_refill_per_sec, event_id="request_id")
    known = envelope.join(outcomes.select("request_id", "allowed", "retry_after", "retry_after_header"),
                          "request_id", "left")
    return with_defaults(requests).drop("ts", "authorization", CORRUPT).join(known, "request_id")


def scanned_and_scrubbed(limited: DataFrame, words: Dictionaries) -> DataFrame:
    """Add ``ingress_hits`` for requests with a token, and ``scrubbed_texts`` and ``vault`` for those without a hit."""
    out = scan.counted(limited, scan_text(F.col("messages")), words.injection, F.coalesce("allowed", F.lit(False)),
                       "request_id", "ingress_hits")
    live = F.col("allowed") & (F.col("ingress_hits") == 0)
    out = redact.scrub_into(out, F.when(live, contents(F.col("messages"))), "scrubbed__")
    if isinstance(words.names, DataFrame):
        out = entities.joined_scrubbed(out, words.names, "scrubbed__")
    elif words.names is not None:
        out = out.withColumn("scrubbed__", F.when(live, entities.gazetteer_scrubbed(
            words.names, "scrubbed__.texts", "scrubbed__.vault")))
    return out.select(
        *limited.columns, "ingress_hits",
        F.col("scrubbed__.texts").alias("scrubbed_texts"),
        F.coalesce("scrubbed__.vault", F.array().cast(f"array<{VAULT_ENTRY}>")).alias("vault"))


def scrubbed_messages(scrubbed: DataFrame) -> DataFrame:
    """The messages as the provider may see them."""
    return scrubbed.withColumn("messages", F.zip_with("messages", "scrubbed_texts", lambda m, text: F.struct(
        m["role"].alias("role"), text.alias("content"))))


def answered(scrubbed: DataFrame, responses: DataFrame | None, settings: Settings) -> DataFrame:
    """Add ``response_text`` and ``proxy_detail``, from stored responses or from the echo responder."""
    if settings.provider.lower() == "mock":
        said = providers.echo_text(F.zip_with("messages", "scrubbed_texts", lambda m, text: F.struct(
            m["role"].alias("role"), text.alias("content"))))
        live = F.col("scrubbed_texts").isNotNull()
        return scrubbed.withColumns({"response_text": F.when(live, said),
                                     "proxy_detail": F.lit(None).cast("string")})
    return providers.with_responses(scrubbed, responses, settings.provider)


def filtered(replied: DataFrame, words: Dictionaries) -> DataFrame:
    """Add ``egress_hits`` on the response as it came, and ``restored_text``."""
    live = F.col("scrubbed_texts").isNotNull() & F.col("response_text").isNotNull()
    out = scan.counted(replied, F.col("response_text"), words.internal, live, "request_id", "egress_hits")
    passed = live & (F.col("egress_hits") == 0)
    return out.withColumn("restored_text", F.when(passed, redact.restore("response_text")))


def decided_requests(requests: DataFrame, words: Dictionaries, settings: Settings,
                     responses: DataFrame | None = None) -> DataFrame:
    """Every valid request with all stage results and its decision."""
    limited = metered(requests, settings)
    if "latency_ms" not in limited.columns:
        limited = limited.withColumn("latency_ms", F.lit(None).cast("double"))
    limited = limited.withColumn("model", providers.resolved_model(F.col("model"), settings.provider_model))
    return decided_from(written(limited, "metered") if words.joined else limited, words, settings, responses)


def decided_from(limited: DataFrame, words: Dictionaries, settings: Settings, responses: DataFrame | None = None) -> DataFrame:
    """The stages after the bucket. Tables of words are joined with rows that are then read more than once, so those are
    stored on the way."""
    scrubbed = scanned_and_scrubbed(limited, words)
    if words.joined:
        scrubbed = written(scrubbed, "scrubbed")
    replied = answered(scrubbed, responses, settings)
    if isinstance(words.internal, DataFrame):
        replied = written(replied, "replied")
    return decisions.decide(filtered(replied, words))


def audit(decided: DataFrame, settings: Settings) -> DataFrame:
    """The audit rows as the settings want them."""
    return decisions.audit_rows(decided, settings.provider, settings.store_redacted_prompt)


def stored(decided: DataFrame) -> DataFrame:
    """Write decided requests to the run's folder and read them back.

    The audit, the vault, the responses and the rejections are then projections of one stored table; taken from the
    plan itself each would repeat the scans, and a filter on a result would be pushed into them. The table holds
    original values: keep the folder as protected as the vault.
    """
    return written(decided, "decided")
