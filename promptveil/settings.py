"""Job settings. Passed explicitly to the plans; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults and names that results must agree with.
DEFAULT_MODEL = "claude-3-5-sonnet-20241022"
DEFAULT_MAX_TOKENS = 1024
MAX_TOKENS_LIMIT = 32000
ROLES = ("system", "user", "assistant")
PLACEHOLDER_SECRET = "dev-insecure-secret-change-me"
HMAC_ALGORITHMS = ("HS256", "HS384", "HS512")
ENTITY_LABELS = ("PERSON", "GPE", "LOC", "ORG")


@dataclass(frozen=True)
class Settings:
    # identity
    jwt_secret: str = PLACEHOLDER_SECRET
    jwt_algorithm: str = "HS256"
    jwt_audience: str | None = None
    jwt_issuer: str | None = None
    # token bucket
    rate_capacity: int = 20
    rate_refill_per_sec: float = 5.0
    # entity redaction
    entity_labels: tuple[str, ...] = ENTITY_LABELS
    # provider form
    provider: str = "mock"
    provider_model: str = DEFAULT_MODEL
    # audit
    store_redacted_prompt: bool = False
