"""Provider request bodies, response parsing, and the join of requests with stored responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.settings import DEFAULT_MODEL

# Provider names, the echo prefix and messages that must agree.
ECHO_PREFIX = "[mock-echo] "
UPSTREAM_ERROR = "Upstream provider error."
UPSTREAM_MISSING = "Upstream provider unavailable."


def resolved_model(model: Column, default: str = DEFAULT_MODEL) -> Column:
    """The request's model; null and empty mean the default."""
    return F.coalesce(F.nullif(model, F.lit("")), F.lit(default))


def block_body(messages: Column, model: Column, max_tokens: Column) -> Column:
    """JSON body of the form that takes the system text beside the turns (and leaves it out when empty)."""
    system = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n")
    turns = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.to_json(F.struct(model.alias("model"), max_tokens.alias("max_tokens"), turns.alias("messages"),
                              F.nullif(system, F.lit("")).alias("system")))


def choice_body(messages: Column, model: Column, max_tokens: Column) -> Column:
    """JSON body of the form that takes all messages inline."""
    return F.to_json(F.struct(model.alias("model"), max_tokens.alias("max_tokens"), messages.alias("messages")))


def block_text(body: Column) -> Column:
    """Text of a block-form response: its text blocks joined, empty when there is none."""
    blocks = F.from_json(body, "content array<struct<type:string,text:string>>")["content"]
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def choice_text(body: Column) -> Column:
    """Text of a choice-form response: the first choice's content, empty when there is none."""
    choices = F.from_json(body, "choices array<struct<message:struct<content:string>>>")["choices"]
    return F.coalesce(F.get(choices, F.lit(0))["message"]["content"], F.lit(""))


def echo_text(messages: Column) -> Column:
    """The stand-in responder: it repeats the last user message."""
    said = F.filter(messages, lambda m: m["role"] == "user")
    return F.concat(F.lit(ECHO_PREFIX), F.coalesce(F.try_element_at(said, F.lit(-1))["content"], F.lit("")))


@dataclass(frozen=True)
class ProviderForm:
    name: str
    body: Callable[[Column, Column, Column], Column] | None
    text: Callable[[Column], Column] | None


# The names that select a form.
FORMS = {
    "mock": ProviderForm("mock", None, None),
    "anthropic": ProviderForm("anthropic", block_body, block_text),
    "openai": ProviderForm("openai", choice_body, choice_text),
}


def provider_form(name: str) -> ProviderForm:
    try:
        return FORMS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown provider {name!r}; expected one of {sorted(FORMS)}") from None


def request_bodies(requests: DataFrame, provider: str, default_model: str = DEFAULT_MODEL) -> DataFrame:
    """(request_id, body): the file to send. Keys and headers are the sender's business and never stored."""
    form = provider_form(provider)
    if form.body is None:
        raise ValueError(f"provider {form.name!r} takes no request files")
    return requests.select("request_id", form.body(F.col("messages"), resolved_model(F.col("model"), default_model),
                                                   F.col("max_tokens")).alias("body"))


def with_responses(requests: DataFrame, responses: DataFrame, provider: str) -> DataFrame:
    """Add ``response_text`` and ``proxy_detail`` (null where a good response has arrived) by request_id.

    A request sent more than once has several responses: a good one counts before any other, then the lowest status,
    one without a status last.
    """
    form = provider_form(provider)
    if form.text is None:
        raise ValueError(f"provider {form.name!r} gives no response files")
    rank = F.struct(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), F.col("http_status").isNull(),
                    "http_status", "body")
    one = responses.groupBy("request_id").agg(F.min_by(F.struct("http_status", "body"), rank).alias("response__"))
    good = F.coalesce(F.col("response__.http_status").between(200, 299), F.lit(False))
    return (requests.join(one, "request_id", "left")
            .withColumn("proxy_detail", F.when(F.col("response__").isNull(), UPSTREAM_MISSING)
                        .when(~good, UPSTREAM_ERROR))
            .withColumn("response_text", F.when(good, form.text(F.col("response__.body"))))
            .drop("response__"))
