"""Requests: reading, parsing, validating, and assembling them from message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.schemas import REQUEST, REQUEST_BODY
from promptveil.session import settled
from promptveil.settings import DEFAULT_MAX_TOKENS, MAX_TOKENS_LIMIT, ROLES

CORRUPT = "_corrupt_record"
# conversations with more messages than this stay message rows (see operators.message_rows)
MAX_MESSAGES = 10_000


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Stored requests. JSON lines that do not parse keep their text in ``_corrupt_record``."""
    if fmt == "parquet":
        return spark.read.schema(REQUEST).parquet(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    return spark.read.schema(with_corrupt(REQUEST)).option("mode", "PERMISSIVE").json(path)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """The same for a folder that files keep arriving in."""
    return spark.readStream.schema(with_corrupt(REQUEST)).option("mode", "PERMISSIVE").json(path)


def parse_bodies(texts: DataFrame, body: str) -> DataFrame:
    """Parse request bodies held as JSON text in column ``body``."""
    parsed = F.from_json(body, with_corrupt(REQUEST_BODY), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return texts.withColumn("parsed__", parsed).select(
        *[c for c in texts.columns if c != body], F.col("parsed__.*"))


def invalid_reason(corrupt: Column | None = None) -> Column:
    """Why a request is refused before anything else looks at it; null for a valid one."""
    messages, tokens = F.col("messages"), F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS))
    known_role = lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))
    checks = [
        (corrupt if corrupt is not None else F.lit(None)).isNotNull(), "not_json",
        F.coalesce(F.size(messages), F.lit(-1)) < 1, "no_messages",
        F.exists(messages, lambda m: ~known_role(m)), "bad_role",
        F.exists(messages, lambda m: m["content"].isNull()), "no_content",
        ~tokens.between(1, MAX_TOKENS_LIMIT), "bad_max_tokens",
    ]
    reason = F.when(checks[0], checks[1])
    for test, name in zip(checks[2::2], checks[3::2]):
        reason = reason.when(test, name)
    return reason


def with_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumn("max_tokens", F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS)))


def check_requests(requests: DataFrame) -> DataFrame:
    """Add ``invalid_reason`` and fill in the default of ``max_tokens``."""
    corrupt = F.col(CORRUPT) if CORRUPT in requests.columns else None
    return with_defaults(requests.withColumn("invalid_reason", invalid_reason(corrupt)))


def valid_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).where(F.col("invalid_reason").isNull()).drop("invalid_reason", CORRUPT)


def quarantined(requests: DataFrame) -> DataFrame:
    return check_requests(requests).where(F.col("invalid_reason").isNotNull())


def split_by_size(messages: DataFrame, key: str, max_messages: int = MAX_MESSAGES) -> tuple[DataFrame, DataFrame | None]:
    """(message rows of conversations that fit a row, those of longer ones or None).

    The first pass reads the key column only. There can be few long conversations, each having so many rows.
    """
    long = settled(messages.groupBy(key).count().where(F.col("count") > max_messages).select(key))
    if long is None:
        return messages, None
    return messages.join(long, key, "left_anti"), messages.join(long, key, "left_semi")


def assemble(messages: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its messages in turn order. Split off long conversations first."""
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    ordered = F.array_sort(F.collect_list(entry))
    return messages.groupBy(key).agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .alias("messages"))


def contents(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["content"])


def scan_text(messages: Column) -> Column:
    """What the ingress scan sees: all contents of all roles, joined by newlines."""
    return F.array_join(contents(messages), "\n")
