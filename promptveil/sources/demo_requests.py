"""Requests and responses derived from document, conversation and event tables, for the registered queries.

Everything that varies between rows is a rule on the row's own key, so that SQL can state the same.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET = "a-demo-signing-key-for-derived-tokens"
START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def _segment(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def minted(claims: Column, secret: str = SECRET) -> Column:
    """Tokens for claims given as JSON text."""
    @F.pandas_udf("string")
    def sign(bodies: pd.Series) -> pd.Series:
        def one(body: str) -> str:
            signed = _segment(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()) + "." + _segment(body.encode())
            return signed + "." + _segment(hmac.new(secret.encode(), signed.encode(), hashlib.sha256).digest())

        return bodies.map(one)

    return sign(claims)


# Token classes by key % 12; every other class is a good token.
HEADER_CLASSES = ("missing", "no_scheme", "expired", "tampered", "no_sub", "not_a_token", "empty_sub", "lower_scheme")


# Claims that replace a token's own, by key // 12 % 9, in class 9 (which else is a good token).
ODD_CLAIMS = ('"exp":"abc"', '"exp":[1]', '"exp":null', '"iat":"abc"', '"nbf":"1.5"', '"sub":0', '"sub":false', '"sub":[]',
              '"sub":{"a":1}')


def with_authorization(rows: DataFrame, key: Column, user: Column, ts: Column, odd: bool = False) -> DataFrame:
    """Add ``authorization``: the class is the key modulo twelve, the user and the times are the row's own. With
    ``odd``, class 9 has claims of the wrong type."""
    kind = F.pmod(key, F.lit(12))
    seconds = F.unix_seconds(ts)
    subject = F.when(kind == 4, F.lit(None)).when(kind == 6, F.lit("")).otherwise(user.cast("string"))
    expiry = F.when(kind == 2, seconds - 10).when(kind != 8, seconds + 3600)  # class 8 never ends
    claims = F.to_json(F.struct(subject.alias("sub"), expiry.alias("exp")))
    if odd:
        which = F.pmod(F.floor(key / 12), F.lit(len(ODD_CLAIMS))).cast("int")
        own = F.when(which < 5, F.concat(F.lit('"sub":"'), user.cast("string"), F.lit('",'))).otherwise(
            F.concat(F.lit('"exp":'), (seconds + 3600).cast("string"), F.lit(",")))
        claims = F.when(kind == 9, F.concat(F.lit("{"), own, F.element_at(F.lit(list(ODD_CLAIMS)), which + 1), F.lit("}"))
                        ).otherwise(claims)
    token = minted(claims)
    # flipping a middle character of the signature spoils it
    cut = F.length("token__") - 20
    spoiled = F.concat(F.substring("token__", F.lit(1), cut),
                       F.when(F.substring("token__", cut + 1, F.lit(1)) == "A", "B").otherwise("A"),
                       F.substring("token__", cut + 2, F.lit(30)))
    header = (F.when(kind == 0, F.lit(None))
              .when(kind == 1, F.col("token__"))
              .when(kind == 3, F.concat(F.lit("Bearer "), spoiled))
              .when(kind == 5, F.lit("Bearer abc"))
              .when(kind == 7, F.concat(F.lit("bearer "), F.col("token__")))
              .otherwise(F.concat(F.lit("Bearer "), F.col("token__"))))
    return rows.withColumn("token__", token).withColumn("authorization", header.cast("string")).drop("token__")


def document_requests(documents: DataFrame) -> DataFrame:
    """Each document as a request with one user message: 17 users, a request every 37 seconds."""
    doc = F.col("doc_id")
    rows = documents.select(
        F.concat(F.lit("doc-"), doc.cast("string")).alias("request_id"),
        F.timestamp_seconds(F.lit(START) + doc * 37).alias("ts"),
        F.concat(F.lit("10.0.0."), F.pmod(doc, F.lit(250)).cast("string")).alias("client_ip"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        F.when(F.pmod(doc, F.lit(3)) == 0, F.lit("")).when(F.pmod(doc, F.lit(3)) == 1, F.lit("model-a"))
        .alias("model"),
        F.when(F.pmod(doc, F.lit(5)) != 0, F.lit(256)).alias("max_tokens"),
        doc.alias("key__"),
        (F.pmod(doc, F.lit(400)) / 4.0).alias("latency_ms"))
    user = F.concat(F.lit("user-"), F.pmod(F.col("key__"), F.lit(17)).cast("string"))
    return with_authorization(rows, F.col("key__"), user, F.col("ts")).drop("key__")


def document_responses(documents: DataFrame) -> DataFrame:
    """Block-form responses. Each document answers the request before it, after two placeholders; every 13th is
    missing and the one after that an error."""
    kind = F.pmod("doc_id", F.lit(13))
    said = F.concat(F.lit("Re: [EMAIL_1] [CREDIT_CARD_1] "), F.col("text"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))).alias("content")))
    return documents.where(kind != 0).select(
        F.concat(F.lit("doc-"), (F.col("doc_id") - 1).cast("string")).alias("request_id"),
        F.when(kind == 1, F.lit(500)).otherwise(F.lit(200)).alias("http_status"), body.alias("body"))
