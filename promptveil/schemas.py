"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

REQUEST_BODY = T.StructType([
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("model", T.StringType()),
    T.StructField("max_tokens", T.IntegerType()),
])

# one stored request: the body plus the envelope the service would have seen
REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("authorization", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    *REQUEST_BODY.fields,
])

RESPONSE = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

SIGNATURE = T.StructType([
    T.StructField("sig_id", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("name", T.StringType()),
])

VAULT_ENTRY = "struct<label:string,idx:int,placeholder:string,original:string>"

AUDIT = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("terminating_stage", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("jwt_valid", T.BooleanType()),
    T.StructField("rate_limited", T.BooleanType()),
    T.StructField("ingress_hits", T.IntegerType()),
    T.StructField("egress_hits", T.IntegerType()),
    T.StructField("redaction_counts", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("provider", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("redacted_prompt", T.StringType()),
])
