"""Bearer tokens in request logs: outcome, user and reason per request."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.functions.text import bind
from promptveil.settings import HMAC_ALGORITHMS, PLACEHOLDER_SECRET, Settings

# Messages that must agree.
DETAILS = {
    "missing_header": "Missing Authorization header.",
    "malformed_header": "Authorization header must be 'Bearer <token>'.",
    "malformed_token": "Invalid token: Not enough segments",
    "bad_header": "Invalid token: Invalid header string",
    "bad_algorithm": "Invalid token: The specified alg value is not allowed",
    "bad_signature": "Invalid token signature.",
    "bad_payload": "Invalid token: Invalid payload string: must be a json object",
    "missing_sub": 'Invalid token: Token is missing the "sub" claim',
    "bad_iat": "Invalid token: Issued At claim (iat) must be an integer.",
    "bad_nbf": "Invalid token: Not Before claim (nbf) must be an integer.",
    "bad_exp": "Invalid token: Expiration Time claim (exp) must be an integer.",
    "not_yet_valid": "Invalid token: The token is not yet valid",
    "expired": "Token has expired.",
    "bad_issuer": "Invalid token: Invalid issuer",
    "bad_audience": "Invalid token: Audience doesn't match",
    "empty_sub": "Token missing 'sub' claim.",
    "bad_sub": "Invalid token: Subject must be a string",
}


def _segment_text(segment: Column) -> Column:
    padded = F.rpad(F.translate(segment, "-_", "+/"), (F.ceil(F.length(segment) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def _claim_kinds(segment: Column, names: tuple[str, ...]) -> Column:
    """The JSON type of each claim, null for one that is not there: a null claim differs from a missing one."""
    document = F.try_parse_json(_segment_text(segment))
    return F.struct(*[F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant")).alias(name)
                      for name in names])


def _json_segment(segment: Column, schema: str) -> Column:
    """A base64url JSON segment as a struct; null when it is not one."""
    text = _segment_text(segment)
    parsed = F.from_json(text, f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad"})
    return F.when(text.startswith("{"), parsed)


def signature_check(secret: str, algorithm: str):
    """Vectorized HMAC check. The key travels in the function's closure, so no plan, UI or event log shows it."""
    digest = {"HS256": hashlib.sha256, "HS384": hashlib.sha384, "HS512": hashlib.sha512}[algorithm]
    key = secret.encode()

    def good(signed: str | None, signature: str | None) -> bool:
        if signed is None or signature is None:
            return False
        try:
            given = base64.urlsafe_b64decode(signature + "=" * (-len(signature) % 4))
        except (binascii.Error, ValueError):
            return False
        return hmac.compare_digest(hmac.new(key, signed.encode(), digest).digest(), given)

    @F.pandas_udf("boolean")
    def check(signed: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([good(a, b) for a, b in zip(signed, signature)], dtype=bool)

    return check


def authenticate(requests: DataFrame, settings: Settings, as_of: Column, header: str = "authorization") -> DataFrame:
    """Replace the header column by ``auth`` (ok, user_id, reason, detail, never_expires).

    Times are checked against ``as_of``, the time of the log line, so that a re-run gives the same outcome.
    """
    if settings.jwt_secret == PLACEHOLDER_SECRET:
        raise ValueError("set jwt_secret: tokens signed with the placeholder secret can be forged")
    if settings.jwt_algorithm not in HMAC_ALGORITHMS:
        raise ValueError(f"jwt_algorithm must be one of {HMAC_ALGORITHMS}")
    check = signature_check(settings.jwt_secret, settings.jwt_algorithm)

    parts = F.split(F.col(header), " ", 2)
    scheme, token = F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    token = F.when((scheme == "bearer") & (token != ""), token)
    segments = F.split("token__", r"\.", -1)
    signed = F.when(F.size(segments) == 3, F.concat_ws(".", F.get(segments, F.lit(0)), F.get(segments, F.lit(1))))
    out = (requests.withColumn("token__", token)
           .withColumn("good__", check(signed, F.get(segments, F.lit(2)))))

    claims = "sub string, exp string, nbf string, iat string, aud string, iss string"
    state = F.struct(
        F.size(segments).alias("segments"),
        _json_segment(F.get(segments, F.lit(0)), "alg string").alias("header"),
        _json_segment(F.get(segments, F.lit(1)), claims).alias("claims"),
        _claim_kinds(F.get(segments, F.lit(1)), ("sub", "iat", "nbf", "exp")).alias("kinds"),
        as_of.cast("timestamp").cast("double").alias("now"))
    auth = bind(state, lambda s: _outcome(F.col(header), F.col("token__"), F.col("good__"), s, settings))
    return out.withColumn("auth", auth).drop(header, "token__", "good__")


def _outcome(header: Column, token: Column, good: Column, state: Column, settings: Settings) -> Column:
    claims, now = state["claims"], state["now"]
    whole = {name: F.floor(claims[name].try_cast("double")) for name in ("exp", "nbf", "iat")}
    audiences = F.when(claims["aud"].startswith("["), F.from_json(claims["aud"], "array<string>")) \
        .otherwise(F.array(claims["aud"]))
    if settings.jwt_audience is None:
        wrong_audience = claims["aud"].isNotNull()
    else:
        wrong_audience = claims["aud"].isNull() | ~F.array_contains(audiences, F.lit(settings.jwt_audience))
    wrong_issuer = F.lit(False) if settings.jwt_issuer is None else ~claims["iss"].eqNullSafe(settings.jwt_issuer)
    late = lambda name: F.coalesce(whole[name] > now, F.lit(False))
    kinds = state["kinds"]

    def no_number(name: str) -> Column:
        """A time that is there but no number: text must hold a whole one."""
        text = (kinds[name] == "STRING") & ~F.rlike(claims[name], F.lit(r"^\s*[+-]?[0-9]+\s*$"))
        return F.coalesce(kinds[name].isNotNull() & (whole[name].isNull() | text), F.lit(False))

    falsy = claims["sub"].isin("", "[]", "{}", "false") | (claims["sub"].try_cast("double") == 0) & (kinds["sub"] != "STRING")

    reason = (
        F.when(header.isNull() | (header == ""), "missing_header")
        .when(token.isNull(), "malformed_header")
        .when(state["segments"] != 3, "malformed_token")
        .when(state["header"].isNull() | state["header"]["bad"].isNotNull(), "bad_header")
        .when(~state["header"]["alg"].eqNullSafe(settings.jwt_algorithm), "bad_algorithm")
        .when(~good, "bad_signature")
        .when(claims.isNull() | claims["bad"].isNotNull(), "bad_payload")
        .when(claims["sub"].isNull(), "missing_sub")
        .when(no_number("iat"), "bad_iat").when(late("iat"), "not_yet_valid")
        .when(no_number("nbf"), "bad_nbf").when(late("nbf"), "not_yet_valid")
        .when(no_number("exp"), "bad_exp")
        .when(F.coalesce(whole["exp"] <= now, F.lit(False)), "expired")
        .when(wrong_issuer, "bad_issuer")
        .when(F.coalesce(wrong_audience, F.lit(True)), "bad_audience")
        .when(F.when(kinds["sub"] == "STRING", claims["sub"] == "").otherwise(falsy), "empty_sub")
        .when(kinds["sub"] != "STRING", "bad_sub"))

    def filled(why: Column) -> Column:
        text = F.lit(None).cast("string")
        for name, message in DETAILS.items():
            text = F.when(why == name, F.lit(message)).otherwise(text)
        return F.struct(
            why.isNull().alias("ok"),
            F.when(why.isNull(), claims["sub"]).alias("user_id"),
            why.alias("reason"), text.alias("detail"),
            # a token without an end is accepted; say so
            (why.isNull() & claims["exp"].isNull()).alias("never_expires"))

    return bind(reason, filled)
