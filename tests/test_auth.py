import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from promptveil.operators.auth import DETAILS, authenticate
from promptveil.settings import Settings

SECRET = "test-secret"
NOW = 1_700_000_000


def segment(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def token(claims, secret=SECRET, alg="HS256", raw=None):
    signed = segment(json.dumps({"alg": alg, "typ": "JWT"}).encode()) + "." + segment(
        json.dumps(claims).encode() if raw is None else raw)
    digest = {"HS384": hashlib.sha384, "HS512": hashlib.sha512}.get(alg, hashlib.sha256)
    return f"{signed}.{segment(hmac.new(secret.encode(), signed.encode(), digest).digest())}"


GOOD = {"sub": "user-1", "iat": NOW, "exp": NOW + 60}


def outcome(spark, header, **settings):
    rows = spark.createDataFrame([(header,)], "authorization string")
    made = Settings(**{"jwt_secret": SECRET, **settings})
    return authenticate(rows, made, F.timestamp_seconds(F.lit(NOW))).first()["auth"]


CASES = [
    (f"Bearer {token(GOOD)}", None), (f"bEARER {token(GOOD)}", None), (None, "missing_header"), ("", "missing_header"),
    (token(GOOD), "malformed_header"), ("Bearer", "malformed_header"), ("Bearer ", "malformed_header"),
    (f"Basic {token(GOOD)}", "malformed_header"), ("Bearer abc", "malformed_token"), ("Bearer a.b", "malformed_token"),
    ("Bearer a.b.c", "bad_header"), (f"Bearer  {token(GOOD)}", "bad_header"),
    (f"Bearer {token(GOOD, secret='attacker-secret')}", "bad_signature"),
    (f"Bearer {token(GOOD, alg='none')}", "bad_algorithm"), (f"Bearer {token(GOOD, alg='HS512')}", "bad_algorithm"),
    (f"Bearer {token({**GOOD, 'exp': NOW - 10})}", "expired"), (f"Bearer {token({**GOOD, 'exp': NOW})}", "expired"),
    (f"Bearer {token({**GOOD, 'exp': NOW - 10}, secret='other')}", "bad_signature"),
    (f"Bearer {token({'exp': NOW + 60})}", "missing_sub"), (f"Bearer {token({**GOOD, 'sub': ''})}", "empty_sub"),
    (f"Bearer {token({**GOOD, 'nbf': NOW + 60})}", "not_yet_valid"),
    *((f"Bearer {token({**GOOD, 'exp': odd})}", "bad_exp") for odd in ("abc", [1], {}, None, "1.5")),
    *((f"Bearer {token({**GOOD, 'iat': odd})}", "bad_iat") for odd in ("abc", [])),
    (f"Bearer {token({**GOOD, 'nbf': 'soon'})}", "bad_nbf"), (f"Bearer {token({**GOOD, 'exp': str(NOW + 60)})}", None),
    *((f"Bearer {token({**GOOD, 'sub': odd})}", "empty_sub") for odd in (0, 0.0, False, [], {})),
    *((f"Bearer {token({**GOOD, 'sub': odd})}", "bad_sub") for odd in (5, True, ["a"], {"a": 1})),
    (f"Bearer {token({**GOOD, 'aud': 'x'})}", "bad_audience"), (f"Bearer {token(None, raw=b'no json')}", "bad_payload"),
    (f"Bearer {token(None, raw=b'[1]')}", "bad_payload"), (f"Bearer {token(None, raw=b'{1')}", "bad_payload"),
]


@pytest.mark.parametrize("header,reason", CASES)
def test_reasons(spark, header, reason):
    found = outcome(spark, header)
    assert found["reason"] == reason
    assert found["ok"] == (reason is None) and found["user_id"] == ("user-1" if reason is None else None)
    assert found["detail"] == (None if reason is None else DETAILS[found["reason"]])


def test_tokens_without_end_are_accepted_and_flagged(spark):
    assert outcome(spark, f"Bearer {token({'sub': 'u'})}")["never_expires"]
    assert not outcome(spark, f"Bearer {token(GOOD)}")["never_expires"]


def test_audience_and_issuer(spark):
    both = {**GOOD, "aud": ["a", "b"], "iss": "me"}
    assert outcome(spark, f"Bearer {token(both)}", jwt_audience="b", jwt_issuer="me")["ok"]
    assert outcome(spark, f"Bearer {token(both)}", jwt_audience="c")["reason"] == "bad_audience"
    assert outcome(spark, f"Bearer {token({**GOOD, 'aud': 'c'})}", jwt_audience="c")["ok"]
    assert outcome(spark, f"Bearer {token(GOOD)}", jwt_audience="c")["reason"] == "bad_audience"
    assert outcome(spark, f"Bearer {token(GOOD)}", jwt_issuer="me")["reason"] == "bad_issuer"


def test_other_digests(spark):
    for alg in ("HS384", "HS512"):
        assert outcome(spark, f"Bearer {token(GOOD, alg=alg)}", jwt_algorithm=alg)["ok"]


def test_refusals(spark):
    with pytest.raises(ValueError, match="placeholder"):
        outcome(spark, None, jwt_secret=Settings().jwt_secret)
    with pytest.raises(ValueError, match="one of"):
        outcome(spark, None, jwt_algorithm="RS256")


def test_secret_is_in_no_plan(spark):
    rows = spark.createDataFrame([("x",)], "authorization string")
    frame = authenticate(rows, Settings(jwt_secret=SECRET), F.timestamp_seconds(F.lit(NOW)))
    assert SECRET not in frame._jdf.queryExecution().toString()
    assert "authorization" not in frame.columns
