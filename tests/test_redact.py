import re

import pytest
from pyspark.sql import functions as F

from promptveil.functions.patterns import PII_PATTERNS, pii_patterns
from promptveil.operators import message_rows, redact

# one request per entry: its messages
REQUESTS = [
    ["Email me at jane.doe@example.com or call 555-123-4567"],
    ["a@b.com and again a@b.com"],
    ["Contact: jane.doe@example.com, ssn 123-45-6789"],
    [" ".join(f"user{i}@x.com" for i in range(12))],
    ["a@b.com c@d.com 555-123-4567"],
    ["call 5551234", "then mail B@b.com or b@b.com", "5551234 again, b@b.com"],
    ["call +1 555-123-4567 now"],
    ["card 4111 1111 1111 1111 and 4111-1111-1111-1111", "4111 1111 1111 1111é"],
    ["host 10.0.0.1, 999.999.1.1 and 1.2.3.4.5", "25 Water Street and 1-3 Old Kent Road, 7 é  Close"],
    ["call ١٢٣٤٥٦٧", "naïve٣ 5551234 é5551234 x²5551234"],
    ["(020) 7946 0958 +44 (20) 7946 0958 12345 123456 12345678901"],
    ["costs $1 and [EMAIL_1] and [EMAIL_9] x@y.zz", ""],
    ["nothing at all"],
    ["12 main st. 12 MAIN ſtreet, 4 Privet drive"],
]


def by_hand(messages):
    """The same redaction by Python's own regex engine."""
    numbers, counts, vault = {}, {}, []
    out = []
    for text in messages:
        for label, pattern in PII_PATTERNS.items():
            def name(match):
                key = (label, match.group(0))
                if key not in numbers:
                    counts[label] = counts.get(label, 0) + 1
                    numbers[key] = f"[{label}_{counts[label]}]"
                    vault.append((label, counts[label], numbers[key], match.group(0)))
                return numbers[key]
            text = re.sub(pattern, name, text)
        out.append(text)
    return out, sorted(vault), counts


@pytest.fixture(scope="module")
def redacted(spark):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(REQUESTS)], "id int, texts array<string>")
    return redact.scrub(rows).withColumns({
        "counts": redact.counts_by_label(F.col("vault")),
        "back": F.transform("texts", lambda t: t)}).orderBy("id")


def test_equal_to_python(redacted):
    for row, messages in zip(redacted.collect(), REQUESTS):
        texts, vault, counts = by_hand(messages)
        assert row["texts"] == texts
        assert sorted(tuple(e) for e in row["vault"]) == vault
        assert row["counts"] == counts


def test_round_trip(redacted):
    joined = redacted.select("id", redact.restore("array_join(texts, '|')").alias("back"))
    for row, messages in zip(joined.orderBy("id").collect(), REQUESTS):
        if not any("[EMAIL" in m for m in messages):
            assert row["back"] == "|".join(messages)


def test_look_alikes_are_restored_too_and_flagged(spark, redacted):
    row = redacted.where("id = 11").select(redact.restore("texts[0]").alias("back")).first()
    assert row["back"] == "costs $1 and x@y.zz and [EMAIL_9] x@y.zz"
    flags = spark.createDataFrame([(["[EMAIL_1]"],), (["x"],)], "texts array<string>")
    assert [r[0] for r in flags.select(redact.holds_placeholder(F.col("texts"))).collect()] == [True, False]


def test_known_leaks_of_the_fixed_patterns(redacted):
    texts = {r["id"]: r["texts"] for r in redacted.collect()}
    assert texts[6] == ["call [PHONE_1]-4567 now"]
    assert texts[7][0].startswith("card [CREDIT_CARD_1]and")


def test_stricter_phone_takes_the_whole_number(spark):
    rows = spark.createDataFrame([(["call +1 555-123-4567 now"],)], "texts array<string>")
    assert redact.scrub(rows, patterns=pii_patterns(strict_phone=True)).first()["texts"] == ["call [PHONE_1] now"]


def test_longest_index_first_and_dollar_signs(spark):
    rows = spark.createDataFrame([("[EMAIL_10][EMAIL_1][PHONE_1][X_1]", [("EMAIL", 1, "[EMAIL_1]", "$1\\0"),
                                                                          ("EMAIL", 10, "[EMAIL_10]", "[PHONE_1]"),
                                                                          ("PHONE", 1, "[PHONE_1]", "p")])],
                                 f"t string, vault array<{redact.VAULT_ENTRY}>")
    assert rows.select(redact.restore("t")).first()[0] == "[PHONE_1]$1\\0p[X_1]"


def test_text_full_of_values(spark):
    rows = spark.range(1).select(F.array(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(19999)), lambda i: F.concat(
        F.lit("u"), i.cast("string"), F.lit("@x.com"))))).alias("texts"))
    row = redact.scrub(rows).select(F.size("vault").alias("n"), (redact.restore("texts[0]")).alias("back")).first()
    assert row["n"] == 20000 and row["back"] == " ".join(f"u{i}@x.com" for i in range(20000))


def test_sealed_vault(spark, redacted):
    vault = redact.vault_rows(redacted, "id").withColumn("k", F.lit("0123456789abcdef"))
    shut = redact.sealed(vault, F.col("k"))
    assert not any(b"x.com" in bytes(r["original"]) for r in shut.collect())
    opened = {tuple(r) for r in redact.opened(shut, F.col("k")).drop("k").collect()}
    assert opened == {tuple(r) for r in redact.vault_rows(redacted, "id").collect()}


def test_message_rows_equal_whole_requests(spark, redacted, monkeypatch):
    monkeypatch.setattr(message_rows, "BLOCK", 2)
    rows = [(i, m, "user", text) for i, messages in enumerate(REQUESTS) for m, text in enumerate(messages)]
    rows += [(99, m, "user", f"u{m % 7}@x.com then {m} and 555-12{m:02}") for m in range(40)]
    frame = spark.createDataFrame(rows, "request_id int, msg_idx int, role string, content string")
    texts, vault = message_rows.redact_messages(frame)
    got = {}
    for r in texts.orderBy("msg_idx").collect():
        got.setdefault(r["request_id"], []).append(r["content"])
    held = {}
    for r in vault.collect():
        held.setdefault(r["request_id"], []).append((r["label"], r["idx"], r["placeholder"], r["original"]))
    whole = {i: m for i, m in enumerate(REQUESTS)} | {99: [r[3] for r in rows if r[0] == 99]}
    for i, messages in whole.items():
        want, entries, _ = by_hand(messages)
        assert got[i] == want
        assert sorted(held.get(i, [])) == entries
    counts = {(r["request_id"], r["label"]): r["n"] for r in message_rows.label_counts(vault).collect()}
    assert counts[99, "EMAIL"] == 7 and counts[99, "PHONE"] == 40
