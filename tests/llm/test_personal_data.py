import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from promptveil.llm import personal_data
from promptveil.llm.queries import op1_personal_data


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(n) <= 255 for n in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and plain_luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15))
    for kind, pattern, good in rules:
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m[0])]
    return out


def check(rows, got):
    assert len(got) == len(rows)
    texts = {d: t for d, t in rows}
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(b.startswith(k + ":") for b in base) for k in ("email", "ip", "card", "phone")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans) and len(set(spans)) == len(spans)
        keys = [(personal_data.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)


def test_table(spark, folder, documents):
    got = op1_personal_data(spark, folder).collect()
    check([(d, t) for d, t, _, _ in documents], got)


def test_secrets_are_added(spark):
    folder = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    secrets = [(d, m.start(1), m.end(1)) for d, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
    got = op1_personal_data(spark, folder).collect()
    check(list(text.items()), got)
    spans = {r["doc_id"]: r["spans"].split(",") for r in got}
    assert secrets and all(f"secret:{a}:{b}" in spans[d] for d, a, b in secrets)


def test_base_rules_on_random_text():
    rng = random.Random(1)
    for n in range(3000):
        text = "".join(rng.choice(["@", ".", "-", "+", " ", "(", ")", "1", "25", "4", "a", "B", "_", "%", "é", "٣", "\n", "300",
                                   "4111111111111111", "a@b.c", "1.2.3.4", "+1 555"]) for _ in range(rng.randint(0, 40)))
        own = [f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b, base in personal_data.candidates(text) if base]
        assert own == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300000, "a" * 300000 + "@", "1." * 200000, "+1" * 100000, "+1" + "(" * 300000, "a@" * 100000, "1 " * 200000,
                 "a" * 300000 + "@b", "f" * 300000):
        personal_data.candidates(text)


def test_em_finds_the_reliable_labelers():
    """Votes drawn from known reliabilities, truth hidden."""
    rng = np.random.default_rng(4)
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.55, 0.8])
    truth = rng.random(20000) < 0.3
    said = rng.random((20000, 6)) < right
    votes = np.where(said == truth[:, None], 1, -1)
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = personal_data.estimated(np.zeros(len(patterns), int), patterns, n)[back.ravel()]
    accuracy = ((p > 0.5) == truth).mean()
    majority = ((votes.sum(axis=1) > 0) == truth).mean()
    assert accuracy > 0.95 and accuracy > majority


def test_patterns_pack():
    codes = np.array([personal_data.pattern(3, [1, 0, -1, 1, 0, 1], 15), personal_data.pattern(0, [-1] * 6, 3)])
    kinds, own, size = personal_data.unpacked(codes)
    assert kinds.tolist() == [3, 0] and own.tolist() == [[1, 0, -1, 1, 0, 1], [-1] * 6] and size.tolist() == [2, 0]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "write to jane (at) example (dot) org or jane@example.org"), (4, "call (017) 555-7713, ssn 123-45-6789"),
            (5, "x" * 200000 + " 10.0.0.1 " + "1" * 5000), (6, "\U0001F600 a@b.co 4111 1111 1111 1111"), (None, "+49 30 1234567"),
            (7, "version 1.2.3.400")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit(2))
    got = personal_data.detected(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == plain(text)
        assert all(s in r["spans"] for s in r["base"])
        ends = sorted((s["start"], s["end"]) for s in r["spans"] if s not in r["base"])
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert personal_data.detected(df.where("false")).count() == 0
    assert [r["spans"] for r in personal_data.detected(df.where("doc_id < 3")).collect()] == [[], []]


def planted(rng, n):
    """(texts, true added spans by text): each text has one thing that no base rule finds, personal or only looking like it."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    prose = lambda: " ".join(word() for _ in range(rng.randint(3, 12)))
    true = [lambda: ("ssn ", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{digits(4)}", "id"),
            lambda: ("call ", f"({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", "phone"),
            lambda: ("phone ", f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}", "phone"),
            lambda: ("mail ", f"{word()} (at) {word()} (dot) com", "email"),
            lambda: ("token ", "ghp_" + hexes(30), "secret"), lambda: ("api key ", hexes(40), "secret")]
    false = [lambda: ("commit ", hexes(40), "secret"), lambda: ("sha ", hexes(64), "secret"),
             lambda: ("version ", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(256, 900)}.{rng.randint(256, 999)}", "ip"),
             lambda: ("total ", digits(16), "card"), lambda: ("page ", f"000-{rng.randint(10, 99)}-{digits(4)}", "id"),
             lambda: ("isbn ", f"978{digits(10)}", "card")]
    texts, spans = [], {}
    for i in range(n):
        good = i % 2 == 0
        cue, part, kind = rng.choice(true if good else false)()
        head = prose() + " " + cue
        texts.append((i, head + part + " " + prose()))
        if good:
            spans[i] = f"{kind}:{len(head)}:{len(head) + len(part)}"
    return texts, spans


def test_precision_and_recall_of_added_spans(spark):
    rows, spans = planted(random.Random(12), 1200)
    got = personal_data.detected(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    added = {(r["doc_id"], f"{s['kind']}:{s['start']}:{s['end']}") for r in got for s in r["spans"] if s not in r["base"]}
    right = added & set(spans.items())
    assert len(right) / len(added) > 0.95 and len(right) / len(spans) > 0.95, (len(right), len(added), len(spans))


def test_the_classifier_sees_more_than_the_votes():
    """Equal votes, another form or other words: other features, within bounds."""
    seen = set()
    for text in ("key abcdef12", "key ABCDEF12", "key [abcdef12]", "word abcdef12", "key abcdef12 then"):
        start = text.lower().index("abcdef12")
        own = personal_data.features(text, 5, start, start + 8, [0] * 6)
        assert len(set(own)) == len(own) and 0 <= min(own) and max(own) < personal_data.N_FEATURES
        seen.add(tuple(own))
    assert len(seen) == 5
