import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from promptveil.llm import toxicity
from promptveil.llm.queries import op6_toxicity


def area(scores, labels):
    """Share of (1, 0) pairs in the right order."""
    ones = [s for s, y in zip(scores, labels, strict=True) if y]
    zeros = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op6_toxicity(spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [d for d in labels if rows[d]["held_out"]]
    assert area([rows[d]["score"] for d in held], [labels[d] for d in held]) > 0.8  # 35 toxic texts to learn from


def test_pairs_beyond_additive_weights():
    """A label that only the pair of two terms carries."""
    rng = random.Random(2)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(sorted({x for x, on in ((0, a), (1, b)) if on} | {2 + rng.randrange(20)}))
        labels.append(float(a and b))
    bias, w, v = toxicity.fit(rows, np.array(labels), 22)
    machine = toxicity.Machine(np.arange(22), bias, w, v)
    margins = {name: machine.margin(f) for name, f in (("both", [0, 1]), ("a", [0]), ("b", [1]), ("none", []))}
    assert margins["both"] > 0 > max(margins["a"], margins["b"], margins["none"])
    additive = bias + w[0] + w[1]
    assert margins["both"] > additive + 0.5


def test_pair_sum_by_hand():
    machine = toxicity.Machine(np.arange(3), 0.5, np.array([1.0, 2.0, 3.0]), np.array([[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]]))
    assert abs(machine.margin([0, 1, 2]) - (0.5 + 6 + 1 + 8.5 - 2.5)) < 1e-9


def test_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(20)) + (" villain" if i % 3 == 0 else "")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "!! 12"), (1003, "villain " * 200000), (None, "villain"), (3, "villain")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (None, 1), (3, 0), (7777, 1), (1000, 0)],
                                   "doc_id bigint, toxic int")
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("y", F.lit(1)).withColumn("terms", F.lit("x"))
    machine = toxicity.learned(df, labels)
    got = toxicity.scored(df, machine)
    assert got.columns == [*df.columns, "score"] and got.count() == len(rows)
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[1003] > 0.5 > by[1000] == by[1001] == by[1002] and by[None] > 0.5
    assert toxicity.scored(df.where("false"), machine).count() == 0
    for some in (labels.where("false"), labels.where("toxic = 0")):
        plain = toxicity.learned(df, some)
        assert {r["score"] < 0.01 for r in toxicity.scored(df, plain).collect()} == {True}
    assert toxicity.learned(df.where("false"), labels).margin([]) < -5


def test_equal_texts_with_different_labels(spark):
    """The larger label counts, whatever the order of the rows."""
    rows = [(i, f"{'abcdefghij'[i % 10] * 4}{'klmno'[i % 50 // 10]} plain text" + (" villain" if i % 50 < 20 else "")) for i in range(400)]
    labels = [(i, int(i % 50 < 20 and i < 200)) for i in range(400)]  # of equal texts only the first are marked
    found = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts, "text")
        machine = toxicity.learned(df, spark.createDataFrame(labels[::-1], "doc_id bigint, toxic int").repartition(parts))
        found.append([round(r["score"], 12) for r in toxicity.scored(df, machine).orderBy("doc_id").collect()])
    assert found[0] == found[1]
    assert all((s > 0.5) == (i % 50 < 20) for i, s in enumerate(found[0]))


def test_every_score_by_plain_sums(spark, documents):
    """Scores of the whole table against the sum over all pairs of a text's terms, one by one."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    df = spark.createDataFrame([(d, t) for d, t, _, _ in documents] + [(None, None)], "doc_id bigint, text string")
    machine = toxicity.learned(df, labels)
    place = {int(b): n for n, b in enumerate(machine.buckets)}
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, machine).collect()}
    for doc, text, _, _ in documents:
        words = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
        terms = sorted({place[t] for w in words for t in toxicity.word_terms(w) if t in place})
        margin = machine.bias + sum(float(machine.weights[t]) for t in terms)
        for n, a in enumerate(terms):
            margin += sum(float(machine.factors[a] @ machine.factors[b]) for b in terms[n + 1:])
        assert abs(got[doc] - 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))) < 1e-9, doc
