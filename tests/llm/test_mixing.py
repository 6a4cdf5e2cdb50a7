import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from promptveil.llm import mixing
from promptveil.llm.queries import op4_mix


def plain_targets(sizes):
    """{source: exact target} by handing out the rest again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), Fraction(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(3 * sizes[s])
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(rows, got, tolerance):
    sizes = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    per = defaultdict(int)
    for _, s, n in sizes:
        per[s] += n
    target = plain_targets(per)
    assert (sorted(((r["doc_id"], r["size"], r["source_size"]) for r in got), key=repr)
            == sorted(((d, n, per[s]) for d, s, n in sizes), key=repr))
    taken, by_target = defaultdict(int), {}
    source = {d: s for d, s, _ in sizes}
    for r in got:
        assert abs(r["target"] - float(target[source[r["doc_id"]]])) <= 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source[r["doc_id"]]] += r["taken"]
        by_target[source[r["doc_id"]]] = r["target"]
    for s, t in by_target.items():
        assert abs(taken[s] - t) <= tolerance * t + 1e-9


def test_table(spark, folder, documents):
    got = op4_mix(spark, folder).collect()
    check([(d, t, s) for d, t, _, s in documents], got, 0.5)
    assert sorted(got) == sorted(op4_mix(spark, folder).collect())


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["b", "a", None, "c", "é", "Z", "a\U0001F600", ""] * 60)]
    rows += [(1000, None, "b"), (1001, "", None), (1002, " \t x\x0by ", "a"), (1003, None, "empty"), (1004, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rate", F.lit(1))
    got = mixing.mix(df.withColumn("size", F.lit("x"))).collect()
    check(rows, got, 0.2)
    assert mixing.mix(df.where("false")).count() == 0
    assert {r["taken"] for r in mixing.mix(df.where("text is null")).collect()} == {0}
    copies = mixing.mixed_rows(df)
    assert copies.columns == df.columns
    times = {r["doc_id"]: r["n"] for r in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in got:
        if r["size"]:
            assert times.get(r["doc_id"], 0) * r["size"] == r["taken"]


def test_targets_stop_and_share_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1000), ("d", 5)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    want = plain_targets({"a": 10, "b": 1, "c": 1000, "d": 5})
    assert all(abs(got[s] - float(want[s])) < 1e-9 for s in want)
