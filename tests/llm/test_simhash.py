import re

import xxhash
from pyspark.sql import functions as F

from promptveil.llm import simhash
from promptveil.llm.queries import op9_simhash

SCHEMA = "doc_id bigint, text string, fp string, root long"


def plain_fingerprint(text, k=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """{fingerprint: smallest id} by brute force over all pairs."""
    distinct = sorted({fp for _, fp in prints})
    parent = {fp: fp for fp in distinct}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = {}
    for doc, fp in prints:
        if doc is not None:
            least[top(fp)] = min(doc, least.get(top(fp), doc))
    return {fp: least.get(top(fp)) for fp in distinct}


def check(rows, got):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    least = plain_classes(prints)
    want = sorted(((d, f"{fp:016x}", least[fp]) for d, fp in prints), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want


def test_table(spark, folder, documents):
    check([(d, t) for d, t, _, _ in documents], op9_simhash(spark, folder).collect())


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One two"), (6, "one TWO"), (6, "one two"), (None, "x y z w"),
            (3, "x y z w"), (8, "ÀB c d e"), (2, "w " * 70000), (1, "W\n" * 70000), (10, "a b c d" + " e f" * 40000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("key", F.lit(1))
    check(rows, simhash.near_duplicates(df).collect())
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(df).collect())
    assert kept == [1, 3, 4, 6, 8, 10]
    assert simhash.one_of_each(df).columns == df.columns


def test_pieces_of_a_long_text():
    text = ("Ab cd\te  " * 40000).encode()
    whole = simhash.fingerprints_of([text], 3)[0]
    cut = simhash.pieces
    try:
        simhash.pieces = lambda data: cut(data, 1000)
        assert simhash.fingerprints_of([text], 3)[0] == whole
    finally:
        simhash.pieces = cut


def test_big_and_small_buckets_give_the_same_components(spark):
    """A centre, its one- and two-bit neighbours, and chains; every bucket as pairs and every bucket as stars."""
    centre = 0x0123456789ABCDEF
    prints = {centre} | {centre ^ 1 << i for i in range(0, 64, 3)} | {centre ^ 5 << i for i in range(0, 60, 7)}
    chain = 0x7000FF00FF00FF00
    for i in range(12):
        chain ^= 3 << 2 * i
        prints.add(chain)
    prints |= {(7 * n * 0x9E3779B97F4A7C15) & (1 << 64) - 1 for n in range(1, 60)}
    rows = [(n, fp) for n, fp in enumerate(sorted(prints))]
    df = spark.createDataFrame([(n, fp - (1 << 64) if fp >> 63 else fp) for n, fp in rows], "id bigint, fp bigint")
    want = plain_classes(rows)
    for small in (0, 5, 10_000):
        got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.classes(df, small).collect()}
        assert got == want
