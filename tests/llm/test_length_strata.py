import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from promptveil.llm import length_strata
from promptveil.llm.queries import op12_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    """Sorted (item, rank, doc, score), every document scored for every item."""
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t}:
        scored = []
        for d, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, n, d, -s) for n, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_table(spark, folder, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = op12_ranked_search(spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(d, t) for d, t, _, _ in documents], items)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]


@pytest.fixture(scope="module")
def odd():
    docs = [(1, None), (2, ""), (3, " .,;\n"), (None, "alpha beta"), (5, "Alpha BETA gamma"), (6, "alpha beta"), (6, "alpha beta"),
            (7, "beta " * 50000), (8, "ÀÉ ÀÉ x1y2 東京 b c"), (9, "àé x1y2 ́alpha"), (10, "\x00alpha\x7fbeta\x80")]
    docs += [(100 + n, " ".join(f"w{(n * j) % 23}" for j in range(n % 9 + 1)) + " alpha" * (n % 4)) for n in range(150)]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta gamma beta"), (2, None), (3, ""), (4, "..."), (5, "nothing here"), (None, "x1y2 東京"),
             (6, "àé ÀÉ alpha"), (7, "w1 w2 w3 w4 w5 w6 w7 " * 30), (8, "b c w0"), (9, "alpha")]
    return docs, items


def test_odd_rows(spark, odd, monkeypatch):
    docs, items = odd
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    for name in ("id", "score", "rank", "query", "ids", "item", "docs", "terms"):
        df, wanted = df.withColumn(name, F.lit("x")), wanted.withColumn(name, F.lit("y"))
    want = plain(docs, items)
    assert sorted(map(tuple, length_strata.search(df.repartition(3), wanted).collect()), key=repr) == want
    monkeypatch.setattr(length_strata, "SLICE_CHARS", 100)
    assert sorted(map(tuple, length_strata.search(df, wanted).collect()), key=repr) == want
    assert length_strata.search(df.where("false"), wanted).count() == 0
    assert length_strata.search(df, wanted.where("false")).count() == 0
    assert length_strata.search(df.where("doc_id < 4"), wanted).count() == 0


def test_blocks_of_any_size_agree(odd):
    docs, items = odd
    texts = [(t or "").encode() for _, t in docs]
    counted = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, counted)), sum(sum(c.values()) for c in counted)
    df = Counter(t for c in counted for t in c)
    import pyarrow as pa
    for size in (1, 7, 1000):
        for item, text in [(1, "alpha w1"), (7, items[9][1])]:
            best, strata, visited = length_strata.Best(20), 0, 0
            for at in range(0, len(docs), size):
                block = length_strata.block_of(texts[at:at + size], n_docs, n_terms)
                block.group_first = np.cumsum(block.group_size, dtype=np.int64) - block.group_size
                ids = pa.array([docs[at + n][0] for n in block.order], pa.int64())
                known = {t.as_py().decode(): n for n, t in enumerate(block.terms)}
                query = [(known[t], c * length_strata.weight(df[t], n_docs)) for t, c in Counter(plain_terms(text)).items() if t in known]
                visited += length_strata.visit(block, ids, query, best)
                strata += len(block.strata)
            assert [(item, n, d, int(s)) for n, (d, s) in enumerate(zip(best.ids, best.scores, strict=True), 1)] == sorted(
                plain(docs, [(item, text)]), key=lambda r: r[1])
            if size == 1:
                assert visited < strata  # bounds pass strata over


def test_a_block_is_a_row_group(spark):
    """Writer and reader hold one block at a time, however many a task makes."""
    df = spark.createDataFrame([(n, "alpha beta " * 700_000) for n in range(3)], "doc_id bigint, text string").coalesce(1)
    files = length_strata.index(df, 3, 4_200_000).inputFiles()
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert [m.row_group(n).num_rows for m in found for n in range(m.num_row_groups)] == [1, 1, 1]
