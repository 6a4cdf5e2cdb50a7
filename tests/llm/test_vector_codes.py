import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptveil.llm import vector_codes
from promptveil.llm.queries import op11_vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """{(id, label, code, error, label error)} sorted, and the digest, by plain loops over Python integers."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts if kept else 0
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            chosen = {}
            for _, v, _ in kept:
                part = v[p * width:(p + 1) * width]
                chosen.setdefault(nearest(part, book)[1], []).append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*chosen[n], strict=True)] if n in chosen else e for n, e in enumerate(book)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [nearest(v[p * width:(p + 1) * width], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{n:02x}" for _, n in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=repr)


def check(rows, got):
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, op11_vector_codes(spark, folder).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(n), np.float32(rng.normal(size=16) * (0.01 if n % 3 else 2.0)).tolist(), None if n % 4 == 0 else int(n % 3))
            for n in rng.permutation(70)]
    rows += rows[:9] + [(rows[0][0], [0.0] * 16, 1), (None, [1.0] * 16, None), (None, [-0.25] * 16, 5), (200, None, 1),
                        (201, [float("nan")] + [0.0] * 15, 1), (202, [float("inf")] * 16, 1), (203, [None] + [0.0] * 15, 1),
                        (204, [-1e-9] * 16, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vec", "whole", "code", "error", "of", "label_error"):
        df = df.withColumn(name, F.lit("x"))
    check(rows, vector_codes.compressed(df.repartition(4)).collect())
    few = rows[:5] + [rows[0]]
    check(few, vector_codes.compressed(spark.createDataFrame(few, SCHEMA)).collect())
    none = vector_codes.compressed(df.where("vec_id = 200"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_blocks_of_any_size_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(n, np.float32(rng.normal(size=8)).tolist(), n % 2) for n in range(100)]
    whole = vector_codes.whole_vectors(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    start = vector_codes.first_codebooks(whole)
    found = []
    for size in (1, 7, 100, 1000):
        blocks = vector_codes.stored_blocks(whole, size)
        assert blocks.count() == -(-100 // size)
        books = vector_codes.trained(blocks, start)
        found.append((vector_codes.digest(books), sorted(map(tuple, vector_codes.encoded(blocks, books).collect()))))
    assert all(f == found[0] for f in found)


def test_dictionary_distances():
    rng = np.random.default_rng(5)
    rows, entries = rng.integers(-50, 50, (200, 3)), rng.integers(-50, 50, (16, 3))
    values, sizes, codes = vector_codes.dictionaries(rows)
    got = vector_codes.part_distances(np.split(values, np.cumsum(sizes)[:-1]), codes, entries)
    assert np.array_equal(got, ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2))
    assert sizes.max() <= 100


@pytest.mark.parametrize("vectors", [[[1.0] * 8, [1.0] * 16], [[1.0] * 7], [[1e9] * 8]])
def test_refused(spark, vectors):
    df = spark.createDataFrame([(n, v, 0) for n, v in enumerate(vectors)], SCHEMA)
    with pytest.raises(Exception, match="length|component"):
        vector_codes.compressed(df).collect()
