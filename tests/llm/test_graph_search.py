import numpy as np
from pyspark.sql import functions as F

from promptveil.llm import graph_search, pruned_graph
from promptveil.llm.queries import op8_graph_search


def plain(rows, k=20, every=20):
    """{query: [(score, id)]} over all usable rows."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q % every == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out[q, v] = [(-s, i) for s, i in near[:k]]
    return out


def recall(got, want):
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    for (q, _), near in want.items():
        own = sorted(by.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(near) + 1))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        floor = near[-1][0] - 1e-9 if near else 0
        hit += sum(r["score"] >= floor for r in own)
        total += len(near)
    assert len(got) == total
    return hit / max(1, total)


def test_table_recall(spark, folder):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(op8_graph_search(spark, folder).collect(), plain(rows)) >= 0.9


def test_shards_blocks_and_norms(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=24) * rng.uniform(0.5, 2)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = graph_search.nearest(df, shard_rows=700, block_rows=40).collect()
    assert recall(got, plain(rows)) >= 0.9


def test_a_large_group_of_near_copies_hides_nothing():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=32)
    x = np.concatenate([centre + rng.normal(size=(2000, 32)) * 0.02, rng.normal(size=(3000, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)[rng.permutation(5000)]
    edges, entries = pruned_graph.build(x)
    found = pruned_graph.search(x, edges, entries, x[::20], 192)
    best = np.argsort(-(x[::20] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found.tolist(), best.tolist(), strict=True)]) / 20 > 0.9


def test_odd_rows(spark):
    rows = [(i, [1.0, 0.0, float(i % 3)]) for i in range(90)]  # thirty copies each of three vectors
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]),
             (105, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (120, [1.0, 2.0]), (140, [3.0]), (160, [1e200, 0.0, 1e-200]),
             (180, [-0.0, 0.0, 1.0]), (181, [0.0, 0.0, 1.0]), (200, [2.0, 1.0]), (40, [1.0, 0.0, 1.0]), (40, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1)).withColumn("vec", F.lit(2))
    got = graph_search.nearest(df.withColumn("dim", F.lit("x"))).collect()
    want = {q: near for (q, _), near in plain(rows).items()}
    for q, near in want.items():
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == [i for _, i in near], q
        assert np.allclose([r["score"] for r in own], [s for s, _ in near])
    assert {r["query_id"] for r in got} == {q for q, near in want.items() if near}
    assert graph_search.nearest(df.where("false")).count() == 0


def test_parts_that_no_edge_reaches():
    edges = np.array([[1, -1], [0, -1], [3, -1], [2, -1]])
    assert pruned_graph._unreached(edges, [0]) == [0, 2]
