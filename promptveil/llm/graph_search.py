"""Approximate nearest neighbours by largest inner product: one robust-pruned graph per shard, searched by beam.

Equal vectors are one node (its smallest ids are kept with it: no more of them than are asked for can be in an answer),
nodes are dealt to shards of about ``SHARD_ROWS`` by a hash, and every shard gets its own graph, stored as a table.
Distinct query vectors are searched in blocks in every shard; what a shard finds is measured again in double precision,
the shards' lists are merged, and each query row gets the answer of its vector without itself.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part. Repeated
rows count once. One id with several vectors is as many candidates, none of which answers that id. Vectors of different
length don't meet. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptveil.llm import pruned_graph
from promptveil.llm.common import small_batches
from promptveil.session import written

SHARD_ROWS = 16384
QUERY_BLOCK = 4096
BEAM = 192
_NODES = "dim int, shard int, node int, entry boolean, members array<long>, vec array<double>, near array<int>"


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (id, vec) of the vectors that take part."""
    vec = F.col(vector_col).cast("array<double>")
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & whole & F.exists("vec", lambda x: x != 0))
            .distinct())


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(members, vec, dim): each vector once with the ``keep`` smallest of its ids, in order."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return (rows.withColumn("place", place).where(F.col("place") <= keep).groupBy("vec")
            .agg(F.sort_array(F.collect_list("id")).alias("members"))
            .select("members", "vec", F.size("vec").alias("dim")))


def indexed(nodes: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = pruned_graph.DEGREE,
            beam: int = pruned_graph.BEAM) -> DataFrame:
    """The graphs: one row per distinct vector with its shard, node number and edges."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(key, rows):
        import os
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        rows = rows.sort_values("members", key=lambda c: c.str[0], ignore_index=True)
        vectors = np.stack(rows["vec"].to_numpy())
        scale = np.abs(vectors).max()  # squares of huge components must stay finite
        edges, entries = pruned_graph.build((vectors / scale).astype(np.float32), degree, beam)
        start = np.zeros(len(rows), np.bool_)
        start[entries] = True
        return pd.DataFrame({"dim": key[0], "shard": key[1], "node": np.arange(len(rows), dtype=np.int32), "entry": start,
                             "members": rows["members"], "vec": rows["vec"],
                             "near": [e[e >= 0].astype(np.int32) for e in edges]})

    return (nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
            .groupBy("dim", "shard").applyInPandas(build, _NODES))


def _searched(graph: DataFrame, queries: DataFrame, k: int, beam: int, block_rows: int) -> DataFrame:
    """(query, id, score): the ``k`` best ids of every shard for each distinct query vector (query, vec, dim)."""
    blocks = max(1, -(-queries.count() // block_rows))
    places = graph.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard")).distinct()
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
             .join(places, F.col("dim") == F.col("of_dim")).select("of_dim", "of_shard", "block", "query", "vec"))
    served = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, nodes, rows):
        out_query, out_id, out_score = [], [], []
        if len(nodes) and len(rows):
            nodes = nodes.sort_values("node", ignore_index=True)
            vectors = np.stack(nodes["vec"].to_numpy())
            scale = np.abs(vectors).max()
            small = (vectors / scale).astype(np.float32)
            edges = np.full((len(nodes), max(1, int(nodes["near"].str.len().max()))), -1, np.int64)
            for i, near in enumerate(nodes["near"]):
                edges[i, :len(near)] = near
            entries = np.flatnonzero(nodes["entry"].to_numpy())
            members = nodes["members"].to_list()
            wanted = np.stack(rows["vec"].to_numpy())
            asked_for = rows["query"].to_numpy()
            for at in range(0, len(rows), 256):
                exact = wanted[at:at + 256]
                toward = (exact / np.abs(exact).max(axis=1, keepdims=True)).astype(np.float32)
                found = pruned_graph.search(small, edges, entries, toward, beam)
                for i, ids in enumerate(found):
                    ids = ids[ids >= 0]
                    scores = (vectors[ids] * exact[i]).sum(axis=1)
                    order = np.argsort(-scores, kind="stable")
                    floor = scores[order[min(k, len(order)) - 1]]
                    best = sorted((-s, m) for n, s in zip(ids.tolist(), scores.tolist(), strict=True) if s >= floor
                                  for m in members[n])[:k]
                    out_query += [asked_for[at + i]] * len(best)
                    out_id += [m for _, m in best]
                    out_score += [-s for s, _ in best]
        return pd.DataFrame({"query": np.array(out_query, np.int64), "id": np.array(out_id, np.int64),
                             "score": np.array(out_score, np.float64)})

    return (served.groupBy("dim", "shard", "block").cogroup(asked.groupBy("of_dim", "of_shard", "block"))
            .applyInPandas(run, "query long, id long, score double"))


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = BEAM, block_rows: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row whose id ``every`` divides."""
    rows = written(usable(small_batches(df), id_col, vector_col), "vectors")
    graph = written(indexed(written(distinct_vectors(rows, k + 1), "vector-nodes"), shard_rows), "vector-graph")
    asking = rows.where(F.pmod("id", F.lit(every)) == 0)
    queries = written(asking.groupBy("vec").agg(F.min("id").alias("query"))
                      .select("query", "vec", F.size("vec").alias("dim")), "vector-queries")
    found = _searched(graph, queries, k + 1, beam, block_rows)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = (found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "score"))).alias("found")))
    answers = written(queries.join(best, "query").select("vec", "found"), "vector-answers")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k)
    return (asking.join(answers, "vec").select("id", F.posexplode(others).alias("place", "f"))
            .select(F.col("id").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"),
                    F.col("f.id").alias("vec_id"), F.col("f.score").alias("score")))
