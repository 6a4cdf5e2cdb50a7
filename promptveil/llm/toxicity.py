"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their beginnings (words share stems), each counted once, hashed into ``BUCKETS``.
The score is the logistic of w0 + sum of w over the text's terms + sum of <v, v'> over its pairs of terms, so that a
pair such as an insult and a group weighs more than both alone.

The model is fitted on a bounded sample: the labelled texts whose id's hash falls below the share that gives about
``SAMPLE`` texts, texts of equal terms once and by the larger of their labels. Out of the terms of the sample the ``TERMS`` that differ most in frequency between
the labels become features; ties go to the smaller bucket. Everything else covers all rows, and scoring is one pass.

A null text is an empty one; a text without terms scores by w0 alone. Labels that are null or without a text teach
nothing; without any label of both kinds the score is the share of label 1, 0 if there are no labels. An id with
several labels counts by the larger, its repeated texts each. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptveil.llm.common import small_batches, worker_cache
from promptveil.session import written

BUCKETS = 1 << 22
STEMS = (4, 5, 6, 7, 8)
SAMPLE = 20_000
TERMS = 2048
LEAST_TEXTS = 4
LEAST_Z = 3.5
FACTORS = 8
EPOCHS = 25
_WORD = r"[^\W\d_]+"
_MEMO = 1 << 20


def word_terms(word: str) -> list[int]:
    """Buckets of a word and of its beginnings that are shorter than it."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS,
            *(zlib.crc32((word[:n] + "*").encode("utf-8", "surrogatepass")) % BUCKETS for n in STEMS if n < len(word))]


def words_of(text: str) -> Iterator[str]:
    """Lower-case runs of letters."""
    return (m[0] for m in re.finditer(_WORD, text.lower())) if len(text) > 1 << 20 else iter(re.findall(_WORD, text.lower()))


class Machine:
    """A fitted model: bias, and weight and factors of each chosen bucket."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors
        self.mark = zlib.crc32(buckets.tobytes() + factors.tobytes() + weights.tobytes())

    def features(self, text: str) -> list[int]:
        """Numbers of the chosen terms that a text has. What a word gives is kept in the worker."""
        cache = worker_cache()
        if cache.get("toxicity mark") != self.mark:
            cache["toxicity mark"], cache["toxicity words"] = self.mark, {}
            cache["toxicity at"] = {b: i for i, b in enumerate(self.buckets.tolist())}
        memo, at = cache["toxicity words"], cache["toxicity at"]
        found: set[int] = set()
        for word in set(words_of(text)):
            own = memo.get(word)
            if own is None:
                own = tuple(at[t] for t in word_terms(word) if t in at)
                if len(memo) >= _MEMO:
                    memo.clear()
                memo[word] = own
            if own:
                found.update(own)
        return sorted(found)

    def margin(self, features: list[int]) -> float:
        if not features:
            return self.bias
        v = self.factors[features]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return self.bias + float(self.weights[features].sum()) + pairs

    def score(self, text: str | None) -> float:
        x = min(30.0, max(-30.0, self.margin(self.features(text or ""))))
        return float(1 / (1 + np.exp(-x)))


def fit(rows: list[list[int]], labels: np.ndarray, n_features: int, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad over small batches of (features, label)."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
    bias, w = float(np.log(share / (1 - share))), np.zeros(n_features)
    v = rng.normal(0, 0.05, (n_features, factors))
    if len(labels) == 0 or labels.min() == labels.max():
        return bias, w, np.zeros_like(v)
    gb, gw, gv = 1e-6, np.full(n_features, 1e-6), np.full((n_features, factors), 1e-6)
    sizes = np.array([len(r) for r in rows])
    flat = np.array([i for r in rows for i in r], np.int64)
    begins = np.cumsum(sizes) - sizes
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 256):
            some = order[at:at + 256]
            n = sizes[some]
            owner = np.repeat(np.arange(len(some)), n)
            ids = flat[np.repeat(begins[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            own = v[ids]
            total = np.zeros((len(some), factors))
            np.add.at(total, owner, own)
            squares = np.bincount(owner, (own ** 2).sum(axis=1), len(some))
            margin = bias + np.bincount(owner, w[ids], len(some)) + 0.5 * ((total ** 2).sum(axis=1) - squares)
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]
            gb += float(slope.mean()) ** 2
            bias -= rate * float(slope.mean()) / gb ** 0.5
            used, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, slope[owner], len(used)) / len(some) + decay * w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, slope[owner, None] * (total[owner] - own) / len(some))
            dv += decay * v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return bias, w, v


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, sample: int = SAMPLE) -> dict[int, int]:
    """About ``sample`` labels, by hash of the id."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    n = known.count()
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return {r["id"]: r["y"] for r in known.where(draw < min(1.0, sample / max(1, n))).collect()}


def learned(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
            sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """The model of the labelled texts among ``df``."""
    chosen = sampled_labels(labels, id_col, label_col, sample)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            mine = [i for i, d in enumerate(ids) if d in chosen]
            texts = batch.column("text").take(pa.array(mine, pa.int64())).to_pylist()
            found = [sorted({t for word in set(words_of(text or "")) for t in word_terms(word)}) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chosen[ids[i]] for i in mine], pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["y", "terms"])

    texts = written(small_batches(df).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
                    .mapInArrow(run, "y int, terms array<int>").groupBy("terms").agg(F.max("y").alias("y")), "toxicity-sample")
    n, ones = texts.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    share = ones / n if n else 0.0
    spread = (share * (1 - share)) or 1.0
    z = F.abs(F.col("ones") - F.col("n") * share) / F.sqrt(F.col("n") * spread)
    best = (texts.select("y", F.explode("terms").alias("term")).groupBy("term")
            .agg(F.count("*").alias("n"), F.sum("y").alias("ones")).where(F.col("n") >= LEAST_TEXTS)
            .withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(terms))
    buckets = np.array(sorted(r["term"] for r in best.select("term").collect()), np.int64)
    at = {b: i for i, b in enumerate(buckets.tolist())}

    @F.pandas_udf("array<int>")
    def features(found):
        import pandas as pd
        return pd.Series([[at[t] for t in own if t in at] for own in found])

    rows = texts.select("terms", "y", features("terms").alias("features")).orderBy(F.xxhash64("terms"), F.hash("terms")).select(
        "y", "features").collect()
    return Machine(buckets, *fit([list(r["features"]) for r in rows], np.array([r["y"] for r in rows], np.float64), len(buckets)))


def scored(df: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``df`` with column score, in place of one of that name."""
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        return pd.Series([machine.score(t) for t in texts], dtype="float64")

    return small_batches(df).withColumn("score", score(F.col(text_col)))
