"""Benchmark decontamination: documents that hold a passage of a benchmark item within an edit budget.

A passage is a window of ``qgrams.WINDOW`` characters of an item, from any place, within the edit budget; windows every
``qgrams.STRIDE`` characters are looked for first and counted, and if a text holds none of them, the best of all others is
reported. An item shorter than a window is one, with a budget in proportion. Below two grams (20 characters) it has to
stand there exactly, as whole words, and below one gram it has to be the whole text. Case and kind of white space don't
count. Each text is searched where it lies, in one pass without a shuffle, against the items' grams; items are
taken ``SLICE_CHARS`` at a time, one pass over the documents for each slice, so that what goes to the workers is bounded
however many items there are.

Null and empty texts and items match nothing; repeated rows and items are each reported. Other columns are ignored
(``matches``) or pass through (``clean``). Items with a null id are searched for like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import small_batches, worker_cache
from promptveil.llm.qgrams import Index

SLICE_CHARS = 8 << 20


def slices(items: DataFrame, text_col: str = "text") -> Iterator[list[str]]:
    """The distinct texts of the items in lists of about ``SLICE_CHARS``, dealt by a hash: equal items are one."""
    texts = items.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    parts = -(-(texts.agg(F.sum(F.length("text"))).head()[0] or 0) // SLICE_CHARS)
    for part in range(parts):
        yield sorted(r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect())


def _index(texts: list[str], mark: str) -> Index:
    """The index of some texts, built once in a worker."""
    cache = worker_cache()
    if cache.get("qgram mark") != mark:
        cache["qgram index"], cache["qgram mark"] = Index(enumerate(texts)), mark
    return cache["qgram index"]


def _mark(texts: list[str]) -> str:
    return hashlib.sha256(repr(texts).encode()).hexdigest()


def matches(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id") -> DataFrame:
    """(id, item id, n_windows, start, end, edits): each document and item that share passages, with the number of
    places where one does, the first and last character (end exclusive), and the least edits."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("place", T.LongType()),
                           *[T.StructField(n, T.LongType()) for n in ("n_windows", "start", "end", "edits")]])

    def searcher(some, mark):
        def run(batches):
            index = _index(some, mark)
            for batch in batches:
                pairs: dict[tuple[int, int], list[tuple[int, ...]]] = {}
                for f in index.find([t or "" for t in batch.column("text").to_pylist()]):
                    pairs.setdefault(f[:2], []).append(f)
                ids = batch.column("id").take(pa.array([t for t, _ in pairs], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([index.ids[i] for _, i in pairs], pa.int64()),
                     *[pa.array([get(f) for f in pairs.values()], pa.int64()) for get in (
                         len, lambda f: min(x[3] for x in f), lambda f: max(x[4] for x in f), lambda f: min(x[5] for x in f))]],
                    names=schema.names)
        return run

    spark = df.sparkSession
    docs = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    empty = T.StructType([schema["id"], T.StructField("item", items.schema[item_col].dataType), *schema.fields[2:]])
    found = [spark.createDataFrame([], empty)]
    for some in slices(items, text_col):
        places = named.join(spark.createDataFrame(list(enumerate(some)), "place long, text string"), "text").drop("text")
        found.append(docs.mapInArrow(searcher(some, _mark(some)), schema).join(places, "place").select(*empty.names))
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"id": id_col, "item": item_col})


def clean(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text shares no passage with any item."""
    small_batches(df)
    for some in slices(items, text_col):
        df = df.where(~_leaks(some, _mark(some))(F.col(text_col)))
    return df


def _leaks(some, mark):
    @F.pandas_udf("boolean")
    def leaks(texts):
        import pandas as pd
        hit = {f[0] for f in _index(some, mark).find([t or "" for t in texts])}
        return pd.Series([n in hit for n in range(len(texts))])
    return leaks
