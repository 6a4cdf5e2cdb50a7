"""Ranked lexical search over a length-stratified index.

The score of a document sums, over a query's terms, w(term) * ((10^9 tf) div (1000 tf + 12 m)), where m is the document's
length normaliser. Two documents of equal m and equal tf have the same impact, so documents are grouped in strata of equal
m, and a term's postings in a stratum are grouped by tf: an impact is worked out once for each (stratum, tf) of a term.

``index`` stores blocks of whole texts (about ``BLOCK_BYTES`` of text each), each an index of its own: documents in the
order of their m, terms in byte order, and for each term its groups (stratum, tf falling) and their documents. A block is
built where its texts are read; no posting is shuffled, so a frequent term is spread over all blocks.

``search`` takes the document frequencies of the queries' terms from the blocks (a sum of a row for each query term and
task), then visits each block's strata for each query by falling bound, the sum of the best impact of each term there. A
stratum whose bound lies under the query's k-th best score so far is passed over; an equal one is visited, as ties go by
id. A task keeps the best ``k`` of each query over all its blocks, and the tasks' lists are merged.

Queries are taken in slices of ``SLICE_CHARS``, one pass over the blocks for each, so that what goes to the workers is
bounded; equal texts are searched for once. Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased. A null or termless text is no document and a null or termless query finds nothing. Repeated rows of documents
rank each for itself, a null id last among equals; a repeated (item, text) is answered once. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import give_back, small_batches, utf8, worker_cache
from promptveil.session import run_folder, written

BEST = 20
BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 1 << 16
SLICE_CHARS = 4 << 20
# a block is a row group of its own: else Spark's writer holds a hundred rows before it looks at their size, and its reader
# decodes all rows of a row group at once
ROW_GROUPS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ARRAYS = {"strata": np.int64, "first_doc": np.int32, "first_group": np.int32, "group_stratum": np.uint16,
           "group_tf": np.int32, "group_size": np.int32, "docs": np.uint16}


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_BYTES).split()


def term_count(text: bytes) -> int:
    """Number of terms, counted where they begin."""
    inside = np.frombuffer(text.translate(_BYTES), np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + (len(inside) > 0 and inside[0]))


def totals(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms)."""
    def run(batches):
        docs = terms = 0
        for batch in batches:
            found = [term_count(t) for t in utf8(batch.column("text"))]
            docs, terms = docs + sum(map(bool, found)), terms + sum(found)
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["docs", "terms"])
        give_back()

    row = (small_batches(df).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "docs long, terms long")
           .agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).head())
    return row["docs"] or 0, row["terms"] or 0


class Block:
    """The index of some texts: see the module. ``ids`` is in the order of the documents."""

    def __init__(self, order: np.ndarray, terms: pa.Array, arrays: dict[str, np.ndarray]):
        self.order, self.terms = order, terms
        self.__dict__.update(arrays)
        self.arrays = arrays


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of each token, term of each token, terms)."""
    cleaned = pa.array([t.translate(_BYTES).strip() for t in texts], pa.binary()).cast(pa.string(), safe=False)
    words = pc.ascii_split_whitespace(cleaned)
    lengths = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    code = coded.indices.to_numpy()
    empty = pc.index_in(pa.scalar(""), coded.dictionary).as_py() if len(coded.dictionary) else None
    if empty is not None:  # a text without terms splits into one empty word
        owner, code = owner[code != empty], code[code != empty]
    return owner, code, coded.dictionary


def block_of(texts: list[bytes], n_docs: int, n_terms: int) -> Block:
    owner, code, terms = _tokens(texts)
    lengths = np.bincount(owner, minlength=len(texts))
    m = 75 + 25 * lengths * n_docs // max(1, n_terms)
    order = np.lexsort((np.arange(len(texts)), m))
    order = order[lengths[order] > 0]
    strata, first_doc = np.unique(m[order], return_index=True)
    rank = np.zeros(len(texts), np.int32)
    rank[order] = np.arange(len(order))
    # one posting for each (term, document), terms in byte order
    by_bytes = pc.sort_indices(terms.cast(pa.binary())).to_numpy()
    place = np.zeros(len(terms), np.int64)
    place[by_bytes] = np.arange(len(terms))
    posting = place[code] << 32
    posting |= rank[owner]
    del owner, code
    posting, tf = np.unique(posting, return_counts=True)
    term, doc, tf = (posting >> 32).astype(np.int32), (posting & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)
    del posting
    stratum = (np.searchsorted(first_doc, doc, side="right") - 1).astype(np.int32)
    seq = np.lexsort((doc, -tf, stratum, term))
    term, doc, stratum, tf = term[seq], doc[seq], stratum[seq], tf[seq]
    new = np.ones(len(seq), np.bool_)
    new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
    at = np.flatnonzero(new)
    arrays = {"strata": strata, "first_doc": first_doc, "first_group": np.searchsorted(term[at], np.arange(len(terms) + 1)),
              "group_stratum": stratum[at], "group_tf": tf[at], "group_size": np.diff(np.append(at, len(seq))), "docs": doc}
    return Block(order, terms.cast(pa.binary()).take(pa.array(by_bytes)), {k: arrays[k].astype(t) for k, t in _ARRAYS.items()})


def index(df: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all texts of ``df``, stored."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("terms", T.ArrayType(T.BinaryType())),
                           *[T.StructField(n, T.BinaryType()) for n in _ARRAYS]])

    def run(batches):
        texts, ids, held = [], [], 0

        def packed():
            block = block_of(texts, n_docs, n_terms)
            every = pa.concat_arrays(ids).take(pa.array(block.order))
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
                 pa.ListArray.from_arrays(pa.array([0, len(block.terms)], pa.int32()), block.terms)]
                + [pa.array([block.arrays[n].tobytes()], pa.binary()) for n in _ARRAYS], names=schema.names)

        for batch in batches:
            start = 0
            for at, text in enumerate(utf8(batch.column("text"))):
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES or len(texts) == BLOCK_DOCS:
                    ids.append(batch.column("id").slice(start, at + 1 - start))
                    yield packed()
                    texts, ids, held, start = [], [], 0, at + 1
                    give_back()
            if start < len(batch):
                ids.append(batch.column("id").slice(start))
        if texts:
            yield packed()
        give_back()

    folder = run_folder(df.sparkSession, "lexical-index")
    (small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
     .mapInArrow(run, schema).write.options(**ROW_GROUPS).parquet(folder))
    return df.sparkSession.read.schema(schema).parquet(folder)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Block]]:
    for at in range(len(batch)):
        one = batch.slice(at, 1)
        arrays = {n: np.frombuffer(one.column(n)[0].as_py(), t) for n, t in _ARRAYS.items() if n in batch.schema.names}
        yield (one.column("ids").flatten() if "ids" in batch.schema.names else None,
               Block(np.zeros(0), one.column("terms").flatten(), arrays))


def frequencies(blocks: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of ``terms`` is; terms in none are left out."""
    def run(batches):
        n = np.zeros(len(terms), np.int64)
        wanted = pa.array(terms, pa.binary())
        for batch in batches:
            for _, block in _opened(batch):
                at = pc.index_in(wanted, block.terms).to_numpy(zero_copy_only=False)
                sums = np.concatenate([[0], np.cumsum(block.group_size, dtype=np.int64)])[block.first_group]
                some = np.flatnonzero(~np.isnan(at.astype(np.float64)))
                own = at[some].astype(np.int64)
                n[some] += sums[own + 1] - sums[own]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    found = blocks.select("terms", "first_group", "group_size").mapInArrow(run, "term long, n long")
    return {terms[r["term"]]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The best ``k`` documents of a query so far: scores, and ids with null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), []

    def floor(self) -> int:
        """No score below this can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def enter(self, scores: np.ndarray, ids: list) -> None:
        every, names = np.concatenate([self.scores, scores]), [*self.ids, *ids]
        order = sorted(range(len(every)), key=lambda i: (-every[i], names[i] is None, names[i] if names[i] is not None else 0))[:self.k]
        self.scores, self.ids = every[order], [names[i] for i in order]


def visit(block: Block, ids: pa.Array, query: list[tuple[int, int]], best: Best) -> int:
    """Enters a block's documents for a query of (place of a term in the block, weight times repeats); returns the number of
    strata visited."""
    if not query:
        return 0
    begin = block.first_group[[t for t, _ in query]].astype(np.int64)
    size = block.first_group[[t + 1 for t, _ in query]] - begin
    owner = np.repeat(np.arange(len(query)), size)
    group = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(owner))
    stratum, tf = block.group_stratum[group].astype(np.int64), block.group_tf[group].astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * block.strata[stratum])  # once for each stratum and tf of a term
    value = np.array([w for _, w in query], np.int64)[owner] * impact
    # a term's highest tf in a stratum comes first
    top = np.ones(len(group), np.bool_)
    top[1:] = (stratum[1:] != stratum[:-1]) | (owner[1:] != owner[:-1])
    bounds = np.zeros(len(block.strata), np.int64)
    np.add.at(bounds, stratum[top], np.maximum(value[top], 0))
    order = np.argsort(-bounds, kind="stable")
    ends = np.append(block.first_doc[1:], len(ids)).astype(np.int64)
    posting = block.group_first[group]
    seen, take = 0, 1
    by_stratum = np.argsort(stratum, kind="stable")
    cuts = np.searchsorted(stratum[by_stratum], np.arange(len(block.strata) + 1))
    while seen < len(order):
        some = order[seen:seen + take]
        some = some[bounds[some] >= best.floor()]
        if not len(some):
            break
        seen, take = seen + len(some), 2 * take
        some = np.sort(some)
        mine = np.concatenate([by_stratum[cuts[s]:cuts[s + 1]] for s in some])
        sizes = block.group_size[group[mine]].astype(np.int64)
        at = np.repeat(posting[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        doc = block.docs[at].astype(np.int64)
        spans = ends[some] - block.first_doc[some]
        shift = np.zeros(len(block.strata), np.int64)
        shift[some] = np.cumsum(spans) - spans - block.first_doc[some]
        scores = np.zeros(spans.sum(), np.int64)
        np.add.at(scores, doc + np.repeat(shift[stratum[mine]], sizes), np.repeat(value[mine], sizes))
        good = np.flatnonzero(scores >= best.floor())
        if len(good) > best.k:  # of many, those that may be among the best, ties whole
            least = np.partition(scores[good], len(good) - best.k)[len(good) - best.k]
            good = good[scores[good] >= least]
        if len(good):
            every = np.concatenate([np.arange(a, b) for a, b in zip(block.first_doc[some], ends[some], strict=True)])
            best.enter(scores[good], ids.take(pa.array(every[good])).to_pylist())
    return seen


def _queries(texts: list[str]) -> list[list[tuple[bytes, int]]]:
    return [sorted(Counter(terms_of(t.encode("utf-8", "surrogatepass"))).items()) for t in texts]


def slices(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[DataFrame, list[str]]]:
    """Distinct texts in lists of about ``SLICE_CHARS``, each with the (item, text) rows that hold them."""
    known = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    texts = written(known.select("text").distinct(), "lexical-queries")
    parts = -(-(texts.agg(F.sum(F.length("text"))).head()[0] or 0) // SLICE_CHARS)
    for part in range(parts):
        inside = F.pmod(F.xxhash64("text"), F.lit(parts)) == part
        yield known.where(inside), [r["text"] for r in texts.where(inside).orderBy("text").collect()]


def best_of(blocks: DataFrame, texts: list[str], n_docs: int, k: int = BEST) -> DataFrame:
    """(number of the text, rank, id, score): the best ``k`` documents of each text over all blocks."""
    queries = _queries(texts)
    terms = sorted({t for q in queries for t, _ in q})
    df = frequencies(blocks, terms)
    weighed = [[(t, n * weight(df[t], n_docs)) for t, n in q if t in df] for q in queries]
    mark = hashlib.sha256(repr((k, weighed)).encode()).hexdigest()
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", blocks.schema["ids"].dataType.elementType),
                           T.StructField("score", T.LongType())])

    def run(batches):
        best = [Best(k) for _ in weighed]
        cache = worker_cache()
        if cache.get("lexical mark") != mark:
            cache["lexical terms"], cache["lexical mark"] = pa.array(terms, pa.binary()), mark
        number = {t: n for n, t in enumerate(terms)}
        id_type = None
        for batch in batches:
            for ids, block in _opened(batch):
                id_type = ids.type
                block.group_first = np.cumsum(block.group_size, dtype=np.int64) - block.group_size
                places = pc.fill_null(pc.index_in(cache["lexical terms"], block.terms), -1).to_numpy()
                for own, query in zip(best, weighed, strict=True):
                    visit(block, ids, [(int(places[number[t]]), w) for t, w in query if places[number[t]] >= 0], own)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, b in enumerate(best) for _ in b.ids], pa.int64()), pa.array([i for b in best for i in b.ids], id_type),
                 pa.array(np.concatenate([b.scores for b in best]) if best else [], pa.int64())], names=schema.names)
        give_back()

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return (blocks.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query", "rank", "id", "score"))


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           k: int = BEST) -> DataFrame:
    """(item, rank from 1, id, score): the best ``k`` documents of every item, those of score above 0."""
    n_docs, n_terms = totals(df, text_col)
    blocks = index(df, n_docs, n_terms, id_col, text_col)
    schema = T.StructType([T.StructField(item_col, items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.LongType())])
    found = [df.sparkSession.createDataFrame([], schema)]
    for rows, texts in slices(items, item_col, text_col):
        numbers = df.sparkSession.createDataFrame(list(enumerate(texts)), "query long, text string")
        named = rows.join(numbers, "text").select("query", "item")
        found.append(best_of(blocks, texts, n_docs, k).join(named, "query")
                     .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    return reduce(DataFrame.unionAll, found)
