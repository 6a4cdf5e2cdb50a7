"""Near duplicates by SimHash: pigeonhole blocks of the fingerprint, join on blocks, Hamming check, components.

A fingerprint has 64 bits in four blocks of 16. Two fingerprints that differ in at most two bits agree in at least two
blocks, so each distinct fingerprint is keyed by every pair of its blocks (six keys of 32 bits) and only fingerprints
that share a key can be linked. Buckets of up to ``SMALL`` fingerprints are joined pair by pair and verified. A larger
bucket would give a quadratic number of pairs; its fingerprints are keyed by themselves and their 64 one-bit flips
instead: two of them share such a key exactly when they differ in at most two bits, and at most 65 fingerprints can
share one. Both ways lose no link and emit a number of rows in proportion to the fingerprints.

Null, empty and white-space texts have fingerprint zero and are linked like any other. Repeated rows are kept, rows
with a null id too (null is never the smallest id, unless a component has no other). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import give_back, pieces, small_batches, unused, utf8
from promptveil.session import written

SEED = 42
RADIUS = 2
SMALL = 32
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in order, in chunks."""
    carry: list[bytes] = []
    seen = 0
    for piece in pieces(text.lower()):
        parts = carry + piece.split()
        seen += len(parts) - len(carry)
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64).tolist()
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        for at in range(0, max(0, len(parts) - words + 1), _CHUNK):
            stop = min(at + _CHUNK, len(parts) - words + 1)
            yield np.fromiter((digest(line[a:b - 1], SEED) for a, b in
                               zip(starts[at:stop], ends[at + words - 1:stop + words - 1], strict=True)),
                              np.uint64, stop - at)
        carry = parts[len(parts) - words + 1:] if len(parts) >= words else parts
    if 0 < seen < words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints_of(texts: Iterable[bytes], words: int) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts: a bit is set if it is in over half of the shingle hashes."""
    counts: list[np.ndarray] = []
    totals: list[int] = []
    waiting: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if waiting:
            counts.extend(_bit_counts(np.concatenate(waiting), np.cumsum([0, *map(len, waiting[:-1])])))
            waiting.clear()
            held = 0

    for text in texts:
        own = list(shingle_hashes(text, words)) if len(text) < _CHUNK else None
        if own is not None and len(own) == 1:
            waiting.append(own[0])
            totals.append(len(own[0]))
            held += len(own[0])
            if held >= _CHUNK:
                settle()
            continue
        settle()
        total, n = np.zeros(64, np.int64), 0
        for chunk in own if own is not None else shingle_hashes(text, words):
            total += _bit_counts(chunk, np.array([0]))[0]
            n += len(chunk)
        counts.append(total)
        totals.append(n)
    settle()
    if not totals:
        return np.zeros(0, np.int64)
    set_bits = np.stack(counts) * 2 > np.array(totals)[:, None]
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long, mark long): the fingerprint of every text, and a hash of the text that tells rows apart."""
    def run(batches):
        for batch in batches:
            found = fingerprints_of(utf8(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found), batch.column("mark")],
                                             names=["id", "fp", "mark"])
        give_back()

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType()),
                           T.StructField("mark", T.LongType())])
    return small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                                    F.xxhash64(text_col).alias("mark")).mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block_keys(fp: Column) -> Column:
    block = [F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.explode(F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
                               for n, (i, j) in enumerate(combinations(range(4), 2))]))


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints within two bits of each other. ``distinct`` has column fp,
    each value once."""
    keyed = distinct.select("fp", _block_keys(F.col("fp")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mates = written(keyed.join(shared, "key"), "simhash-mates")
    few = mates.where(F.col("n") <= small).select("key", F.col("fp").alias("a"))
    pairs = few.join(few.select("key", F.col("a").alias("b")), "key").where("a < b")
    near = pairs.where(distance(F.col("a"), F.col("b")) <= RADIUS).select("a", "b")
    many = mates.where(F.col("n") > small).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1).cast("bigint") if i == 0 else
                                                         F.shiftleft(F.lit(1).cast("bigint"), i)) for i in range(64)])
    stars = (many.select("fp", F.explode(flips).alias("middle")).groupBy("middle")
             .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))  # 65 at most
             .where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b"))
    return near.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the connected components of edges (a, b), by smallest label and pointer jumping."""
    both = written(edges.union(edges.select("b", "a")).toDF("src", "dst"), "simhash-edges")
    labels = written(both.groupBy(F.col("src").alias("node"))
                     .agg(F.least(F.min("src"), F.min("dst")).alias("root")), "simhash-labels")
    while True:
        seen = (both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node"))
                .agg(F.min("root").alias("seen")))
        lower = written(labels.join(seen, "node").select("node", F.col("root").alias("old"),
                                                         F.least("root", "seen").alias("root")), "simhash-lower")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        stepped = written(lower.join(jump, "root", "left")
                          .select("node", "old", F.coalesce(F.least("root", "beyond"), "root").alias("root")),
                          "simhash-labels")
        labels = stepped.select("node", "root")
        if stepped.where("root <> old").isEmpty():
            return labels


def classes(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of (id, fp): a fingerprint that names its component, and
    the smallest id reachable."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    edges = written(links(distinct.select("fp"), small), "simhash-links")
    if edges.isEmpty():
        return distinct.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    rooted = distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left")
    least = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("component_id"))
    return (rooted.join(least, "root", "left")
            .select("fp", F.coalesce("root", "fp").alias("root"),
                    F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id"))
                    .alias("component_id")))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``df``."""
    prints = written(fingerprints(df, id_col, text_col, words), "simhash-prints")
    found = written(classes(prints), "simhash-classes")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), hexed(F.col("fp")).alias("fingerprint"),
                                           "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row of each component: that with the smallest id, of equal ids that with the smallest text hash, of equal
    rows any. Only ids and hashes are looked at; texts are dealt once, by (id, text hash), and a second time only those of
    repeated rows."""
    prints = written(fingerprints(df, id_col, text_col, words), "simhash-prints")
    found = written(classes(prints), "simhash-classes")
    own, mark, row, n = unused(df, "own", "mark", "row", "n")
    stays = (prints.join(found, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
             .groupBy("root", "mark").agg(F.min("id").alias("id"), F.count("*").alias("n"))
             .groupBy("root").agg(F.min(F.struct("mark", "id", "n")).alias("row")))
    stays = written(stays.select(F.col("row.id").alias(own), F.col("row.mark").alias(mark), F.col("row.n").alias(n)), "simhash-stays")

    def those(some: DataFrame) -> DataFrame:
        same = F.col(id_col).eqNullSafe(some[own]) & (F.xxhash64(text_col) == some[mark])
        return df.join(some, same, "left_semi")

    repeated = stays.where(F.col(n) > 1)
    if repeated.isEmpty():
        return those(stays)
    once = (those(repeated).withColumn(own, F.col(id_col)).withColumn(mark, F.xxhash64(text_col))
            .withColumn(row, F.row_number().over(Window.partitionBy(own, mark).orderBy(F.lit(1)))))
    return those(stays.where(F.col(n) == 1)).unionByName(once.where(F.col(row) == 1).drop(own, mark, row))
