"""Vector codes: product quantisation of whole-number vectors, with distances read from per-dimension value dictionaries.

A component x becomes floor(4096 x); a vector is cut into ``PARTS`` equal parts and each part gets the index of the
nearest of ``ENTRIES`` codebook entries. Codebooks start as the vectors of the smallest ids and are moved ``ROUNDS`` times
to the floor of the mean of their parts; an entry that no part chose stays.

Vectors are stored once, in blocks of up to ``BLOCK`` rows. For every dimension a block holds its distinct integers in
order (the dictionary) and the rows' places in it, so that a round tabulates the squared difference of each distinct
integer to each entry's component, once, and a part's distances are gathers from those tables and adds. A dictionary has
no more values than its block has rows, whatever the data, so a task's memory is bounded. What leaves a round is one
sum for each codebook component and one count for each entry from a task; the driver holds the codebooks alone.

Rows whose vector is null or holds null or non-finite components are dropped, repeated rows are kept and count each time.
A null id comes last among the smallest ids; equal ids go by their vectors. With fewer rows than entries there are as many
entries as rows, without rows none and no result. Ties go to the lower index. Vectors must have one length, a multiple of
the parts, and whole components below ``LARGEST`` in size, so that sums stay exact: anything else is an error. The empty
vector has parts without components: index 0, no error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import give_back
from promptveil.session import run_folder, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 1 << 15
LARGEST = 1 << 24


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vec array<long>) of the rows that are kept."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("vec", lambda x: F.floor(x * float(SCALE)))
    fits = F.forall("whole", lambda x: F.abs(x) < LARGEST)
    return (df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
            .where(F.col("vec").isNotNull() & finite).select("id", "label", scaled.alias("whole"))
            .select("id", "label", F.when(fits, F.col("whole")).otherwise(
                F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more"))).alias("vec")))


def dictionaries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, codes) of whole-number rows: each dimension's distinct values one after the other, how many there
    are, and each row's place in its dimension's values, dimension by dimension."""
    values, sizes, codes = [], np.zeros(rows.shape[1], np.int32), np.zeros(rows.shape[::-1], np.uint16)
    for d in range(rows.shape[1]):
        own, codes[d] = np.unique(rows[:, d], return_inverse=True)
        values.append(own)
        sizes[d] = len(own)
    return np.concatenate(values) if values else np.zeros(0, np.int64), sizes, codes


def part_distances(values: list[np.ndarray], codes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) squared distances of one part: a table of squared differences for each of its dimensions, gathered
    by the codes and added up."""
    total = np.zeros((codes.shape[1], len(entries)), np.int64)
    for own, code, component in zip(values, codes, entries.T, strict=True):
        total += ((own[:, None] - component[None, :]) ** 2)[code]
    return total


def assigned(block: dict, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, rows) indexes and distances of the nearest entries; ``codebooks`` is (parts, entries, width)."""
    parts, _, width = codebooks.shape
    index, far = np.zeros((parts, block["rows"]), np.int64), np.zeros((parts, block["rows"]), np.int64)
    for p in range(parts):
        span = slice(p * width, (p + 1) * width)
        distance = part_distances(block["values"][span], block["codes"][span], codebooks[p])
        index[p] = distance.argmin(axis=1)  # the first of equals
        far[p] = distance[np.arange(len(distance)), index[p]]
    return index, far


def moves(block: dict, codebooks: np.ndarray) -> np.ndarray:
    """(parts, entries, width + 1): sums of the parts that chose an entry, and their number."""
    parts, entries, width = codebooks.shape
    index, _ = assigned(block, codebooks)
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        for w in range(width):
            np.add.at(out[p, :, w], index[p], block["values"][p * width + w][block["codes"][p * width + w]])
        out[p, :, width] = np.bincount(index[p], minlength=entries)
    return out


def _blocks(batches):
    """The stored blocks of some batches, read back."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int32)
            values = np.split(np.frombuffer(row["dictionary"], np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []
            codes = np.frombuffer(row["codes"], np.uint16).reshape(len(sizes), -1) if len(sizes) else np.zeros((0, row["n"]), np.uint16)
            yield row, {"rows": row["n"], "values": values, "codes": codes}


def stored_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ids, labels, n, dictionary, sizes, codes): ``rows`` of (id, label, vec) in blocks, stored."""
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
        T.StructField("n", T.LongType()), T.StructField("dim", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in ("dictionary", "sizes", "codes")]])

    def run(batches):
        def packed(waiting):
            table = pa.Table.from_batches(waiting).combine_chunks()
            vec = table.column("vec").combine_chunks()
            widths = np.unique(np.diff(vec.offsets.to_numpy()))
            if len(widths) > 1 or widths[0] % PARTS:
                raise ValueError(f"vectors of lengths {widths[:5].tolist()}: one multiple of {PARTS} is needed")
            n = len(vec)
            values, sizes, codes = dictionaries(vec.flatten().to_numpy().reshape(n, int(widths[0])))
            whole = pa.array([0, n], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(whole, table.column(c).combine_chunks()) for c in ("id", "label")]
                + [pa.array([n], pa.int64()), pa.array([int(widths[0])], pa.int64())]
                + [pa.array([a.tobytes()], pa.binary()) for a in (values.astype(np.int64), sizes, codes)], names=schema.names)

        waiting, held = [], 0
        for batch in batches:
            while held + len(batch) >= block:
                waiting.append(batch.slice(0, block - held))
                batch = batch.slice(block - held)
                yield packed(waiting)
                waiting, held = [], 0
            if len(batch):
                waiting.append(batch)
                held += len(batch)
        if held:
            yield packed(waiting)
        give_back()

    folder = run_folder(rows.sparkSession, "vector-blocks")
    rows.mapInArrow(run, schema).write.parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder)


def first_codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray | None:
    """(parts, entries, width): the parts of the vectors of the smallest ids."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not first:
        return None
    if len({len(r["vec"]) for r in first}) > 1 or len(first[0]["vec"]) % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    width = len(first[0]["vec"]) // parts
    return np.array([r["vec"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)


def moved(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all blocks."""
    shape = (*codebooks.shape[:2], codebooks.shape[2] + 1)

    def run(batches):
        total = np.zeros(shape, np.int64)
        for _, block in _blocks(batches):
            total += moves(block, codebooks)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total.ravel()[at])], names=["slot", "total"])
        give_back()

    sums = blocks.select("n", "dictionary", "sizes", "codes").mapInArrow(run, "slot long, total long")
    found = np.zeros(shape, np.int64)
    for row in sums.groupBy("slot").agg(F.sum("total").alias("total")).collect():  # a row for each codebook component at most
        found.ravel()[row["slot"]] = row["total"]
    counts = found[:, :, -1:]
    return np.where(counts > 0, found[:, :, :-1] // np.maximum(counts, 1), codebooks)


def trained(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        after = moved(blocks, codebooks)
        if np.array_equal(after, codebooks):  # further rounds would change nothing
            break
        codebooks = after
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encoded(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every row of the blocks."""
    digits = np.array([f"{n:02x}" for n in range(codebooks.shape[1])])
    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType),
                           T.StructField("label", blocks.schema["labels"].dataType.elementType),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                _, block = next(_blocks([one.select(["n", "dictionary", "sizes", "codes"])]))
                index, far = assigned(block, codebooks)
                code = digits[index[0]] if len(index) else np.full(block["rows"], "")
                for part in index[1:]:
                    code = np.char.add(code, digits[part])
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array(code.astype(object), pa.string()),
                                                  pa.array(far.sum(axis=0))], names=["id", "label", "code", "error"])
        give_back()

    return blocks.mapInArrow(run, schema)


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every vector that is kept."""
    rows = whole_vectors(df, id_col, vector_col, label_col)
    codebooks = first_codebooks(rows)
    if codebooks is None:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")],
                           F.lit("").alias("codebooks_sha256"))
    blocks = stored_blocks(rows)
    if blocks.select("dim").distinct().limit(2).count() > 1:
        raise ValueError("vectors of several lengths")
    codebooks = trained(blocks, codebooks)
    found = written(encoded(blocks, codebooks), "vector-codes")
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
