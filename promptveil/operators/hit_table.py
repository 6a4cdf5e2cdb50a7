"""A stored table of signature hits that follows changing texts and changing signatures without whole scans.

Each update is one batch of a ``BatchStore``: new texts are scanned for all signatures in force, old texts only for those
that the update adds, and nothing is scanned for those it removes. Old rows are never rewritten. A stored hit counts as
long as its signature is in force since its batch or earlier, and its text was not taken away in a later batch; so
a signature that comes back is one that is added. An update that fails half way leaves nothing that readers see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.operators import scan
from promptveil.session import written
from promptveil.sources.batch_store import BatchStore

_SIGNATURE = [T.StructField("sig_id", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("name", T.StringType())]
_SAME = ("sig_id", "pattern", "name")


def hit_store(spark: SparkSession, path: str, key: T.StructField) -> BatchStore:
    """The store below ``path`` for texts known by a column like ``key``."""
    return BatchStore(spark, path, {
        "hits": T.StructType([key, T.StructField("sig_id", T.IntegerType()), T.StructField("first_end", T.LongType())]),
        "signatures": T.StructType([*_SIGNATURE, T.StructField("since", T.LongType())]), "gone": T.StructType([key])})


def in_force(store: BatchStore) -> DataFrame:
    """(sig_id, pattern, name, since): the signatures of the last update, and the update that added each."""
    last = store.committed().agg(F.max("batch")).head()[0]
    rows = store.read("signatures")
    return rows.where(F.col("batch") == (-1 if last is None else last)).drop("batch")


def update(store: BatchStore, batch: int, old_texts: DataFrame, new_texts: DataFrame, signatures: DataFrame, key: str,
           text: str = "text", gone: DataFrame | None = None) -> bool:
    """Bring the table up to date; False if ``batch``, a number that grows, was done before.

    ``signatures`` is the whole set from now on (ids are unique in it; an id with another pattern or name is a new
    signature, empty patterns count for nothing). ``old_texts`` are those of earlier updates, read only if signatures are
    added. ``gone`` holds keys of texts that are no more; a text that has changed is in it and in ``new_texts``.
    """
    if store.has(batch):
        return False
    last = store.committed().agg(F.max("batch")).head()[0]
    if last is not None and batch <= last:
        raise ValueError(f"update {batch} comes after {last}")
    before = in_force(store).select(*[F.col(c).alias(f"{c}__") for c in _SAME], "since")
    wanted = signatures.where(F.length("pattern") > 0).select(F.col("sig_id").cast("int").alias("sig_id"), "pattern", "name")
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in _SAME]
    now = written(wanted.distinct().join(before, same, "left").select(
        *_SAME, F.coalesce("since", F.lit(batch).cast("bigint")).alias("since")), "signatures")
    added = now.where(F.col("since") == batch)
    hits = scan.scan(new_texts, now, key, text)
    if last is not None and not added.isEmpty():
        rest = old_texts if gone is None else old_texts.join(gone.select(key), key, "left_anti")
        hits = hits.unionByName(scan.scan(rest, added, key, text))
    removed = new_texts.select(key).where("false") if gone is None else gone.select(key)
    return store.commit(batch, {"hits": hits.select(key, "sig_id", F.col("first_end").cast("bigint").alias("first_end")),
                                "signatures": now, "gone": removed})


def read_hits(store: BatchStore, key: str) -> DataFrame:
    """(key, sig_id, name, pattern, first_end) of every hit of the signatures in force in the texts there are; patterns
    as they were given."""
    hits = store.read("hits").join(in_force(store), "sig_id").where(F.col("batch") >= F.col("since"))
    gone = store.read("gone").groupBy(key).agg(F.max("batch").alias("until__"))
    return (hits.join(gone, key, "left").where(F.col("until__").isNull() | (F.col("batch") >= F.col("until__")))
            .select(key, "sig_id", "name", "pattern", "first_end"))
