"""The audit table: Parquet by date, append only, newest row per request on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.schemas import AUDIT

STORED = T.StructType([*AUDIT.fields, T.StructField("write_seq", T.LongType()), T.StructField("date", T.DateType())])


def write_audit(rows: DataFrame, path: str, write_seq: int) -> None:
    """Append a batch. ``write_seq`` grows from batch to batch; rewriting the same one replaces its files only."""
    stamped = rows.withColumns({"write_seq": F.lit(write_seq).cast("bigint"), "date": F.to_date("ts")})
    _write_dates(stamped, f"{path.rstrip('/')}/batch={write_seq}")


def _write_dates(rows: DataFrame, folder: str) -> None:
    """Rows by date. Those of a date are brought together first, else each task writes a file for each date; adaptive
    execution cuts large dates."""
    rows.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(folder)


def read_audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """All written rows of all batches, with date as a partition column."""
    return spark.read.schema(STORED).parquet(path).drop("batch")


def newest(rows: DataFrame, key: str = "request_id", seq: str = "write_seq") -> DataFrame:
    """The last written row per key. An aggregate, so copies of a much repeated key are reduced before the shuffle."""
    others = [c for c in rows.columns if c not in (key, seq)]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("row__"))
    return latest.select(key, *[F.col(f"row__.{c}").alias(c) for c in others])


def read_audit(spark: SparkSession, path: str, dates: tuple[str | None, str | None] = (None, None),
               columns: list[str] | None = None) -> DataFrame:
    """The newest row per request, from the first to the last of ``dates`` (either may be open), and of it ``columns``.

    Both bounds and columns are applied before the rows of a request are brought together, so that partitions and
    columns not asked for are never read. A request keeps its time, so all its rows lie in one date.
    """
    rows = read_audit_rows(spark, path)
    first, last = dates
    if first is not None:
        rows = rows.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("date") <= F.lit(last).cast("date"))
    if columns is not None:
        rows = rows.select("request_id", *[c for c in columns if c != "request_id"], "write_seq")
    return newest(rows)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest rows into a store of their own, as one batch numbered like the last one read."""
    rows = newest(read_audit_rows(spark, path).drop("date"))
    last = read_audit_rows(spark, path).agg(F.max("write_seq")).first()[0]
    write_audit(rows, target, last)


SNAPSHOT = T.StructType([T.StructField("version", T.LongType()), T.StructField("through", T.LongType()),
                         T.StructField("date", T.DateType())])


def _versions(spark: SparkSession, target: str) -> DataFrame:
    """(version, through, date): which compaction wrote which dates, and the last batch it had read."""
    spark.createDataFrame([], SNAPSHOT).write.mode("ignore").json(f"{target}/versions")
    return spark.read.schema(SNAPSHOT).json(f"{target}/versions")


def compact_new(spark: SparkSession, path: str, target: str) -> int:
    """Bring the compacted store ``target`` up to date with the batches written below ``path`` since the last time, and
    return its version. Only dates with rows in these batches are written anew, each beside its former files, and a
    version is there when its lines are: readers of an earlier one keep seeing it."""
    known = _versions(spark, target).agg(F.max("version"), F.max("through")).head()
    version, through = (known[0] or 0) + 1, -1 if known[1] is None else known[1]
    rows = spark.read.schema(T.StructType([*STORED.fields, T.StructField("batch", T.LongType())])).parquet(path)
    new = rows.where(F.col("batch") > through)  # folders of earlier batches are not read
    found = new.groupBy("date").agg(F.max("batch").alias("batch")).collect()  # days
    if not found:
        return version - 1
    last, dates = max(r["batch"] for r in found), [r["date"] for r in found]
    old = read_compacted_rows(spark, target).where(F.col("date").isin(dates))
    every = new.select(*STORED.names).unionByName(old).where(F.col("request_id").isNotNull())
    merged = newest(every.withColumn("seq__", F.col("write_seq")), seq="seq__")
    _write_dates(merged, f"{target}/rows/version={version}")
    lines = spark.createDataFrame([(version, last, d) for d in dates], SNAPSHOT)
    lines.coalesce(1).write.mode("append").json(f"{target}/versions")
    return version


def read_compacted_rows(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The newest row per request in the compacted store, as of ``version`` (the last one if not given)."""
    lines = _versions(spark, target)
    if version is not None:
        lines = lines.where(F.col("version") <= version)
    current = lines.groupBy("date").agg(F.max("version").alias("version"))
    if current.isEmpty():
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(T.StructType([*STORED.fields, T.StructField("version", T.LongType())])).parquet(f"{target}/rows")
    return rows.join(current, ["date", "version"], "left_semi").select(*STORED.names)


def outcomes(audit: DataFrame) -> DataFrame:
    """The narrow projection most readers want."""
    return audit.select("decision", "status_code", "terminating_stage")
