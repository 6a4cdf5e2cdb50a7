"""Several tables written together, batch by batch: a batch is there with all its tables or not at all.

A table's rows lie under ``<table>/batch=<n>/attempt=<id>``. When all tables of a batch are written, one row of the
manifest names the attempt that counts, and readers take only rows whose attempt it names. A batch that fails half way
leaves files that nobody reads, its repetition writes a new attempt, and a batch that is in the manifest is not written
again. So any number of repetitions, with executors or the driver lost at any place, give each batch once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])


class BatchStore:
    """Tables below the folder ``path``, with their schemas."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, T.StructType]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        spark.createDataFrame([], MANIFEST).write.mode("ignore").json(f"{self.path}/manifest")

    def committed(self) -> DataFrame:
        """(batch, attempt) of every batch that is there."""
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").distinct()

    def has(self, batch: int) -> bool:
        return not self.committed().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: int, rows: dict[str, DataFrame]) -> bool:
        """Writes all tables of a batch, then its line of the manifest. False if the batch is there already."""
        if set(rows) != set(self.tables):
            raise ValueError(f"a batch has the tables {sorted(self.tables)}, not {sorted(rows)}")
        if self.has(batch):
            return False
        attempt = f"a-{uuid.uuid4().hex}"
        for name, schema in self.tables.items():
            rows[name].select(*schema.names).write.parquet(f"{self.path}/{name}/batch={batch}/attempt={attempt}")
        line = self.spark.createDataFrame([(batch, attempt)], MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{self.path}/manifest")  # one file, moved into place whole
        return True

    def read(self, name: str) -> DataFrame:
        """All rows of a table in committed batches, with their ``batch``."""
        known = self.committed()
        if known.isEmpty():
            return self.spark.createDataFrame([], T.StructType([*self.tables[name].fields, MANIFEST["batch"]]))
        rows = self.spark.read.schema(T.StructType([*self.tables[name].fields, *MANIFEST.fields])).parquet(f"{self.path}/{name}")
        return rows.join(known, ["batch", "attempt"], "left_semi").select(*self.tables[name].names, "batch")
