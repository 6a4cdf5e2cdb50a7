"""Signature files and tables: (sig_id, category, pattern, name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def signatures_from_json(files: DataFrame, body: str = "value", *keep: str) -> DataFrame:
    """Signature rows of whole-file JSON texts, one file per row, with the columns in ``keep`` to tell files apart.

    A file is a list of strings or an object of named lists. Object keys that start with ``_`` and values that are
    not lists are skipped; ids are positions in the file's flattened list. Any other shape fails the job.
    """
    text = F.trim(F.col(body))
    is_list = text.startswith("[")
    bad = F.raise_error(F.lit("a signature file holds neither a list nor an object"))
    # one map covers both shapes: a list becomes the only, unnamed, category
    as_object = F.when(is_list, F.concat(F.lit('{"":'), text, F.lit("}"))).when(text.startswith("{"), text) \
        .otherwise(bad.cast("string"))
    lists = F.filter(F.map_entries(F.from_json(as_object, "map<string,string>")), lambda entry:
                     (is_list | ~entry["key"].startswith("_")) & F.trim(entry["value"]).startswith("["))
    items = F.flatten(F.transform(lists, lambda entry: F.transform(
        F.from_json(entry["value"], "array<string>"),
        lambda item: F.struct(F.when(~is_list, entry["key"]).alias("category"), item.alias("pattern")))))
    return (files.select(*keep, F.posexplode(items).alias("sig_id", "item"))
            .select(*keep, "sig_id", F.col("item.category").alias("category"), F.col("item.pattern").alias("pattern"),
                    F.concat_ws(":", "item.category", "item.pattern").alias("name")))


def load_signatures(spark: SparkSession, path: str) -> DataFrame:
    """The signatures of one file."""
    return signatures_from_json(spark.read.text(path, wholetext=True))


def signatures_from_table(items: DataFrame, sig_id: Column, pattern: Column) -> DataFrame:
    """Signatures kept as table rows, ids given."""
    return items.select(sig_id.cast("int").alias("sig_id"), F.lit(None).cast("string").alias("category"),
                        pattern.alias("pattern"), pattern.alias("name"))


def pattern_count(signatures: DataFrame) -> DataFrame:
    """Highest id of a non-empty pattern plus one; 0 when there is none."""
    used = F.when(F.length("pattern") > 0, F.col("sig_id"))
    return signatures.agg(F.coalesce(F.max(used) + 1, F.lit(0)).alias("pattern_count"))
