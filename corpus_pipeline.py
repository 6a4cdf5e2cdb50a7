"""Documents in, token files out: five stages, each a table that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last one the index of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptveil.llm import decontaminate, language, mixing, simhash, token_files
from promptveil.llm.common import small_batches, table, unused
from promptveil.llm.queries import tokenizer_path
from promptveil.session import run_folder, written

#: Below this likeness to the nearest profile a text is taken for no language.
LEAST_SCORE = 0.15


def spoken(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; texts without letters and unlike every profile go. If the training
    share teaches no language, only null texts and texts without letters go."""
    ranks = language.learned(docs.where(language.bucket(F.col("doc_id"), 4) != 2))
    if not ranks.langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    [found] = unused(docs, "found")
    named = small_batches(docs).withColumn(found, language.nearest(ranks)(F.col("text")))
    return named.where((F.col(f"{found}.lang_pred") != language.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).drop(found)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: three-word shingles, fingerprints at most two bits apart."""
    return simhash.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mixed_rows(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in a run folder, and one row for each document in them."""
    path = run_folder(spark, "token-files")
    token_files.write(docs, path, tokenizer_path())
    return token_files.read_index(spark, path)


STAGES = [("language", spoken), ("near duplicates", unlike), ("decontamination", unseen), ("mixing", mixed),
          ("token files", tokenized)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
