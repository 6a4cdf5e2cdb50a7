"""One query per operator of this subpackage. Each takes (spark, folder) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptveil.llm import (decontaminate, graph_search, language, length_strata, licenses, link_graph, mixing, personal_data, simhash,
                            token_counts, token_files, toxicity, vector_codes)
from promptveil.llm.common import table
from promptveil.session import run_folder


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.detected(table(spark, folder, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, personal_data.BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def edits_of(doc_id: Column, text: Column) -> Column:
    """Three edits per document, at places that a hash of its id gives: a deletion, an insertion of a piece of the
    text itself, and a replacement."""
    length = F.length(text)

    def place(n: int) -> Column:
        return F.pmod(F.xxhash64(doc_id, F.lit(n)), length + 1)

    def piece(n: int) -> Column:
        return F.substr(text, (place(n) + 1).cast("int"), F.lit(5 + 12 * n))

    def edit(at: Column, delete: int, insert: Column) -> Column:
        return F.struct(at.cast("bigint").alias("place"), F.lit(delete).cast("bigint").alias("delete"), insert.alias("insert"))

    return F.array(edit(place(1), 9, F.lit("")), edit(place(2), 0, piece(3)), edit(place(4), 30, piece(5)))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, folder, "documents")
    edited = docs.select("doc_id", "text", edits_of(F.col("doc_id"), F.col("text")).alias("edits"))
    return token_counts.counted(edited, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and benchmark items that share a passage."""
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def tokenizer_path() -> str:
    """The tokenizer file of the token queries; installed with Python on every machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    part = language.bucket(F.col("doc_id"), 5)
    machine = toxicity.learned(docs.where(part != 0), table(spark, folder, "labels").where(part != 0))
    return toxicity.scored(docs, machine).select("doc_id", (part == 0).alias("held_out"), "score",
                                                (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = run_folder(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, tokenizer_path())
    return token_files.read_index(spark, path)


def op8_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return graph_search.nearest(table(spark, folder, "embeddings"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    part = language.bucket(F.col("doc_id"), 4)
    named = language.identify(docs.select("doc_id", "text"), docs.where(part != 2).select("lang", "text"))
    return named.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return length_strata.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return link_graph.judged(table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data, "op2_token_counts": op2_token_counts,
    "op3_licenses": op3_licenses, "op4_mix": op4_mix, "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity, "op7_token_files": op7_token_files, "op8_graph_search": op8_graph_search,
    "op9_simhash": op9_simhash, "op10_language": op10_language, "op11_vector_codes": op11_vector_codes,
    "op12_ranked_search": op12_ranked_search, "op13_url_filter": op13_url_filter}
