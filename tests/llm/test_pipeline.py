import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from promptveil.llm import language
from promptveil.llm.queries import tokenizer_path
from promptveil.session import written


def test_stages_one_by_one(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
    text = {d: t for d, t, _, _ in documents}
    # each stage keeps of what the one before kept; every document here is in a language
    assert set(kept["language"]) == set(text)
    assert set(kept["near duplicates"]) <= set(kept["language"])
    by_text = Counter(text[d] for d in kept["near duplicates"])
    assert max(by_text.values()) == 1 and set(by_text) == {t for t in text.values()} - {
        t for d, t in text.items() if t not in by_text}
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {d for d in kept["near duplicates"] if any(i in text[d] for i in items)}
    assert leaks and not leaks & set(kept["decontamination"])
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) > 1

    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert Counter(r["doc_id"] for r in rows) == kept["mixing"]
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert r["n_tokens"] == 1 + len(tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, rows))


def test_what_is_no_language_goes(spark, folder, documents):
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s in documents[:80]]
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (1002, "12 34 !!", "en", "a", 8), (1003, "東京都 大阪市 名古屋", "en", "a", 11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.spoken(spark, df, folder).collect()}
    assert kept == {d for d, *_ in documents[:80]}


def test_no_language_learned(spark, folder, documents):
    rows = [(d, t, None, s, len(t)) for d, t, _, s in documents[:20]]
    rows += [(1000, None, None, "a", 0), (1001, "", None, "a", 0), (1002, "12 34 !!", None, "a", 8), (1003, "東京都", None, "a", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.spoken(spark, df, folder)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, *_ in documents[:20]} | {1003}
    one = df.where(language.bucket(F.col("doc_id"), 4) == 2).withColumn("lang", F.lit("en"))  # labels held out only
    clean = one.where("doc_id < 1000")
    assert clean.count() > 0 and corpus_pipeline.spoken(spark, clean, folder).count() == clean.count()


HELPERS = ("score lang_pred found _found own _own mark row n _n of _of rate _rate seed _seed copy _copy id fp root key label item place "
           "start size part data block component_id fingerprint a b node").split()


def test_clashing_columns_and_odd_rows(spark, folder, documents):
    """Columns with the names of helpers pass through unchanged; null and repeated rows are dealt with in every stage."""
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s in documents[:60]]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], None, None, None), (None, rows[7][1], "en", None, 1), (None, None, None, None, None),
             (None, None, None, None, None), (2000, "", None, "a", 0), (2001, rows[8][1] + " and more", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in HELPERS:
        df = df.withColumn(name, F.concat(F.lit(name), F.xxhash64("doc_id", "text").cast("string")))
    docs = written(df, "clash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.columns == df.columns
        for r in docs.select("*", F.xxhash64("doc_id", "text").alias("hash")).collect():
            assert all(r[name] == f"{name}{r['hash']}" for name in HELPERS)
            assert r["text"]
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
