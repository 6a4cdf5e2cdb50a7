import zlib

import numpy as np
from pyspark.sql import functions as F

from promptveil.llm import language
from promptveil.llm.queries import op10_language


def test_held_out_accuracy(spark, folder, documents):
    rows = {r["doc_id"]: r for r in op10_language(spark, folder).collect()}
    assert len(rows) == len(documents)
    held = [(rows[d]["lang_pred"], lang) for d, _, lang, _ in documents if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in documents)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def plain_grams(text):
    marked = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(marked.split()) + " "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i:i + n]
            if gram == " " or (n == 3 and gram[1] == " "):
                continue
            code = 0
            for c in gram:
                code = code << 21 | ord(c)
            out[code] = out.get(code, 0) + 1
    return out


def test_grams_by_pieces(monkeypatch):
    text = "Ab1 été, x\n\n東京 q" * 50
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(language, "_PIECE", size)
        codes, counts = language.counts_of([text])
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == plain_grams(text)
    monkeypatch.setattr(language, "_PIECE", 1 << 20)
    want = [c for c, _ in sorted(plain_grams(text).items(), key=lambda x: (-x[1], x[0]))]
    assert language.top_grams(text, 5).tolist() == want[:5]
    assert language.top_grams(text, 500).tolist() == want


def test_rank_distance_by_hand():
    rows = [{"lang": "b", "gram": 1, "rank": 0}, {"lang": "b", "gram": 2, "rank": 1}, {"lang": "a", "gram": 2, "rank": 0}]
    ranks = language.Ranks(rows, 3)
    assert ranks.langs == ["a", "b"] and ranks.ranks.tolist() == [[-1, 0], [0, 1], [-1, -1]]
    assert np.array_equal(ranks.codes, [1, 2])


def test_odd_rows(spark):
    train = spark.createDataFrame([("aa", "the cat sat on the mat"), ("bb", "der hund und die katze"), (None, "zzz"),
                                   ("aa", None), ("bb", "")], "lang string, text string")
    rows = [(1, None, 9), (2, "", 9), (3, "123 !?", 9), (4, "the mat", 9), (5, "die katze " * 300000, 9), (None, "the cat", 9),
            (4, "the mat", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int").withColumn("_x", F.lit(1))
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(df, train).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb"), (None, "aa"), (4, "aa")]
    nothing = language.identify(df, train.where("false")).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert language.identify(df.where("false"), train).count() == 0


def test_every_row_by_plain_distances(spark, folder, documents):
    """The whole query against n-gram counts, profiles and out-of-place distances by plain loops."""
    totals = {}
    for d, text, lang, _ in documents:
        if zlib.crc32(str(d).encode()) % 4 != 2 and lang is not None and text is not None:
            own = totals.setdefault(lang, {})
            for code, n in plain_grams(text).items():
                own[code] = own.get(code, 0) + n
    first = lambda counts: sorted(counts, key=lambda c: (-counts[c], c))[:language.PROFILE]
    ranks = {lang: {code: n for n, code in enumerate(first(counts))} for lang, counts in totals.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op10_language(spark, folder).collect()}
    for d, text, _, _ in documents:
        own = first(plain_grams(text or ""))
        if not own:
            assert got[d] == ("und", 0.0)
            continue
        far, lang = min((sum(abs(r[c] - n) if c in r else language.PROFILE for n, c in enumerate(own)) / len(own), lang)
                        for lang, r in ranks.items())
        assert got[d][0] == lang and abs(got[d][1] - (1 - far / language.PROFILE)) < 1e-9
