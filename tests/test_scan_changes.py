"""Long texts in pieces, and the hit table that follows changes."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.operators import hit_table, long_texts, scan
from test_scan import brute, table, texts

KEY = T.StructField("id", T.LongType())


@pytest.mark.parametrize("few", [0, scan.FEW])
def test_pieces_give_every_occurrence_once(spark, monkeypatch, few):
    monkeypatch.setattr(scan, "FEW", few)
    pick = random.Random(few)
    patterns = ["ab", "aba", "é", "😀a", "a b", "", "b a aba", "xyz", "AA"]
    values = ["".join(pick.choice("aAb é😀") for _ in range(pick.randrange(400))) for _ in range(30)]
    values += ["", None, "a", "😀" * 40, "xy" + "z" * 50, "a" * 100]
    want = brute([v or "" for v in values], patterns)
    assert len(want) > 1000
    for piece in (1, 8, 61):
        found = long_texts.occurrences(texts(spark, *values), table(spark, patterns), "id", piece=piece)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want, piece


def test_pieces_cover_the_text_and_begin_at_characters(spark):
    value = "aé😀" * 30 + "é"
    rows = texts(spark, value).select(F.inline(long_texts.cut(F.col("text"), 7, 4))).collect()
    data = value.encode()
    assert sum(r["own"] for r in rows) == len(data) and len(rows) == -(-len(data) // 7)
    for r in rows:
        piece = r["body"].encode()
        assert data[r["at"]:r["at"] + len(piece)] == piece and len(piece) <= r["own"] + 4 + 3


def test_a_long_text_is_dealt_over_tasks(spark):
    value = "word evil " * 20_000
    found = long_texts.occurrences(texts(spark, value), table(spark, ["evil word"]), "id", piece=1000)
    assert found.count() == 19_999
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 10_000


def test_no_signature_no_hit(spark):
    assert long_texts.occurrences(texts(spark, "abc"), table(spark, [""]), "id", piece=1).count() == 0
    assert long_texts.occurrences(texts(spark), table(spark, ["a"]), "id", piece=1).count() == 0


def hits(store):
    return sorted(tuple(r) for r in hit_table.read_hits(store, "id").select("id", "sig_id", "first_end").collect())


def whole(spark, held, signatures):
    rows = spark.createDataFrame(list(held.items()), "id bigint, text string")
    return sorted(tuple(r) for r in scan.scan(rows, signatures, "id").select("id", "sig_id", F.col("first_end").cast("bigint")).collect())


def test_updates_equal_a_whole_scan(spark, tmp_path):
    pick = random.Random(3)
    store = hit_table.hit_store(spark, str(tmp_path / "hits"), KEY)
    rows = lambda held: spark.createDataFrame(list(held.items()), "id bigint, text string")
    assert hits(store) == []
    pool = ["aa", "ab", "ba c", "c", "cab", "bb a", "b"]
    held, next_id = {}, 0
    for batch in range(7):
        gone = pick.sample(sorted(held), min(3, len(held)))
        old = {i: t for i, t in held.items() if i not in gone}
        new = {next_id + n: "".join(pick.choice("abc ") for _ in range(pick.randrange(12))) for n in range(4)}
        next_id += 4
        new.update({i: "".join(pick.choice("abc ") for _ in range(8)) for i in gone[:1]})  # changed, not removed
        held_before, held = held, {**old, **new}
        signatures = table(spark, [p if pick.random() < 0.6 else "" for p in pool])  # added, removed, added again
        keys = spark.createDataFrame([(i,) for i in gone], "id bigint")
        assert hit_table.update(store, batch * 2, rows(held_before), rows(new), signatures, "id", gone=keys)
        assert hits(store) == whole(spark, held, signatures), batch
    assert not hit_table.update(store, 12, rows({}), rows({99: "aa"}), table(spark, ["aa"]), "id")
    assert hits(store) == whole(spark, held, signatures)
    with pytest.raises(ValueError):
        hit_table.update(store, 5, rows({}), rows({99: "aa"}), table(spark, ["aa"]), "id")


def test_old_texts_are_read_only_for_added_signatures(spark, tmp_path):
    store = hit_table.hit_store(spark, str(tmp_path / "hits"), KEY)
    hit_table.update(store, 0, texts(spark), texts(spark, "one two", "three"), table(spark, ["one", "two", "three"]), "id")
    broken = texts(spark, "x", "y").select("id", F.raise_error(F.lit("old texts read")).cast("string").alias("text"))
    fewer = table(spark, ["one", "", "three"])
    more = spark.createDataFrame([(7, "one three")], "id bigint, text string")
    assert hit_table.update(store, 1, broken, more, fewer, "id")
    assert hits(store) == [(0, 0, 3), (1, 2, 5), (7, 0, 3), (7, 2, 9)]
    with pytest.raises(Exception, match="old texts read"):
        hit_table.update(store, 2, broken, texts(spark), table(spark, ["one", "four", "three"]), "id")
    assert hits(store) == [(0, 0, 3), (1, 2, 5), (7, 0, 3), (7, 2, 9)]  # the failed update left nothing
