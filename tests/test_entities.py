import pandas as pd
from pyspark.sql import functions as F

from promptveil.operators import entities, scan
from promptveil.schemas import VAULT_ENTRY

NAMES = [("Ann", "PERSON"), ("Ann Lee", "PERSON"), ("Paris", "GPE"), ("O'Neil & Co", "ORG"), ("email", "ORG"),
         ("Rhône", "LOC"), ("skip", "DATE"), ("EMAIL_1", "ORG"), ("&&", "ORG")]
TEXTS = [["Ann met ANN in Paris", "paris, Ann Lee and Annette saw [EMAIL_1] on the Rhône; Ann Leeds"],
         ["no one"], ["O'Neil & Co && email"]]


def setup(spark):
    names = spark.createDataFrame(NAMES, "name string, label string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, texts array<string>")
    return names, rows


NO_VAULT = f"cast(array() AS array<{VAULT_ENTRY}>)"


def test_numbering_runs_back_to_front(spark):
    names, rows = setup(spark)
    done = rows.select("id", entities.gazetteer_scrubbed(entities.read_gazetteer(names), "texts", NO_VAULT).alias("d"))
    got = {r["id"]: (r["d"]["texts"], {(e["label"], e["idx"], e["original"]) for e in r["d"]["vault"]})
           for r in done.collect()}
    assert got[1] == (["no one"], set())
    texts, vault = got[0]
    # message 0: ANN, then Ann; message 1: Ann again (before Leeds), Rhône, Ann Lee, paris
    assert texts[0] == "[PERSON_2] met [PERSON_1] in [GPE_1]"
    assert texts[1] == "[GPE_2], [PERSON_3] and Annette saw [EMAIL_1] on the [LOC_1]; [PERSON_2] Leeds"
    assert vault == {("PERSON", 1, "ANN"), ("PERSON", 2, "Ann"), ("PERSON", 3, "Ann Lee"), ("GPE", 1, "Paris"),
                     ("GPE", 2, "paris"), ("LOC", 1, "Rhône")}
    assert got[2][0] == ["[ORG_3] [ORG_2] [ORG_1]"]


def test_all_span_routes_agree(spark):
    names, rows = setup(spark)
    lexicon = entities.read_gazetteer(names)
    flat = rows.select("id", F.posexplode("texts").alias("msg_idx", "text")) \
        .withColumn("key", F.concat_ws(":", "id", "msg_idx"))
    direct = flat.select("key", F.inline(entities.gazetteer_spans(F.col("text"), lexicon)))
    joined = entities.joined_spans(flat, names, "key")
    assert {tuple(r) for r in direct.collect()} == {tuple(r) for r in joined.collect()}
    spans = flat.select(F.col("id"), "msg_idx", F.inline(entities.gazetteer_spans(F.col("text"), lexicon)))
    gathered = rows.join(entities.gather_spans(spans, "id"), "id", "left")
    by_table = gathered.select("id", entities.span_scrubbed(
        f"coalesce(spans, cast(array() AS array<array<{entities.SPAN}>>))", "texts", NO_VAULT).alias("d"))
    by_regex = rows.select("id", entities.gazetteer_scrubbed(lexicon, "texts", NO_VAULT).alias("d"))
    assert {(r["id"], str(r["d"])) for r in by_table.collect()} == {(r["id"], str(r["d"])) for r in by_regex.collect()}


def test_model_spans_and_unwanted_labels(spark):
    def load():
        return lambda texts: [[(0, 3, "PERSON"), (4, 7, "DATE")] if t.startswith("Bob") else [] for t in texts]

    rows = spark.createDataFrame([("r", 0, "Bob May Bob"), ("r", 1, "x")], "request_id string, msg_idx int, content string")
    spans = entities.model_spans(rows, load)
    assert isinstance(spans.toPandas(), pd.DataFrame) and spans.count() == 2
    request = spark.createDataFrame([("r", ["Bob May Bob", "x"])], "request_id string, texts array<string>")
    done = request.join(entities.gather_spans(spans), "request_id", "left").select(
        entities.span_scrubbed("spans", "texts", NO_VAULT).alias("d")).first()["d"]
    assert done["texts"] == ["[PERSON_1] May Bob", "x"] and len(done["vault"]) == 1


def test_large_lists_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(entities, "MAX_NAMES", 2)
    assert entities.read_gazetteer(setup(spark)[0]) is None


def test_many_names_in_one_text(spark):
    """Forty thousand names in one text, in seconds."""
    import time
    words = [f"name{i:05d}" for i in range(40_000)]
    row = spark.createDataFrame([(" ".join(words),), ("",), ("none",)], "text string")
    names = entities.Gazetteer({f"name{i:05d}": "PERSON" for i in range(0, 40_000, 4)})
    began = time.time()
    found = row.select(F.size(entities.gazetteer_spans(F.col("text"), names)).alias("n"),
                       F.get(entities.gazetteer_spans(F.col("text"), names), F.lit(9999)).alias("last")).collect()
    assert [r["n"] for r in found] == [10_000, 0, 0]
    assert (found[0]["last"]["start"], found[0]["last"]["end"]) == (39_996 * 10, 39_996 * 10 + 9)
    assert time.time() - began < 60


def test_names_that_begin_alike_get_anchors_of_their_own(spark):
    names = spark.createDataFrame([("the old man", "PERSON"), ("the sea", "LOC"), ("the", "ORG"), ("the new sea", "GPE")],
                                  "name string, label string")
    words = scan.least_shared(names.select("name", F.split("name", " ").alias("w")), "w", "word")
    assert {r["name"]: r["word"] for r in words.collect()} == {"the old man": "man", "the sea": "sea", "the": "the",
                                                               "the new sea": "new"}
    rows = spark.createDataFrame([(1, "The old man and the SEA; the new sea."), (2, "old man, sea"), (3, None)], "id int, text string")
    found = {(r["id"], r["start"], r["end"], r["label"]) for r in entities.joined_spans(rows, names, "id").collect()}
    assert found == {(1, 0, 11, "PERSON"), (1, 16, 23, "LOC"), (1, 25, 36, "GPE")}
