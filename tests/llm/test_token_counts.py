import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptveil.llm import token_counts
from promptveil.llm.queries import edits_of, op2_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.pre_tokens(PATH, public_tokenizers.PATTERN)


def after(text, edits):
    for place, delete, insert in edits:
        place = min(max(0, place), len(text))
        text = text[:place] + insert + text[place + max(0, delete):]
    return text


@pytest.mark.parametrize("seed", range(5))
def test_every_edit_equals_a_whole_count(seed, counter, whole):
    rng = random.Random(seed)
    bits = ["a", "Word", " ", "  ", "\n", "\n\n\t", "'s", "'", "'ll", "12", "3", "!?", ".", "é", "東京", "\U0001F600", "́", " don't", "x" * 40,
            "<|endoftext|>", "   "]
    make = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for leaf in (1, 3, 64):
        for _ in range(12):
            text = make(rng.randint(0, 120))
            tree = token_counts.CountTree(text, counter, leaf)
            assert tree.total == whole(text)
            for _ in range(25):
                edit = (rng.randint(-2, len(text) + 3), rng.choice([0, 0, 1, 2, 7, 60]), make(rng.choice([0, 0, 1, 2, 9, 200 if leaf == 3 else 4])))
                text = after(text, [edit])
                tree.edit(*edit)
                assert tree.text == text and tree.total == whole(text)
                lengths = [n for a, _ in tree.leaves for n in a]
                assert lengths == [len(p) for p in counter.pattern.findall(text)]


def test_only_the_neighbourhood_is_encoded_again(counter):
    text = "some plain words of a long text, again and again. " * 2000
    tree = token_counts.CountTree(text, counter)
    for n in range(50):
        tree.edit(997 * n, 3, "new")
    assert tree.reencoded < 50 * 8


def test_table(spark, folder, whole):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text", edits_of(F.col("doc_id"), F.col("text")).alias("e")).collect()
    got = {r["doc_id"]: r for r in op2_token_counts(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows[:120]:
        text = after(r["text"], [(e["place"], e["delete"], e["insert"]) for e in r["e"]])
        own = got[r["doc_id"]]
        assert (own["n_tokens"], own["n_edits"], own["n_tokens_edited"], own["n_chars_edited"]) == (
            whole(r["text"]), 3, whole(text), len(text))


def test_odd_rows(spark, whole):
    edits = "array<struct<place: bigint, delete: bigint, insert: string>>"
    rows = [(1, None, [(0, 0, "ab")]), (2, "", None), (3, "one two", []), (3, "one two", [(99, 1, " three"), None, (None, None, None)]),
            (None, "x" * 100000 + " y" * 50000, [(100000, 10, "z")]), (4, "a", [(0, 1, None)])]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, edits {edits}").withColumn("n_tokens", F.lit("x"))
    got = token_counts.counted(df, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text, own in rows:
        own = [(e[0] or 0, e[1] or 0, e[2] or "") for e in own or [] if e]
        last = after(text or "", own)
        want.append((doc, whole(text or ""), len(own), whole(last), len(last)))
    assert [tuple(r)[:5] for r in got] == want
    assert token_counts.counted(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_kept_trees(spark, whole, tmp_path):
    """Trees written, read and edited, twice over: equal to whole counts, and little is encoded again."""
    edits = "array<struct<place: bigint, delete: bigint, insert: string>>"
    long = "some plain words of a long text, again and again. " * 400
    rows = [(1, long), (2, "one two"), (3, None), (4, "untouched 123"), (5, long[::-1]), (5, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lengths", F.lit("x"))
    token_counts.write_trees(df, str(tmp_path / "0"), PATH, public_tokenizers.PATTERN)
    first = {1: [(500, 3, "new"), (9000, 0, " words")], 2: [(3, 1, "")], 3: [(0, 0, "from nothing")], 5: [(2, 2, "x")], 77: [(0, 0, "none")], None: [(0, 2, "")]}
    second = {1: [(0, 100, "")], 2: [(99, 0, "!")], 4: None, 5: []}
    texts, kept = [(d, t or "") for d, t in rows], spark.read.parquet(str(tmp_path / "0"))
    for n, step in enumerate((first, second), 1):
        table = spark.createDataFrame(list(step.items()), f"doc_id bigint, edits {edits}")
        token_counts.edited(kept, table, PATH, public_tokenizers.PATTERN).write.parquet(str(tmp_path / str(n)))
        kept = spark.read.parquet(str(tmp_path / str(n)))
        texts = [(d, after(t, step.get(d) or [])) for d, t in texts]
        got = kept.collect()
        assert sorted((repr(r["id"]), r["text"], r["n_tokens"], r["n_edits"]) for r in got) == sorted(
            (repr(d), t, whole(t), len(step.get(d) or [])) for d, t in texts)
        assert sum(r["n_reencoded"] for r in got) < 60
    assert token_counts.edited(kept.where("false"), table, PATH, public_tokenizers.PATTERN).count() == 0
