import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptveil.llm import range_coder, token_files
from promptveil.llm.queries import op7_token_files, tokenizer_path
from promptveil.session import run_folder


def plain(rows):
    """{doc_id: [(start, n, crc)]} by encoding every text whole."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_table(spark, folder, documents):
    got = sorted(tuple(r) for r in op7_token_files(spark, folder).collect())
    assert got == plain([(d, t) for d, t, _, _ in documents])


ROWS = [(7, None), (3, ""), (5, " \t\n"), (-2, "<|endoftext|> A <|ENDOFTEXT|>"), (9, "Σας ΟΔΟΣ, a\x1cb \x85c é ́x 'S it's 123 ½ I'LL"),
        (11, "word " * 50000 + "x" * 3000), (12, "Ａ é b　c d İstanbul ﬁ"),
        (13, "end. next, (x) é. a.\u0301 b.’ word...\n A.B. c.\u00a0d it's. l'. 5. ½. x!?\tz$$$"), (14, "a. b.\x0bc.\x1c d,")]


def test_odd_rows_and_blocks(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("part", F.lit(1)).withColumn("data", F.lit(2))
    for parts, block in ((1, 1), (3, 10), (8, 1 << 20)):
        path = run_folder(spark, "tokens")
        token_files.write(df, path, tokenizer_path(), parts=parts, block=block)
        assert [tuple(r) for r in token_files.read_index(spark, path).orderBy("start").collect()] == plain(ROWS)
    ids = token_files.read_ids(spark, path).where("doc_id = -2").head()["ids"]
    assert ids[0] == 49407 and ids[-1] == 2


def test_repeated_and_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a c"), (1, "a c"), (None, None)], "doc_id bigint, text string")
    path = run_folder(spark, "tokens")
    token_files.write(df, path, tokenizer_path(), parts=2)
    got = token_files.read_index(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1] and [r["n_tokens"] for r in got][2:] == [3, 3]
    path = run_folder(spark, "tokens")
    token_files.write(df.where("false"), path, tokenizer_path(), parts=2)
    assert token_files.read_index(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    alphabet = int(rng.integers(2, 50000))
    for n in (1, 2, 63, 64, 500, 20000):
        kinds = (rng.integers(0, alphabet, n), np.minimum(rng.geometric(0.05, n), alphabet) - 1, np.arange(n) % min(7, alphabet),
                 np.full(n, alphabet - 1))
        for ids in kinds:
            for lanes in (1, 3, range_coder.lanes_for(n)):
                if lanes <= n and n <= 500 or lanes > 3:
                    words, per_lane = range_coder.encode(ids, alphabet, lanes)
                    assert np.array_equal(range_coder.decode(words, per_lane, n, alphabet), ids)


def test_contexts_shorten_what_they_predict():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 40000, int(n)) for n in rng.integers(5, 60, 300)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 300, 5000)])
    words, _ = range_coder.encode(ids, 49408, 1000)
    free, _ = range_coder.encode(rng.permutation(ids), 49408, 1000)
    assert len(words) < len(free) / 2


@pytest.mark.parametrize("bits", [2, 20])
def test_frequent_successors_and_shared_slots(monkeypatch, bits):
    monkeypatch.setattr(range_coder, "_SLOT_BITS", bits)  # with few slots most pairs can't be found and are coded by order 0
    rng = np.random.default_rng(bits)
    hot = np.where(rng.random(400_000) < 0.9, 7, rng.integers(0, 3000, 400_000))  # scaled counts after id 7
    for ids in (hot, np.zeros(300_000, np.int64), rng.integers(0, 60, 50_000)):
        words, per_lane = range_coder.encode(ids, 5000, range_coder.lanes_for(len(ids)))
        assert np.array_equal(range_coder.decode(words, per_lane, len(ids), 5000), ids)


def test_shorter_than_order_0_alone():
    """A whole block of the given documents: at least 15 % under the entropy of its ids."""
    import pyarrow.parquet as pq
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    coder, held, size = token_files.WordEncoder(tokenizer_path()), [], 0
    for text in table.column("text").to_pylist():
        held += [*coder.encode([(text or "").encode()]), struct.pack("<I", 2)]
        size += len(held[-2]) // 4 + 1
        if size >= token_files.BLOCK:
            break
    ids = np.frombuffer(b"".join(held), "<u4")
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    words, per_lane = range_coder.encode(ids, coder.alphabet, range_coder.lanes_for(len(ids)))
    assert len(words) * 16 < 0.85 * len(ids) * -(share * np.log2(share)).sum()
    assert np.array_equal(range_coder.decode(words, per_lane, len(ids), coder.alphabet), ids)


def test_damage_is_an_error():
    data = token_files.pack([4, None], [np.array([5, 6], "<u4").tobytes(), np.array([2], "<u4").tobytes()], 10)
    docs, sizes, ids = token_files.unpack(data)
    assert docs == [4, None] and sizes.tolist() == [2, 1] and ids.tolist() == [5, 6, 2]
    for i in range(0, len(data), 3):
        with pytest.raises(ValueError):
            token_files.unpack(data[:i] + bytes([data[i] ^ 1]) + data[i + 1:])
    with pytest.raises(ValueError):
        token_files.unpack(b"")


@pytest.mark.parametrize("alphabet", [300, 65_534, 65_535, 200_000])
def test_pairs_of_any_alphabet(alphabet):
    rng = np.random.default_rng(alphabet)
    walk = (alphabet - 1 - np.cumsum(rng.integers(0, 3, 30_000)) % 250)  # the highest pairs, often again
    for ids in (walk, rng.integers(0, alphabet, 5000)):
        words, lanes = range_coder.encode(ids, alphabet, range_coder.lanes_for(len(ids)))
        assert np.array_equal(range_coder.decode(words, lanes, len(ids), alphabet), ids)


def test_words_in_the_order_of_decoding():
    # lane 0: 1, then 0xFFFF twice, then one beyond its 16 bits, which goes up to the first; lane 1: as it is
    moved = [np.array([1, 5]), np.array([0xFFFF]), np.array([0xFFFF]), np.array([0x10007, 6]), np.zeros(4, np.int64)]
    owners = [np.array([0, 1]), np.array([0]), np.array([0]), np.array([0, 1]), np.array([0, 1, 0, 1])]
    got = range_coder._stream([m.astype(np.uint32) for m in moved], [o.astype(np.uint16) for o in owners], 2)
    assert got.dtype == np.uint16
    # three of each lane, then for every word moved out before the last three the third next of its lane: 0, 1, 0, 0
    assert got.tolist() == [2, 5, 0, 6, 0, 0, 7, 0, 0, 0]


def test_a_block_holds_nothing_for_each_lane():
    ids = np.random.default_rng(3).integers(0, 1000, 64 * 512).astype("<u4")
    data = token_files.pack([1], [ids.tobytes()], 1000)
    words, lanes = range_coder.encode(ids, 1000, range_coder.lanes_for(len(ids)))
    assert lanes == 512 and len(data) == struct.calcsize("<4sIIIQQ") + 16 + 1 + 2 * len(words) + 4
    assert token_files.unpack(data)[2].tolist() == ids.tolist()
