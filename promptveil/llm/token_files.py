"""Token files: documents as token ids in ascending id order, in blocks of the context-mixing range coder.

``write`` deals the documents out by ranges of id, so that every partition is one run of the order, encodes each run in
one pass and writes one file per partition, as rows (part, block, first, n_ids, data). Spark's writer commits them, so a
task that runs twice leaves one file. A block ends at a document's end once it has ``BLOCK`` ids, holds whole
documents, and can be decoded alone. ``data`` is, little-endian:

    "IDC3", u32 alphabet, u32 lanes, u32 documents, u64 ids, u64 words, documents x (i64 id, u64 ids),
    bytes that tell which ids are null, words x u16, u32 CRC-32 of all before

``first`` is the number of ids before the block in its part; the ids of earlier parts come from sums over one row per
part. A null text has the end id alone. Null ids come first. Rows with equal ids are ordered by text hash; equal rows
keep to one partition. Other columns are ignored. A block whose checksum fails is an error, never skipped.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptveil.llm import range_coder
from promptveil.llm.common import give_back, pieces, small_batches, utf8, worker_cache

BLOCK = 1 << 21
_MAGIC = b"IDC3"
_HEAD = "<4sIIIQQ"
_MEMO_WORDS = 400_000
_MEMO_BYTES = 64
_TOGETHER = 8 << 20
_ID = attrgetter("id")
# letters that stay one character each in any composition or case
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
_MARKED = r"([a-z])([.,;:!?%&*#$]+)([ \t-\r]|$)"
# after any of those letters too, where a tokenizer keeps them whole
_MARKED_LATIN = r"([a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17e}])([.,;:!?%&*#$]+)([ \t-\r]|$)"


def _plain_words(settings: dict) -> bool:
    """Whether a tokenizer file does no more to a word of Latin letters than lower-case it and hand its bytes to BPE."""
    normalizer = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
             "behavior": "Removed", "invert": True}
    steps = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
    known = all(t["content"].startswith("<|") for t in settings.get("added_tokens") or [])
    return (known and (settings.get("normalizer") or {}).get("normalizers") == normalizer and len(steps) == 2
            and steps[0] == split and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex", True) and settings["model"].get("type") == "BPE"
            and not settings["model"].get("dropout") and not settings.get("truncation") and not settings.get("padding"))


def _byte_letters() -> str:
    """The letter by which byte-level tokenizers write each byte: printable ones themselves, the others from 256 on. Line
    ends, which are in no word, stay."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letters = [chr(b if b in printable else next(others)) for b in range(256)]
    letters[10] = "\n"
    return "".join(letters)


class WordEncoder:
    """Token ids of whole texts, each word encoded once. For tokenizers that lower-case, drop white space and never join
    across it: a text's ids are then those of its lower-cased runs between ASCII white space, one after the other.
    Arrow splits and tells words apart; known words stay in two generations, so that frequent ones outlive rare ones."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = self.tokenizer.get_vocab_size()
        self.ends_word = np.zeros(self.alphabet, np.bool_)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        with open(path, encoding="utf-8") as file:
            self.plain = _plain_words(json.load(file))
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marked = _MARKED_LATIN if self.plain else _MARKED
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _joined(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of ASCII letters, many in one call, cut where a word ends; nothing where that doesn't add up
        (a tokenizer without word ends)."""
        made = {}
        for at in range(0, len(words), 1000):
            some = words[at:at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids,
                           np.uint32)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist() if len(ids) else []
            if len(ends) == len(some):
                made.update((w, ids[i:j].tobytes()) for w, i, j in zip(some, [0, *ends], ends, strict=False))
        return made

    def _direct(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of Latin letters, by the model alone where all else does nothing to them."""
        plain = [w for w in words if w.isalpha()]  # bytes: ASCII letters only
        latin = [w for w in words if not w.isalpha() and _LATIN.fullmatch(w.decode("utf-8", "replace"))]
        # lower-cased and written in the tokenizer's letters all at once; words hold no line ends
        texts = b"\n".join(plain).lower().decode().split("\n") if plain else []
        if latin:
            lower = b"\n".join(latin).decode().lower().encode()
            texts += codecs.charmap_decode(lower, "strict", self.letters)[0].split("\n")
        made, names = {}, plain + latin
        for at in range(0, len(texts), 1000):
            ids, ends = [], []
            for tokens in map(self.model.tokenize, texts[at:at + 1000]):
                ids += map(_ID, tokens)
                ends.append(4 * len(ids))
            data = np.array(ids, "<u4").tobytes()
            made.update((w, data[i:j]) for w, i, j in zip(names[at:at + 1000], [0, *ends], ends, strict=False))
        return made

    def _single(self, words: list[bytes]) -> dict[bytes, bytes]:
        made = {}
        for at in range(0, len(words), 20000):
            some = words[at:at + 20000]
            made.update((word, np.array(e.ids, np.uint32).tobytes()) for word, e in zip(
                some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some],
                                                       add_special_tokens=False), strict=True))
        return made

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as little-endian 32-bit integers."""
        parts = list(map(self.memo.get, words))
        fresh = []
        for i in [i for i, part in enumerate(parts) if part is None]:
            part = self.older.get(words[i])
            if part is None:
                fresh.append(i)
            else:
                parts[i] = self.memo[words[i]] = part
        if fresh:
            anew = [words[i] for i in fresh]
            # bytes: ASCII letters only
            made = self._direct(anew) if self.plain else self._joined([w for w in anew if w.isalpha()])
            made.update(self._single([w for w in anew if w not in made]))
            for i in fresh:
                parts[i] = made[words[i]]
            self.memo.update(made)
            for w in anew:
                if len(w) > _MEMO_BYTES:
                    del self.memo[w]
        if len(self.memo) > _MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        return parts

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        rows: list[bytes] = []
        owners: list[int] = []
        held = 0

        def settle() -> None:
            nonlocal held
            for n, ids in zip(owners, self._batch(rows), strict=True):
                out[n].append(ids)
            rows.clear()
            owners.clear()
            held = 0

        for n, text in enumerate(texts):
            for piece in pieces(text):
                rows.append(piece)
                owners.append(n)
                held += len(piece)
                if held > 1 << 23:
                    settle()
        settle()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _batch(self, rows: list[bytes]) -> list[bytes]:
        if any(b"<|" in row for row in rows):  # case counts in special tokens
            return [b"".join(map(dict(zip(u := list(dict.fromkeys(w)), self.ids_of(u), strict=True)).get, w))
                    for w in ((row if b"<|" in row else row.lower()).split() for row in rows)]
        lower = pc.ascii_lower(pa.array(rows, pa.binary()).cast(pa.string()))
        # marks after a word are a token of their own: set apart, they leave fewer distinct words
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, self.marked, r"\1 \2\3"))
        coded = split.flatten().dictionary_encode()
        parts = self.ids_of(_values(coded.dictionary))
        held = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4, out=held[1:])
        every = pa.LargeListArray.from_arrays(held, np.frombuffer(b"".join(parts), "<u4")).take(coded.indices)
        data = every.flatten().to_numpy().tobytes()
        at = ((every.offsets.to_numpy() - every.offsets[0].as_py())[
            split.offsets.to_numpy() - split.offsets[0].as_py()] * 4).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _values(words: pa.Array) -> list[bytes]:
    """All values of a string array, cut from one copy of its data."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else []
    held = data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in zip(at, at[1:], strict=False)]


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, one in each worker."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = WordEncoder(path)
    return cache["encoder", path]


def pack(doc_ids: list[int | None], ids: list[bytes], alphabet: int) -> bytes:
    """One block."""
    every = np.frombuffer(b"".join(ids), "<u4")
    lanes = range_coder.lanes_for(len(every))
    words, lanes = range_coder.encode(every, alphabet, lanes)
    docs = np.empty((len(doc_ids), 2), "<i8")
    docs[:, 0] = [0 if d is None else d for d in doc_ids]
    docs[:, 1] = [len(x) // 4 for x in ids]
    body = b"".join([struct.pack(_HEAD, _MAGIC, alphabet, lanes, len(doc_ids), len(every), len(words)), docs.tobytes(),
                     np.array([d is None for d in doc_ids], np.uint8).tobytes(), words.astype("<u2").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, all ids."""
    if len(data) < struct.calcsize(_HEAD) + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block of a token file is damaged")
    magic, alphabet, lanes, n_docs, n_ids, n_words = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a block of a token file")
    at = struct.calcsize(_HEAD)
    docs = np.frombuffer(data, "<i8", 2 * n_docs, at).reshape(-1, 2)
    at += docs.nbytes
    null = np.frombuffer(data, np.uint8, n_docs, at)
    at += n_docs
    words = np.frombuffer(data, "<u2", n_words, at)
    ids = range_coder.decode(words, lanes, n_ids, alphabet)
    return [None if gone else int(d) for d, gone in zip(docs[:, 0], null, strict=True)], docs[:, 1], ids


def _blocks(rows: Iterable[tuple[int | None, bytes]], alphabet: int, block: int) -> Iterator[tuple[int, int, bytes]]:
    """(ids before, ids in it, data) of each block of (document id, ids) rows."""
    docs: list[int | None] = []
    held: list[bytes] = []
    size = before = 0
    for doc, ids in rows:
        docs.append(doc)
        held.append(ids)
        size += len(ids) // 4
        if size >= block:
            yield before, size, pack(docs, held, alphabet)
            before += size
            docs, held, size = [], [], 0
    if docs:
        yield before, size, pack(docs, held, alphabet)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
          parts: int | None = None, block: int = BLOCK) -> None:
    """Writes the token files of ``df`` to the folder ``path``; ``tokenizer`` is a file that executors can read."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder = encoder(tokenizer)

        def rows():
            # several batches at a time: the more text, the fewer distinct words for each of its words
            ids_of, texts, held = [], [], 0
            for batch in batches:
                ids_of += batch.column("id").to_pylist()
                texts += utf8(batch.column("text"))
                held += batch.column("text").nbytes
                if held > _TOGETHER:
                    yield from zip(ids_of, (ids + end for ids in coder.encode(texts)), strict=True)
                    ids_of, texts, held = [], [], 0
            yield from zip(ids_of, (ids + end for ids in coder.encode(texts)), strict=True)

        part = TaskContext.get().partitionId()
        for n, (first, size, data) in enumerate(_blocks(rows(), max(coder.alphabet, end_id + 1), block)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()),
                                              pa.array([first]), pa.array([size]), pa.array([data], pa.binary())],
                                             names=["part", "block", "first", "n_ids", "data"])
        give_back()

    dealt = (small_batches(df).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
             .repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("text"))
             .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text")))
    (dealt.mapInArrow(run, "part int, block int, first long, n_ids long, data binary")
     .write.option("compression", "uncompressed").parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the number of ids before each in all files."""
    blocks = spark.read.schema("part int, block int, first long, n_ids long, data binary").parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one row per file of the write: small whatever the documents, and the blocks stay where they are
    return blocks.join(F.broadcast(starts), "part").select((F.col("before") + F.col("first")).alias("start"), "data")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of token files with all their ids."""
    def run(batches):
        for start, doc, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([start]),
                                              pa.array([ids.tolist()], pa.list_(pa.int32()))],
                                             names=["doc_id", "start", "ids"])

    return small_batches(_stored(spark, path)).mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded ids."""
    def run(batches):
        docs, starts, sizes, sums = [], [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                                              pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
            for x in (docs, starts, sizes, sums):
                x.clear()
            return out

        for start, doc, ids in _documents(batches):
            docs.append(doc)
            starts.append(start)
            sizes.append(len(ids))
            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            if len(docs) >= 10_000:
                yield flush()
        yield flush()
        give_back()

    return small_batches(_stored(spark, path)).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(batches) -> Iterator[tuple[int, int | None, np.ndarray]]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
            docs, sizes, ids = unpack(data.as_py())
            at = 0
            for doc, size in zip(docs, sizes.tolist(), strict=True):
                yield start + at, doc, ids[at:at + size]
                at += size
