"""Edit-aware token counts: a tree of pre-token counts per document, of which edits touch only a part.

The tokenizer is byte-level BPE behind a pattern that cuts a text into pre-tokens; a text's tokens are those of its
pre-tokens, one after the other. A document is kept as leaves of up to ``LEAF`` pre-tokens (their lengths and token
counts) under a binary tree of sums of characters and tokens. An edit (place, characters to delete, text to insert)
goes down the sums to the first pre-token it can reach, cuts anew from there, and stops as soon as a cut falls on an
old one behind the edit: from there on the pattern sees what it saw before. New pre-tokens replace old ones in their
leaves, and the sums on the way up follow. The pattern looks at most one character behind a pre-token's end, so the
boundary context is the pre-token that ends at the edit or one character before it.

``write_trees`` keeps the trees as a table, and ``edited`` applies edits to kept trees: it reads pre-token lengths and counts
instead of making them, so documents without an edit are not encoded at all and others only where an edit reaches.
``counted`` makes the trees and edits them in one pass, without a table between.

Edits of a document apply in order, each to the text that those before left; places beyond the text are its end.
A null text is empty, null edits are none, a null field of an edit counts as 0 or as no text. Repeated rows are counted
each, other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import small_batches, worker_cache

LEAF = 64
_MEMO = 1 << 20
_MEMO_LENGTH = 64


class PreTokens:
    """Cuts texts into pre-tokens and counts their tokens, each distinct one once."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        found = list(map(self.memo.get, parts))
        lacking = [i for i, n in enumerate(found) if n is None]
        if lacking:
            fresh = list(dict.fromkeys(parts[i] for i in lacking))
            made = {}
            for at in range(0, len(fresh), 20000):
                some = fresh[at:at + 20000]
                made.update(zip(some, (len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)),
                                strict=True))
            for i in lacking:
                found[i] = made[parts[i]]
            if len(self.memo) + len(made) > _MEMO:
                self.memo.clear()
            self.memo.update((p, n) for p, n in made.items() if len(p) <= _MEMO_LENGTH)
        return found


def pre_tokens(path: str, pattern: str) -> PreTokens:
    """The counter of a tokenizer file, one in each worker."""
    cache = worker_cache()
    if ("pre-tokens", path) not in cache:
        cache["pre-tokens", path] = PreTokens(path, pattern)
    return cache["pre-tokens", path]


class CountTree:
    """The pre-tokens of one text in leaves, under sums of characters and tokens. ``reencoded`` counts pre-tokens that
    edits had encoded again."""

    def __init__(self, text: str, counter: PreTokens, leaf: int = LEAF, parts: list[str] | None = None,
                 counts: list[int] | None = None):
        self.text, self.counter, self.leaf, self.reencoded = text, counter, leaf, 0
        parts = counter.pattern.findall(text) if parts is None else parts
        self._fill(list(map(len, parts)), counter.counts(parts) if counts is None else counts)

    @classmethod
    def kept(cls, text: str, lengths: bytes, counts: bytes, counter: PreTokens, leaf: int = LEAF) -> CountTree:
        """A tree from what ``packed`` gave: nothing is cut or encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.leaf, tree.reencoded = text, counter, leaf, 0
        tree._fill(np.frombuffer(lengths, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist())
        return tree

    def packed(self) -> tuple[bytes, bytes]:
        """Lengths and token counts of all pre-tokens."""
        return tuple(np.array([x for leaf in self.leaves for x in leaf[i]], "<u4").tobytes() for i in (0, 1))

    def _fill(self, lengths: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lengths) // self.leaf))
        self.leaves = [(lengths[i * self.leaf:(i + 1) * self.leaf], counts[i * self.leaf:(i + 1) * self.leaf]) for i in range(n)]
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its start) of the first pre-token that ends behind ``place``; the end of the last
        leaf if there is none."""
        node, start = 1, 0
        if place >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, len(self.leaves[last][0]), self.chars[1]
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.size
        for i, length in enumerate(self.leaves[leaf][0]):
            if place < start + length:
                return leaf, i, start
            start += length
        raise AssertionError("sums and leaves differ")

    def edit(self, place: int, delete: int, insert: str) -> None:
        """Replaces ``delete`` characters from ``place`` on by ``insert``."""
        place = min(max(0, place), len(self.text))
        end = min(len(self.text), place + max(0, delete))
        if end == place and not insert:
            return
        first, within, start = self.find(max(0, place - 2))
        shift = len(insert) - (end - place)
        self.text = self.text[:place] + insert + self.text[end:]
        # old cuts behind the edit, taken one by one as the new cuts reach them
        leaf, at, old = first, within, start
        fresh: list[str] = []
        cut = start
        settled = False
        for m in self.counter.pattern.finditer(self.text, start):
            while old < end or old + shift < cut:
                leaf, at, old, more = self._next(leaf, at, old)
                if not more:
                    break
            if cut == old + shift and old >= end and cut >= place + len(insert):
                settled = True
                break
            fresh.append(m[0])
            cut = m.end()
        if not settled:  # to the end of the text
            leaf, at = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.reencoded += len(fresh)
        self._replace(first, within, leaf, at, list(map(len, fresh)), self.counter.counts(fresh))

    def _next(self, leaf: int, at: int, old: int) -> tuple[int, int, int, bool]:
        """One old pre-token on."""
        while at >= len(self.leaves[leaf][0]):
            if leaf + 1 == len(self.leaves):
                return leaf, at, old, False
            leaf, at = leaf + 1, 0
        return leaf, at + 1, old + self.leaves[leaf][0][at], True

    def _replace(self, first: int, within: int, last: int, until: int, lengths: list[int], counts: list[int]) -> None:
        head, tail = self.leaves[first], self.leaves[last]
        merged = (head[0][:within] + lengths + tail[0][until:], head[1][:within] + counts + tail[1][until:])
        if len(merged[0]) > 8 * self.leaf:  # a leaf grew out of shape: deal all anew
            before, after = self.leaves[:first], self.leaves[last + 1:]
            self._fill([x for a, _ in before for x in a] + merged[0] + [x for a, _ in after for x in a],
                       [x for _, b in before for x in b] + merged[1] + [x for _, b in after for x in b])
            return
        self.leaves[first] = merged
        for leaf in range(first + 1, last + 1):
            self.leaves[leaf] = ([], [])
        changed = {self.size + leaf for leaf in range(first, last + 1)}
        for node in changed:
            a, b = self.leaves[node - self.size]
            self.chars[node], self.tokens[node] = sum(a), sum(b)
        while changed != {1} and changed:
            changed = {node // 2 for node in changed if node > 1}
            for node in changed:
                self._sum(node)


def trees(texts: list[str], counter: PreTokens, leaf: int = LEAF) -> Iterable[CountTree]:
    """A tree for every text; their pre-tokens are counted together."""
    parts = [counter.pattern.findall(t) for t in texts]
    counts = counter.counts([p for own in parts for p in own])
    at = 0
    for text, own in zip(texts, parts, strict=True):
        yield CountTree(text, counter, leaf, own, counts[at:at + len(own)])
        at += len(own)


def counted(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, n_pretokens, n_reencoded) of every row. ``edits_col`` is
    an array of struct (place, delete, insert) in the order in which they apply."""
    numbers = ("n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded")
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in numbers]])

    def run(batches):
        counter = pre_tokens(tokenizer, pattern)
        for batch in batches:
            out = np.zeros((batch.num_rows, len(numbers)), np.int64)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            every = batch.column("edits").to_pylist()
            for at in range(0, len(texts), 100):
                for n, tree in enumerate(trees(texts[at:at + 100], counter), at):
                    out[n, 0], out[n, 4] = tree.total, sum(len(a) for a, _ in tree.leaves)
                    for e in every[n] or ():
                        if e is not None:
                            tree.edit(e["place"] or 0, e["delete"] or 0, e["insert"] or "")
                            out[n, 1] += 1
                    out[n, 2], out[n, 3], out[n, 5] = tree.total, len(tree.text), tree.reencoded
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(out[:, i]) for i in range(len(numbers))]],
                                             names=schema.names)

    return (small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
            .mapInArrow(run, schema).withColumnRenamed("id", id_col))


_KEPT = ("text string, lengths binary, counts binary, n_tokens long, n_pretokens long")


def kept_trees(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, lengths, counts, n_tokens, n_pretokens) of every row: its tree, and the text that edits need."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string(_KEPT).fields])

    def run(batches):
        counter = pre_tokens(tokenizer, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for at in range(0, len(texts), 100):
                rows += [(t.text, *t.packed(), t.total, sum(len(a) for a, _ in t.leaves)) for t in trees(texts[at:at + 100], counter)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_columns(rows)], names=schema.names)

    return small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _columns(rows: list[tuple], more: int = 0) -> list[pa.Array]:
    kinds = [pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * (2 + more)]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def write_trees(df: DataFrame, path: str, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Keep the trees of all rows in the folder ``path``."""
    kept_trees(df, tokenizer, pattern, id_col, text_col).write.parquet(path)


def edited(kept: DataFrame, edits: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """``kept`` trees (``read.parquet`` of what ``write_trees`` wrote) after the edits (id, edits) of their documents, with
    n_edits and n_reencoded. Trees without edits come back as they are, edits without a tree change nothing, an id with
    several rows of edits gets those of all, in no order between the rows; all rows of a repeated id are edited."""
    names = [f.name for f in T._parse_datatype_string(_KEPT)]
    schema = T.StructType([kept.schema["id"], *T._parse_datatype_string(_KEPT).fields,
                           *[T.StructField(n, T.LongType()) for n in ("n_edits", "n_reencoded")]])

    def run(batches):
        counter = pre_tokens(tokenizer, pattern)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tree = CountTree.kept(r["text"], r["lengths"], r["counts"], counter)
                own = [e for e in r["edits"] if e is not None]
                for e in own:
                    tree.edit(e["place"] or 0, e["delete"] or 0, e["insert"] or "")
                rows.append((tree.text, *tree.packed(), tree.total, sum(len(a) for a, _ in tree.leaves), len(own), tree.reencoded))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_columns(rows, 2)], names=schema.names)

    wanted = (edits.select(F.col(edits.columns[0]).alias("id"), F.col("edits")).where(F.size("edits") > 0)
              .groupBy("id").agg(F.flatten(F.collect_list("edits")).alias("edits")))
    found = small_batches(kept).select("id", *names).join(wanted.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")), "left")
    zero = F.lit(0).cast("bigint")
    return (found.where("edits IS NOT NULL").select("id", *names, "edits").mapInArrow(run, schema)
            .unionAll(found.where("edits IS NULL").select("id", *names, zero, zero)))
