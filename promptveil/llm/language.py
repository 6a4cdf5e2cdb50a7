"""Language identification by rank order: the most frequent n-grams of a text against the profile of each language.

N-grams of one to three letters; a word edge counts as a letter. A profile is the list of a language's ``PROFILE`` most
frequent n-grams over all its training texts. The distance of a text to a profile is the mean over the text's most
frequent n-grams of the difference in rank, ``PROFILE`` where the profile lacks the n-gram. The nearest profile wins,
ties go to the language that sorts first.

Text is lower-cased; what is no letter is a word edge. A null text and one without a letter get ``und`` and score 0; so
does every text when nothing was learned. Rows with null language teach nothing; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.llm.common import give_back, small_batches, unused, worker_cache
from promptveil.session import read_bounded

PROFILE = 400
MAX_LANGUAGES = 2000
UNKNOWN = "und"
_EDGE = 32
_BITS = np.uint64(21)
_PIECE = 1 << 20


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; built once in a worker."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return cache["letters"]


def grams_of(text: str) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a text, piece by piece; no code at all when there is no letter."""
    last = np.zeros(0, np.uint64)
    for at in range(0, len(text), _PIECE):
        # surrogates cannot come from UTF-8; a piece ends anywhere, the last two symbols go on into the next
        points = np.frombuffer(text[at:at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_is_letter()[points], points, _EDGE).astype(np.uint64)
        if at == 0:
            points = np.concatenate([[np.uint64(_EDGE)], points])
        if at + _PIECE >= len(text):
            points = np.concatenate([points, [np.uint64(_EDGE)]])
        run = np.concatenate([last, points])
        keep = np.ones(len(run), np.bool_)
        keep[1:] = (run[1:] != _EDGE) | (run[:-1] != _EDGE)
        fresh = np.cumsum(keep)[len(last) - 1] if len(last) else 0
        run = run[keep]
        two = (run[:-1] << _BITS) | run[1:]
        three = (two[:-1] << _BITS) | run[2:]
        middle_free = run[1:-1] != _EDGE
        yield np.concatenate([run[fresh:][run[fresh:] != _EDGE], two[max(0, fresh - 1):],
                              three[max(0, fresh - 2):][middle_free[max(0, fresh - 2):]]])
        last = run[-2:]


def counts_of(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts over some texts."""
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def settle() -> None:
        nonlocal codes, counts
        own, n = np.unique(np.concatenate(waiting), return_counts=True)
        waiting.clear()
        every, back = np.unique(np.concatenate([codes, own]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(every)).astype(np.int64)
        codes = every

    held = 0
    for text in texts:
        for grams in grams_of(text):
            waiting.append(grams)
            held += len(grams)
            if held > 1 << 20:
                settle()
                held = 0
    if waiting:
        settle()
    return codes, counts


def top_grams(text: str, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    parts = list(grams_of(text)) if len(text) <= _PIECE else None
    if parts is None:
        codes, counts = counts_of([text])
    elif parts:
        codes, counts = np.unique(parts[0], return_counts=True)
    else:
        return np.zeros(0, np.uint64)
    if len(codes) > size:  # all that may be among the first, then in order
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def bucket(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def profiles(df: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0): the most frequent n-grams of each language over all rows of ``df``."""
    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                codes, counts = counts_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"])
        give_back()

    counted = (small_batches(df).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
               .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
               .mapInArrow(run, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram",
                                                                              (F.col("rank") - 1).alias("rank"))


class Ranks:
    """The profiles of all languages as one sorted table of codes."""

    def __init__(self, rows, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        codes = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
        self.codes = np.unique(codes)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.ranks[np.searchsorted(self.codes, codes), [at[r["lang"]] for r in rows]] = [r["rank"] for r in rows]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language and 1 minus the mean distance over the worst one."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        own = top_grams(text, self.size)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        mean = far.mean(axis=0)
        best = int(np.argmin(mean))
        return self.langs[best], float(min(1.0, max(0.0, 1.0 - mean[best] / self.size)))


def learned(train: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> Ranks:
    """The profiles, gathered: a table of languages x ``size`` rows. More than ``MAX_LANGUAGES`` languages are an
    error: the column then holds something else."""
    rows = read_bounded(profiles(train, lang_col, text_col, size), MAX_LANGUAGES * size)
    if rows is None:
        raise ValueError(f"{lang_col} holds more than {MAX_LANGUAGES} languages")
    return Ranks(rows, size)


def nearest(ranks: Ranks):
    """A function of a text column: struct(lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def named(texts):
        import pandas as pd
        return pd.DataFrame([ranks.nearest(t) for t in texts], columns=["lang_pred", "score"])

    return named


def identified(df: DataFrame, ranks: Ranks, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, in place of columns of these names; its other columns pass through."""
    [found] = unused(df, "found")
    mine = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    return small_batches(df).withColumn(found, nearest(ranks)(F.col(text_col))).select(
        *[F.col(f"`{c}`") for c in mine], f"{found}.lang_pred", f"{found}.score")


def identify(df: DataFrame, train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    return identified(df, learned(train, lang_col, text_col), text_col)
