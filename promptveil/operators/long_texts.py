"""Occurrences in texts of any length: a long text is cut into overlapping pieces, which are scanned apart.

A text is one row, so however long it is, one task scans it. Here a text of more than ``piece`` bytes becomes pieces that
begin at characters, each with as many bytes of its successor as the longest signature may reach into it. An occurrence
belongs to the piece in which it begins. Cutting works on bytes, so its cost is linear in the text, and byte offsets of
the whole text are those of the piece moved on. Pieces are dealt anew; short texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.functions.text import bind
from promptveil.operators import scan

PIECE = 1 << 20
# bytes after a place that only continue a character there: up to three, written as hex digits
_CONTINUED = "^((?:[89AB][0-9A-F]){0,3})"


def _at_character(body: Column, place: Column) -> Column:
    """``place``, a number of bytes, moved on to where a character of the binary ``body`` begins."""
    ahead = F.regexp_extract(F.hex(F.substring(body, place + 1, F.lit(3))), _CONTINUED, 1)
    return (place + F.length(ahead) / 2).cast("int")


def cut(text: Column, piece: int, overlap: int) -> Column:
    """Array of structs (at, own, body): the pieces of ``text``, the byte they begin at, the bytes of their own."""
    def pieces(body: Column) -> Column:
        total = F.octet_length(body)
        last = F.greatest(F.ceil(total / piece).cast("int") - 1, F.lit(0))
        # a text of so few bytes beyond a cut that they all continue a character leaves an empty piece, which holds nothing
        starts = F.transform(F.sequence(F.lit(0), last), lambda n: _at_character(body, n * piece))

        def placed(at: Column) -> Column:
            def one(start: Column, n: Column) -> Column:
                own = F.coalesce(F.get(at, n + 1), total) - start
                end = _at_character(body, F.least(start + own + overlap, total))
                return F.struct(start.alias("at"), own.alias("own"),
                                F.substring(body, start + 1, end - start).cast("string").alias("body"))

            return F.transform(at, one)

        return bind(starts, placed)

    return bind(text.cast("binary"), pieces)


def occurrences(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text", piece: int = PIECE) -> DataFrame:
    """The rows of ``scan.occurrences``: (key, sig_id, start, end) in bytes of the whole text, half-open, every one once.
    Null and empty texts have none; rows that share a key each give theirs. ``piece`` is raised to the longest signature."""
    longest = signatures.agg(F.max(F.octet_length("pattern"))).head()[0]
    if not longest:
        return scan.occurrences(texts, signatures, key, text)
    piece = max(piece, longest)
    long = F.coalesce(F.octet_length(text) > piece, F.lit(False))
    pieces = (texts.where(long).select(F.col(key).alias("of"), F.inline(cut(F.col(text), piece, longest - 1)))
              .select(F.struct("of", "at", "own").alias(key), F.col("body").alias(text)).repartition(key))
    found = scan.occurrences(pieces, signatures, key, text).where(F.col("start") < F.col(f"{key}.own")).select(
        F.col(f"{key}.of").alias(key), "sig_id", (F.col("start") + F.col(f"{key}.at")).alias("start"),
        (F.col("end") + F.col(f"{key}.at")).alias("end"))
    return scan.occurrences(texts.where(~long), signatures, key, text).unionByName(found)
