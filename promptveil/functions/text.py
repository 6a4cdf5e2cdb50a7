"""Text expressions shared by the operators; all built from Spark SQL functions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_fold(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is used where the text is pure ASCII, as it is much the faster of the two;
    elsewhere it would also fold letters such as the Kelvin sign."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold_literal(text: str) -> str:
    """The same fold for a driver-side string."""
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bytes_before(text: Column, part: Column) -> Column:
    """Bytes of ``text`` before the first ``part``, which it must contain."""
    return F.octet_length(F.call_function("substring_index", text, part, F.lit(1)))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, computed once however often ``body`` uses it.

    Chained ``withColumn`` steps do not give that: when a later filter is pushed below them, each use of a step is
    replaced by the whole step, and a chain of them grows exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# The longer expressions are written as SQL text: they name a step's parts where Column objects would have to be built
# one call at a time.

def sql_text(value: str) -> str:
    """A raw SQL string literal; for regexes and labels, which hold no quotes."""
    if "'" in value:
        raise ValueError("quotes are not allowed here; write them as \\x27 in a regex")
    return f"r'{value}'"


def sql_bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_weave(text: str, pattern: str, hits: str, render: str) -> str:
    """Rebuild ``text`` with each match of ``pattern`` (already extracted as ``hits``, in order) rendered anew, by an
    expression of ``hit``.

    The text is cut once at the matches, so a replacement is never itself searched.
    """
    return (f"array_join(zip_with(split({text}, {sql_text(pattern)}, -1), {hits}, "
            f"(gap, hit) -> concat(gap, coalesce({render}, ''))), '')")


def sql_lookup_table(entries: str) -> str:
    """An array of (key, value) structs as hash buckets for ``sql_look_up``.

    Spark searches arrays and maps from the front, which for a text full of hits would take time with their square;
    with about as many buckets as each then holds entries, it is the power 1.5.
    """
    count = "greatest(cast(ceil(sqrt(size(es))) AS int), 1)"
    return sql_bind(entries, "es", f"transform(sequence(0, {count} - 1), b -> "
                                   f"filter(es, e -> pmod(xxhash64(e.key), {count}) = b))")


def sql_look_up(table: str, key: str) -> str:
    """The value of ``key`` in a lookup table, null when it is not there."""
    bucket = f"{table}[cast(pmod(xxhash64({key}), size({table})) AS int)]"
    return f"get(filter({bucket}, e -> e.key = {key}), 0).value"


def _bucketed(mapping: dict) -> tuple[str, int]:
    """A driver-side dictionary as JSON: an array of small maps, chosen by the key's CRC-32."""
    count = max(1, len(mapping))
    buckets: list[dict] = [{} for _ in range(count)]
    for key, value in mapping.items():
        buckets[zlib.crc32(key.encode()) % count][key] = value
    return json.dumps(buckets).replace("'", "\\u0027"), count


def constant_look_up(mapping: dict, value_type: str) -> Callable[[Column], Column]:
    """Look-up in a dictionary that lives in the plan; null for other keys. Spark searches a map from the front, so a
    large one is kept as many small ones."""
    text, count = _bucketed(mapping)
    table = F.from_json(F.lit(text), f"array<map<string,{value_type}>>")
    return lambda key: F.try_element_at(F.get(table, (F.crc32(key) % count).cast("int")), key)


def sql_constant_look_up(mapping: dict, value_type: str, key: str) -> str:
    text, count = _bucketed(mapping)
    table = f"from_json({sql_text(text)}, 'array<map<string,{value_type}>>')"
    return f"try_element_at(get({table}, cast(crc32({key}) % {count} AS int)), {key})"


def regex_literal(text: str) -> str:
    """``text`` as a regex that both Java and Python read as these exact characters."""
    return "".join(ch if ch.isascii() and ch.isalnum() else f"\\x{{{ord(ch):x}}}" for ch in text)


def alternation(words: Iterable[str]) -> str:
    """A regex for a list of words with shared prefixes written once; the longest word wins at a position."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [regex_literal(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        if "" in node:
            return f"(?:{'|'.join(branches)})?"
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return render(tree)
