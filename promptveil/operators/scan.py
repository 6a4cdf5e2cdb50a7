"""Dictionary matching: every signature occurrence in a text, ASCII case-insensitive, plain substrings.

Two plans with equal results:

* ``hits_column``: the dictionary is read once (its size checked) and put into the plan, so a scan is a projection:
  no join, no shuffle, no row blow-up, however the texts are distributed.
* ``scan_join``: the dictionary stays a table of any size; texts are matched to it by an equi-join on anchor grams.

Both first look only at *anchors*. Most signatures hold a place where a word starts inside them; the six characters
from there must appear in the text at a word start too, and word starts are few. Signatures without such a place are
looked for directly (first plan) or through all of a text's grams (second plan).
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptveil.functions.text import (
    alternation, ascii_fold, bind, bytes_before, constant_look_up, extract_all, fold_literal)
from promptveil.session import read_bounded, written

ANCHOR = 6
WORD_START_GRAMS = rf"(?s)(?<![A-Za-z0-9])(?=([A-Za-z0-9].{{{ANCHOR - 1}}}))"
INNER_WORD_START = rf"(?s)[^a-z0-9](?=([a-z0-9].{{{ANCHOR - 1}}}))"
# bounds for a dictionary held in the plan
MAX_SIGNATURES = 20_000
MAX_DIRECT = 200
# so few signatures are looked for one by one: quicker than taking anchors from every text
FEW = 32
# found by their first characters at any place, four at least to six, if they have as many; of signatures up to WINDOW
# characters the rest is compared there and then
LEAST_GRAM = 4
WINDOW = 16
# so many short signatures are sent to every task
MAX_BROADCAST = 100_000
HIT = "struct<sig_id:int,pattern:string,name:string>"


@dataclass(frozen=True)
class Dictionary:
    """Signatures small enough for the plan; ``direct`` ones have no usable anchor, ``gated`` ones are looked for only
    in texts that hold one of them."""

    anchored: dict[str, list[dict]]
    direct: list[dict]
    gated: bool = True


def read_dictionary(signatures: DataFrame) -> Dictionary | None:
    """Read a signature table if it is within the bounds, else None (use ``scan_join``)."""
    rows = read_bounded(signatures.select("sig_id", "pattern", "name").where(F.length("pattern") > 0), MAX_SIGNATURES)
    if rows is None:
        return None
    entries, grams = [], defaultdict(int)
    for row in rows:
        pattern = fold_literal(row["pattern"])
        choices = set(re.findall(INNER_WORD_START, pattern))
        for gram in choices:
            grams[gram] += 1
        entries.append(({"sig_id": row["sig_id"], "pattern": pattern, "name": row["name"]}, choices))
    if len(entries) <= FEW:
        return Dictionary({}, [entry for entry, _ in entries], gated=False)
    anchored, direct = defaultdict(list), []
    for entry, choices in entries:
        if choices:  # the gram shared with the fewest other signatures
            anchored[min(choices, key=lambda gram: (grams[gram], gram))].append(entry)
        else:
            direct.append(entry)
    return Dictionary(dict(anchored), direct) if len(direct) <= MAX_DIRECT else None


def usable(signatures: DataFrame) -> Dictionary | DataFrame:
    """The form in which the flows take a signature table: in the plan if it is small enough, else as the table, which
    they join. Both give the same results."""
    dictionary = read_dictionary(signatures)
    return signatures if dictionary is None else dictionary


def counted(rows: DataFrame, text: Column, words: Dictionary | DataFrame, live: Column, key: str, name: str) -> DataFrame:
    """``rows`` with column ``name``, the number of distinct signatures in ``text`` where ``live``, else 0. For a
    signature table ``rows`` is read twice, and only (key, count) rows come back to it."""
    if isinstance(words, Dictionary):
        return rows.withColumn(name, F.coalesce(F.when(live, F.size(hits_column(text, words))), F.lit(0)))
    if not isinstance(words, DataFrame):
        raise TypeError("give a signature set as usable() returns it")
    texts = rows.where(live).select(key, text.alias("text"))
    found = found_counts(texts, words, key, "text").select(key, F.col("n_hits").cast("int").alias(name))
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def candidates_column(text: Column, dictionary: Dictionary) -> Column:
    """Array of the signatures worth verifying in ``text``: a superset of its hits, and empty for most texts."""
    found = []
    if dictionary.anchored:
        signatures_of = constant_look_up(dictionary.anchored, f"array<{HIT}>")
        grams = F.transform(F.array_distinct(extract_all(text, WORD_START_GRAMS, 1)), ascii_fold)
        known = F.filter(F.array_distinct(grams), lambda gram: gram.isin(*dictionary.anchored))
        found.append(F.flatten(F.transform(known, signatures_of)))
    if dictionary.direct:
        entries = F.from_json(F.lit(json.dumps(dictionary.direct)), f"array<{HIT}>")
        if not dictionary.gated:
            return entries
        gate = "(?i)" + alternation(entry["pattern"] for entry in dictionary.direct)
        found.append(F.when(F.rlike(text, F.lit(gate)), entries).otherwise(F.slice(entries, 1, 0)))
    if not found:
        return F.from_json(F.lit("[]"), f"array<{HIT}>")
    return F.coalesce(F.concat(*found), F.from_json(F.lit("[]"), f"array<{HIT}>"))


def hits_column(text: Column, dictionary: Dictionary) -> Column:
    """Distinct signatures in ``text`` as structs (first_end, neg_length, sig_id, name, pattern), in bytes: ordered by
    the end of their first occurrence, longer first at the same end, then by id."""
    def verified(tried: Column) -> Column:
        def located(folded: Column) -> Column:
            def placed(sig: Column) -> Column:
                size = F.octet_length(sig["pattern"])
                return F.struct((bytes_before(folded, sig["pattern"]) + size).alias("first_end"),
                                (-size).alias("neg_length"), sig["sig_id"].alias("sig_id"), sig["name"].alias("name"),
                                sig["pattern"].alias("pattern"))

            present = F.filter(tried, lambda sig: F.contains(folded, sig["pattern"]))
            return F.array_sort(F.transform(present, placed))

        return F.when(F.size(tried) > 0, bind(ascii_fold(text), located)).otherwise(F.array())

    return bind(candidates_column(text, dictionary), verified)


def any_hit(text: Column, dictionary: Dictionary) -> Column:
    def verified(tried: Column) -> Column:
        return (F.size(tried) > 0) & bind(ascii_fold(text), lambda folded: F.exists(
            tried, lambda sig: F.contains(folded, sig["pattern"])))

    return bind(candidates_column(text, dictionary), verified)


def scan(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct hits as rows (key, sig_id, name, pattern, first_end), by whichever plan the dictionary size allows."""
    dictionary = read_dictionary(signatures)
    if dictionary is None:
        return scan_join(texts, signatures, key, text)
    return (texts.select(key, F.inline(hits_column(F.col(text), dictionary)))
            .select(key, "sig_id", "name", "pattern", "first_end"))


def least_shared(entries: DataFrame, choices: str, chosen: str) -> DataFrame:
    """For each row the one of its array ``choices`` that the fewest rows have too, longer first, as column ``chosen``;
    rows without a choice are left out. Entries that begin alike so get different anchors."""
    own = [c for c in entries.columns if c != choices]
    each = entries.select(*own, F.explode(F.array_distinct(choices)).alias(chosen))
    counts = each.groupBy(chosen).agg(F.count("*").alias("sharing__"))
    rank = F.struct("sharing__", -F.length(chosen), chosen)
    return each.join(counts, chosen).groupBy(*own).agg(F.min_by(chosen, rank).alias(chosen))


def scan_join(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same rows for a dictionary of any size."""
    before = bytes_before(F.col("body"), F.col("pattern"))
    return verified_pairs(texts, signatures, key, text).select(
        key, "sig_id", "name", "pattern", (before + F.octet_length("pattern")).alias("first_end"))


def verified_pairs(texts: DataFrame, signatures: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig_id, name, pattern, body) of every text, folded, and signature in it, for a dictionary of any size.

    Only (key, gram) pairs are shuffled, already distinct within a text, and stored once joined. Of the texts only those
    with a candidate are brought together with their pairs. Anchors are broadcast by their number; grams and pairs never,
    as Spark knows no more of their size than that of the files they come from. Hot grams are left to skew-join splitting.
    """
    folded_pattern = ascii_fold(F.col("pattern"))
    known = (signatures.where(F.length("pattern") > 0)
             .select("sig_id", "name", folded_pattern.alias("pattern"))
             .withColumn("choices__", extract_all(F.col("pattern"), INNER_WORD_START, 1)))
    # signatures without an inner word start: their first four characters, or all of a shorter one, anywhere
    anchored = least_shared(known, "choices__", "gram").withColumn("kind", F.lit(0))
    loose = (known.where(F.size("choices__") == 0).drop("choices__")
             .withColumn("kind", F.least(F.char_length("pattern"), F.lit(4)))
             .withColumn("gram", F.substring("pattern", 1, 4)))
    anchors = anchored.unionByName(loose)
    # the kinds in use (at most five values) decide which grams the texts must give
    counts = {row["kind"]: row["count"] for row in anchors.groupBy("kind").count().collect()}
    kinds, few = sorted(counts), sum(counts.values()) <= MAX_BROADCAST
    bodies = texts.select(key, ascii_fold(F.col(text)).alias("body"))
    lists = [F.struct(F.lit(kind).alias("kind"),
                      F.array_distinct(extract_all(F.col("body"), WORD_START_GRAMS if kind == 0
                                                   else rf"(?s)(?=(.{{{kind}}}))", 1)).alias("grams"))
             for kind in kinds]
    if not lists:
        return texts.select(key, *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("sig_id", "name", "pattern")],
                            F.lit("").alias("body")).where(F.lit(False))
    given = bodies.select(key, F.inline(F.array(*lists))).select(key, "kind", F.explode("grams").alias("gram"))
    pairs = written((given if few else given.hint("merge")).join(F.broadcast(anchors) if few else anchors, ["kind", "gram"])
                    .select(key, "sig_id", "name", "pattern"), "scan-pairs")
    candidates = bodies.join(pairs.select(key).distinct(), key, "left_semi")
    return pairs.hint("merge").join(candidates, key).where(F.contains("body", F.col("pattern")))


def windows(gram: int, width: int) -> str:
    """A regex for what begins at each place of a text: ``gram`` characters, and the next ones up to ``width``. Java's search
    also tries the places inside surrogate pairs, at which nothing begins."""
    return rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{gram - 1}}}.{{0,{width - gram}}}))"


def found(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The hits of ``scan`` without their places, (key, sig_id, name); a row may be there several times."""
    if read_dictionary(signatures) is None:
        return found_join(texts, signatures, key, text)
    return scan(texts, signatures, key, text).select(key, "sig_id", "name")


def found_join(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same rows for a dictionary of any size; texts without a key have none.

    Signatures of up to ``WINDOW`` characters need no text brought back: if any must be looked for at every place, the
    texts give the windows there, which are joined on their first characters and hold the rest. Others go through
    ``verified_pairs``. Spark would take the windows for no larger than the texts' files and could broadcast them, so
    the signatures are broadcast by their number, or neither side.
    """
    size = F.char_length("pattern")
    known = signatures.where(F.length("pattern") > 0).select("sig_id", "name", ascii_fold(F.col("pattern")).alias("pattern"))
    free = F.size(extract_all(F.col("pattern"), INNER_WORD_START, 1)) == 0
    gram, width, tiny, few, long = known.agg(
        F.min(F.when(free & (size >= LEAST_GRAM), F.least(size, F.lit(ANCHOR)))), F.max(F.when(size <= WINDOW, size)),
        F.sort_array(F.collect_set(F.when(free & (size < LEAST_GRAM), size))),
        F.count_if(size <= WINDOW) <= MAX_BROADCAST, F.count_if(size > WINDOW) > 0).head()
    # without windows at every place, word starts find the signatures that hold one
    near = size <= WINDOW if gram else size < LEAST_GRAM
    kinds = {kind: kind for kind in tiny} | ({gram: max(gram, width or 0)} if gram else {})
    if not kinds:
        return verified_pairs(texts, known, key, text).select(key, "sig_id", "name")
    short = known.where(near).withColumn("kind", F.when(size < LEAST_GRAM, size).otherwise(F.lit(gram)).cast("int"))
    short = short.withColumn("gram", F.substr("pattern", F.lit(1), F.col("kind")))
    grams = read_bounded(short.select("kind", "gram").distinct(), MAX_SIGNATURES)

    def given_by(kind: int, reach: int) -> Column:
        """The windows of a text, only those of known grams if these are few enough for the plan."""
        all_of = extract_all(F.col("body"), windows(kind, reach), 1)
        if grams is not None:
            wanted = [row["gram"] for row in grams if row["kind"] == kind]
            all_of = F.filter(all_of, lambda w: (w if kind == reach else F.substr(w, F.lit(1), F.lit(kind))).isin(wanted))
        return F.array_distinct(all_of)

    lists = [F.struct(F.lit(kind).alias("kind"), given_by(kind, reach).alias("windows")) for kind, reach in kinds.items()]
    given = (texts.where(F.col(key).isNotNull()).select(key, ascii_fold(F.col(text)).alias("body"))
             .select(key, F.inline(F.array(*lists))).select(key, "kind", F.explode("windows").alias("window"))
             .withColumn("gram", F.substr("window", F.lit(1), F.col("kind"))))
    hits = (given.hint("merge") if not few else given).join(F.broadcast(short) if few else short, ["kind", "gram"])
    hits = hits.where(F.startswith("window", "pattern")).select(key, "sig_id", "name")
    if gram and not long:
        return hits
    return hits.unionByName(verified_pairs(texts, known.where(~near), key, text).select(key, "sig_id", "name"))


def weighed(signatures: DataFrame) -> DataFrame:
    """A signature table for counting, (sig_id, name, pattern): a row stands for all signatures with the same folded pattern,
    ``name`` is their number and ``sig_id`` the smallest of their ids. Ids with several patterns keep rows of their own, so
    that each counts once. A text can hold no more such rows than its length allows, however many signatures there are."""
    known = (signatures.where(F.length("pattern") > 0)
             .select("sig_id", ascii_fold(F.col("pattern")).alias("pattern")).distinct())
    own = Window.partitionBy("sig_id", F.when(F.col("sig_id").isNull(), F.col("pattern")))  # null ids are never counted
    several = F.min("pattern").over(own) < F.max("pattern").over(own)
    return (known.withColumn("apart__", F.when(several, F.col("sig_id"))).groupBy("pattern", "apart__")
            .agg(F.min("sig_id").alias("sig_id"), F.count("sig_id").alias("name")).select("sig_id", "name", "pattern"))


def found_counts(texts: DataFrame, signatures: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_hits) of ``hit_counts`` for a dictionary of any size."""
    found = found_join(texts, weighed(signatures), key, text)
    return found.distinct().groupBy(key).agg(F.sum("name").alias("n_hits"))


def quoted(text: Column) -> Column:
    """A regex that reads ``text`` literally."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def running_sums(sizes: Column) -> Column:
    """The sums up to each entry. In blocks of about the square root of their number: a fold that grows an array copies
    it each time."""
    def folded(some: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(some, begin, lambda done, n: F.struct(
            (done["at"] + n).alias("at"), F.concat(done["sums"], F.array(done["at"] + n)).alias("sums")))

    def shifted(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: b["at"])
        before = F.transform(blocks, lambda _, i: F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0).cast("bigint"),
                                                              lambda total, n: total + n))
        return F.flatten(F.zip_with(blocks, before, lambda b, more: F.transform(b["sums"], lambda n: n + more)))

    width = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), width)).otherwise(F.array().cast("array<int>"))
    return bind(F.transform(starts, lambda at: folded(F.slice(sizes, at, width))), shifted)


def starts_of(body: Column, pattern: Column) -> Column:
    """First bytes of all occurrences of a pattern that is in ``body``. Cutting before each occurrence leaves pieces whose
    running length gives them."""
    ahead = F.concat(F.lit("(?="), quoted(pattern), F.lit(")"))

    def summed(pieces: Column) -> Column:
        sizes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.octet_length)
        # the cut never shows an occurrence at the very beginning
        return running_sums(F.when(F.startswith(body, pattern), F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes))

    return bind(F.split(body, ahead, F.lit(-1)), summed)


def occurrences(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every occurrence, overlaps and repeats included: (key, sig_id, start, end) in bytes, half-open. A projection: a
    text is folded and held once, whatever its number of hits."""
    def placed(body: Column, sig: Column) -> Column:
        size = F.octet_length(sig["pattern"])
        return F.transform(starts_of(body, sig["pattern"]), lambda at: F.struct(
            sig["sig_id"].alias("sig_id"), at.alias("start"), (at + size).alias("end")))

    dictionary = read_dictionary(signatures)
    if dictionary is None:
        found = verified_pairs(texts, signatures, key, text).withColumn("sig__", F.struct("sig_id", "pattern"))
        return found.select(key, F.inline(placed(F.col("body"), F.col("sig__"))))
    found = bind(hits_column(F.col(text), dictionary), lambda hits: F.when(F.size(hits) > 0, bind(
        ascii_fold(F.col(text)), lambda body: F.flatten(F.transform(hits, lambda sig: placed(body, sig))))))
    return texts.select(key, F.inline(found))


def matches(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, names): distinct signature names in first-seen order, for texts with a hit."""
    dictionary = read_dictionary(signatures)
    if dictionary is None:
        order = F.struct("first_end", (-F.octet_length("pattern")).alias("neg_length"), "sig_id", "name")
        found = (scan_join(texts, signatures, key, text).groupBy(key)
                 .agg(F.array_sort(F.collect_list(order)).alias("hits")))
        return found.select(key, F.transform("hits", lambda hit: hit["name"]).alias("names"))
    return per_text(texts, dictionary, key, text, "names", lambda hits: F.transform(hits, lambda hit: hit["name"]))


def hit_counts(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_hits): distinct signature ids per text, for texts with a hit."""
    dictionary = read_dictionary(signatures)
    if dictionary is None:
        return found_counts(texts, signatures, key, text)
    return per_text(texts, dictionary, key, text, "n_hits", lambda hits: F.size(hits).cast("bigint"))


def per_text(texts: DataFrame, dictionary: Dictionary, key: str, text: str, name: str,
             value: Callable[[Column], Column]) -> DataFrame:
    """(key, value of the hits) for texts with a hit. The generator drops the others; a filter on the hits would be
    pushed down and look for them a second time."""
    kept = bind(hits_column(F.col(text), dictionary), lambda hits: F.when(F.size(hits) > 0, F.array(value(hits))))
    return texts.select(key, F.explode(kept).alias(name))


def blocked(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts with at least one hit."""
    dictionary = read_dictionary(signatures)
    if dictionary is None:
        return texts.join(found_join(texts, signatures, key, text).select(key), key, "left_semi")
    return texts.where(any_hit(F.col(text), dictionary))


def clean(texts: DataFrame, signatures: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts without any hit."""
    dictionary = read_dictionary(signatures)
    if dictionary is None:
        return texts.join(found_join(texts, signatures, key, text).select(key), key, "left_anti")
    return texts.where(~any_hit(F.col(text), dictionary))
