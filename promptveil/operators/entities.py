"""Names of people, places and organisations, replaced by placeholders that share the request's numbering.

Where the names stand comes from a gazetteer (matched here, row by row) or from any span table, such as a model's
output. Both follow one numbering rule: messages in order, and within a message from the last name to the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.functions.patterns import PLACEHOLDER, WORD
from promptveil.functions.text import (
    UPPER, alternation, ascii_fold, bind, constant_look_up, extract_all, sql_bind, sql_constant_look_up, sql_look_up,
    sql_lookup_table, sql_text, sql_weave)
from promptveil.operators import scan
from promptveil.operators.redact import vault_entries
from promptveil.session import read_bounded, worker_cache
from promptveil.settings import ENTITY_LABELS

MAX_NAMES = 20_000
SPAN = "struct<start:int,end:int,label:string>"
WIDE_SPAN = "struct<start:bigint,end:bigint,label:string>"


@dataclass(frozen=True)
class Gazetteer:
    """A name list small enough for the plan: folded name -> label, and its regex."""

    labels: dict[str, str]

    @property
    def regex(self) -> str:
        """Placeholders first, so that a name is never taken out of one; then the longest name, as whole words."""
        if not self.labels:
            return PLACEHOLDER
        return f"{PLACEHOLDER}|(?i:(?<![{WORD}])(?:{alternation(self.labels)})(?![{WORD}]))"


def wanted_names(names: DataFrame, labels: Iterable[str] = ENTITY_LABELS) -> DataFrame:
    """(name, label) with folded names, each once: of several labels the first by (name, label) as written."""
    kept = names.where(F.col("label").isin(*labels) & (F.length("name") > 0))
    return (kept.groupBy(ascii_fold(F.col("name")).alias("folded"))
            .agg(F.min(F.struct("name", "label")).alias("first"))
            .select(F.col("folded").alias("name"), F.col("first.label").alias("label")))


def read_gazetteer(names: DataFrame, labels: Iterable[str] = ENTITY_LABELS) -> Gazetteer | None:
    """Read a (name, label) table if it is small enough, else None: then use ``joined_spans``."""
    rows = read_bounded(wanted_names(names, labels), MAX_NAMES)
    return None if rows is None else Gazetteer({row["name"]: row["label"] for row in rows})


def usable(names: DataFrame, labels: Iterable[str] = ENTITY_LABELS) -> Gazetteer | DataFrame:
    """The form in which the flow takes a name list: in the plan if it is small enough, else as the table, joined."""
    gazetteer = read_gazetteer(names, labels)
    return names if gazetteer is None else gazetteer


def joined_scrubbed(rows: DataFrame, names: DataFrame, scrubbed: str, key: str = "request_id",
                    labels: Iterable[str] = ENTITY_LABELS) -> DataFrame:
    """``rows`` with the names of a list of any size replaced in struct column ``scrubbed`` (texts, vault; null stays
    null), as ``gazetteer_scrubbed`` does: texts go out by (key, message), spans come back by key."""
    texts = (rows.select(key, F.posexplode(f"{scrubbed}.texts").alias("msg_idx", "text"))
             .select(F.struct(key, "msg_idx").alias("at__"), "text"))
    spans = joined_spans(texts, names, "at__", labels)
    listed = gather_spans(spans.select(F.col(f"at__.{key}").alias(key), F.col("at__.msg_idx").alias("msg_idx"),
                                       F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                                       "label"), key)
    done = span_scrubbed("spans__", f"{scrubbed}.texts", f"{scrubbed}.vault", labels)
    joined = rows.join(listed.withColumnRenamed("spans", "spans__"), key, "left")
    return joined.withColumn(scrubbed, F.when(F.col("spans__").isNotNull(), done).otherwise(F.col(scrubbed))).drop("spans__")


def joined_spans(texts: DataFrame, names: DataFrame, key: str, labels: Iterable[str] = ENTITY_LABELS,
                 text: str = "text") -> DataFrame:
    """Span rows (key, start, end, label) for a name list of any size; equal to ``gazetteer_spans``.

    A name stands between word boundaries, so each word in it is a whole word of the text as well: the join on the word
    that the fewest names share gives each text the few names it may hold, and each text is then cut once by a regex of just these.
    """
    known = wanted_names(names, labels).select(F.col("name").alias("pattern"), "label")
    bodies = texts.select(key, ascii_fold(F.col(text)).alias("body"))
    own_words = extract_all(F.col("pattern"), f"[{WORD}]+")
    worded = scan.least_shared(known.withColumn("choices__", own_words), "choices__", "word")
    words = bodies.select(key, F.explode(F.array_distinct(extract_all(F.col("body"), f"[{WORD}]+"))).alias("word"))
    pairs = words.join(worded, "word").select(key, "pattern", "label")
    # names without any word character go through the dictionary scan
    bare = known.where(F.size(own_words) == 0).withColumn("sig_id", F.lit(0)).withColumn("name", F.col("pattern"))
    bare_hits = scan.scan_join(texts, bare, key, text).select(key, "pattern")
    pairs = pairs.unionByName(bare_hits.join(bare.select("pattern", "label"), "pattern").select(key, "pattern", "label"))
    entry = F.struct((-F.char_length("pattern")).alias("neg_length"), "pattern", "label")
    per_text = pairs.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("tried")).join(
        texts.select(key, text), key)
    longest_first = F.array_join(F.transform("tried", lambda t: scan.quoted(t["pattern"])), "|")
    regex = F.concat(F.lit(f"{PLACEHOLDER}|(?i:(?<![{WORD}])(?:"), longest_first, F.lit(f")(?![{WORD}]))"))

    def label_of(hit: Column) -> Column:
        return F.get(F.filter("tried", lambda t: t["pattern"] == ascii_fold(hit)), F.lit(0))["label"]

    spans = located(F.col(text), regex, label_of)
    return per_text.select(key, F.inline(F.filter(spans, lambda s: s["label"].isNotNull())))


def located(text: Column, pattern: Column, label_of: Callable[[Column], Column]) -> Column:
    """Spans of all matches of ``pattern``, in characters."""
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1))
    pieces = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))

    # Running sums in blocks of about the square root of their number: a fold that grows an array copies it each time.
    def blocked(every: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(every))).cast("int")
        starts = F.when(F.size(every) > 0, F.sequence(F.lit(1), F.size(every), F.greatest(width, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        return bind(F.transform(starts, lambda at: placed(F.slice(every, at, width))), shifted)

    def shifted(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: b["at"])
        before = F.transform(blocks, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("bigint"),
                                                              lambda total, n: total + n))
        return F.flatten(F.zip_with(blocks, before, lambda b, offset: F.transform(b["spans"], lambda s: F.struct(
            (s["start"] + offset).alias("start"), (s["end"] + offset).alias("end"), s["label"].alias("label")))))

    def add(done: Column, piece: Column) -> Column:
        start = done["at"] + piece["gap"]
        end = start + F.coalesce(F.char_length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), label_of(piece["hit"]).alias("label"))
        found = F.when(piece["hit"].isNull(), done["spans"]).otherwise(F.concat(done["spans"], F.array(span)))
        return F.struct(end.alias("at"), found.alias("spans"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{WIDE_SPAN}>").alias("spans"))

    def placed(some: Column) -> Column:
        return F.aggregate(some, begin, add)

    return bind(pieces, blocked)


def gazetteer_spans(text: Column, gazetteer: Gazetteer) -> Column:
    """Spans (start, end, label) in characters, in text order."""
    label_of = constant_look_up(gazetteer.labels, "string")
    spans = located(text, F.lit(gazetteer.regex), lambda hit: label_of(ascii_fold(hit)))
    return F.filter(spans, lambda s: s["label"].isNotNull())


def gazetteer_scrubbed(gazetteer: Gazetteer, texts: str = "texts", vault: str = "vault",
                       labels: Iterable[str] = ENTITY_LABELS) -> Column:
    """Struct (texts, vault) with the names in the SQL expression ``texts`` replaced: one cut and rejoin per text."""
    folded = f"CASE WHEN octet_length(h) = char_length(h) THEN lower(h) ELSE translate(h, '{UPPER}', '{UPPER.lower()}') END"
    label = sql_bind(folded, "f", sql_constant_look_up(gazetteer.labels, "string", "f"))
    regex = sql_text(gazetteer.regex)
    found = sql_bind(f"struct({texts} AS texts, {vault} AS vault)", "s",
                     f"struct(s.texts AS texts, s.vault AS vault, "
                     f"transform(s.texts, t -> regexp_extract_all(t, {regex}, 0)) AS hits)")
    # (label, value) pairs in numbering order; placeholders among the hits have no label
    pairs = _distinct_pairs(f"filter(transform(flatten(transform(s.hits, h -> reverse(h))), h -> "
                            f"struct({label} AS label, h AS value)), p -> p.label IS NOT NULL)")
    paired = sql_bind(found, "s", f"struct(s.texts AS texts, s.vault AS vault, s.hits AS hits, {pairs} AS pairs)")
    entered = sql_bind(paired, "s", f"struct(s.texts AS texts, s.vault AS vault, s.hits AS hits, "
                                    f"{_entries('s.pairs', labels)} AS entries)")
    names = sql_lookup_table("transform(s.entries, e -> struct(e.original AS key, e.placeholder AS value))")
    woven = sql_weave("t", gazetteer.regex, "h", f"coalesce({sql_look_up('names', 'hit')}, hit)")
    renamed = sql_bind(names, "names", f"zip_with(s.texts, s.hits, (t, h) -> {woven})")
    return F.expr(sql_bind(entered, "s", f"struct(CASE WHEN size(s.entries) = 0 THEN s.texts ELSE {renamed} END "
                                         "AS texts, concat(s.vault, s.entries) AS vault)"))


def _distinct_pairs(pairs: str) -> str:
    """(label, value) pairs (SQL), each once. As strings, which are told apart by hash; structs are compared in pairs.
    Labels hold no colon."""
    return (f"transform(array_distinct(transform({pairs}, p -> concat(p.label, ':', p.value))), k -> "
            "struct(substring_index(k, ':', 1) AS label, substr(k, length(substring_index(k, ':', 1)) + 2) AS value))")


def _entries(pairs: str, labels: Iterable[str]) -> str:
    """Vault entries (SQL) for (label, value) pairs in numbering order, label by label."""
    return "concat(" + ", ".join(
        vault_entries(label, f"transform(filter({pairs}, p -> p.label = {sql_text(label)}), p -> p.value)")
        for label in labels) + ")"


def span_scrubbed(spans: str = "spans", texts: str = "texts", vault: str = "vault",
                  labels: Iterable[str] = ENTITY_LABELS) -> Column:
    """Struct (texts, vault) for spans given as one array of (start, end, label) per text, in characters."""
    wanted = ", ".join(sql_text(label) for label in labels)
    backwards = (f"reverse(array_sort(filter(coalesce(f, cast(array() AS array<{SPAN}>)), "
                 f"x -> x.label IN ({wanted}))))")
    valued = (f"transform({backwards}, x -> struct(x.start AS start, x.end AS end, x.label AS label, "
              "substring(t, x.start + 1, x.end - x.start) AS value))")
    found = sql_bind(f"struct({texts} AS texts, {vault} AS vault, {spans} AS spans)", "s",
                     f"struct(s.texts AS texts, s.vault AS vault, zip_with(s.texts, slice(s.spans, 1, size(s.texts)), "
                     f"(t, f) -> {valued}) AS spans)")
    pairs = _distinct_pairs("transform(flatten(s.spans), x -> struct(x.label AS label, x.value AS value))")
    entered = sql_bind(found, "s", f"struct(s.texts AS texts, s.vault AS vault, s.spans AS spans, "
                                   f"{_entries(pairs, labels)} AS entries)")
    names = sql_lookup_table("transform(s.entries, e -> struct(struct(e.label, e.original) AS key, "
                             "e.placeholder AS value))")
    put = (f"(t, x) -> concat(substring(t, 1, x.start), "
           f"{sql_look_up('names', 'struct(x.label, x.value)')}, substring(t, x.end + 1, char_length(t)))")
    renamed = sql_bind(names, "names", f"zip_with(s.texts, s.spans, (t, f) -> aggregate(f, t, {put}))")
    return F.expr(sql_bind(entered, "s", f"struct({renamed} AS texts, concat(s.vault, s.entries) AS vault)"))


def gather_spans(spans: DataFrame, key: str = "request_id") -> DataFrame:
    """A span table (key, msg_idx, start, end, label) as one row per request: ``spans``, an array per message.

    Spans lie in a request's own text, which is one row, so a request's spans fit one as well.
    """
    entry = F.struct("msg_idx", F.struct("start", "end", "label").alias("span"))
    listed = spans.groupBy(key).agg(F.collect_list(entry).alias("found"))
    highest = F.array_max(F.transform("found", lambda x: x["msg_idx"]))
    return listed.select(key, F.transform(F.sequence(F.lit(0), highest.cast("int")), lambda i: F.transform(
        F.filter("found", lambda x: x["msg_idx"] == i), lambda x: x["span"])).alias("spans"))


def model_spans(messages: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple]]]],
                key: str = "request_id") -> DataFrame:
    """A span table from a user's model. ``load`` runs once per worker and returns a function from texts to lists of
    (start, end, label); ``messages`` holds (key, msg_idx, content) with the pattern-scrubbed contents."""
    kind, mark = dict(messages.dtypes)[key], uuid.uuid4().hex

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = worker_cache()
        if mark not in kept:
            kept[mark] = load()
        model = kept[mark]
        for batch in batches:
            rows = [(k, i, *span) for k, i, found in zip(batch[key], batch["msg_idx"], model(batch["content"].tolist()))
                    for span in found]
            yield pd.DataFrame(rows, columns=[key, "msg_idx", "start", "end", "label"])

    return messages.select(key, "msg_idx", "content").mapInPandas(
        spans, f"{key} {kind}, msg_idx int, start int, end int, label string")
