"""The request operators for tables with one message per row: (request_id, msg_idx, role, content).

Nothing here gathers a request into a row, so one request may hold any share of the table. What must be agreed within a
request is worked out on its distinct values, in blocks, and joined back by (request_id, msg_idx).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptveil.functions.patterns import PiiPattern
from promptveil.functions.text import sql_bind, sql_look_up, sql_lookup_table, sql_text, sql_weave
from promptveil.operators import entities, scan
from promptveil.operators.redact import scrub_into
from promptveil.session import written
from promptveil.settings import ENTITY_LABELS

# messages per numbering block
BLOCK = 1_000
# stands before the label in a message's own placeholders until the request's numbers are known; a noncharacter, so it
# is in no text meant for exchange
MARK = "\ufdd0"
LOCAL_PLACEHOLDER = rf"\[{MARK}[A-Z_]+_[0-9]+\]"


def redact_messages(messages: DataFrame, patterns: Sequence[PiiPattern] | None = None,
                    key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(messages with ``content`` scrubbed, vault rows (key, label, idx, placeholder, original)).

    Messages are scrubbed once, each by itself, into a table in the shared folder (it holds originals: protect it as
    the vault); the vault and the renamed texts both start from there.
    """
    local = scrub_into(messages, F.array("content"), "s__", patterns, MARK)
    local = written(local.withColumns({"content": F.get("s__.texts", F.lit(0)), "found__": F.col("s__.vault")})
                    .drop("s__"), "messages")
    # a message's own index is the order of appearance within it
    entries = local.select(key, "msg_idx", F.inline(F.filter("found__", lambda e: e["original"].isNotNull())))
    vault = numbered(entries, key)
    # a value repeated all over one request makes one hot join key; Spark's skew join splits it
    names = (entries.select(key, "msg_idx", "label", "original", F.col("placeholder").alias("own"))
             .join(vault, [key, "label", "original"])
             .groupBy(key, "msg_idx")
             .agg(F.collect_list(F.struct(F.col("own").alias("key"), F.col("placeholder").alias("value")))
                  .alias("names__")))
    tokens = f"regexp_extract_all(content, {sql_text(LOCAL_PLACEHOLDER)}, 0)"
    renamed = F.expr(sql_bind(sql_lookup_table("names__"), "names", sql_weave(
        "content", LOCAL_PLACEHOLDER, tokens, f"coalesce({sql_look_up('names', 'hit')}, hit)")))
    out = (local.drop("found__").join(names, [key, "msg_idx"], "left")
           .withColumn("content", F.when(F.col("names__").isNull(), F.col("content")).otherwise(renamed))
           .drop("names__"))
    return out.select(*messages.columns), vault


def redact_names(messages: DataFrame, names: DataFrame, key: str = "request_id",
                 labels: Iterable[str] = ENTITY_LABELS) -> tuple[DataFrame, DataFrame]:
    """The same for names of a list of any size: messages in order, and within a message from the last name to the
    first. ``messages`` are pattern-scrubbed and stored, as they are read more than once."""
    texts = messages.select(F.struct(key, "msg_idx").alias("at__"), F.col("content").alias("text"))
    spans = entities.joined_spans(texts, names, "at__", labels)
    valued = written(spans.join(texts, "at__").select(
        F.col(f"at__.{key}").alias(key), F.col("at__.msg_idx").alias("msg_idx"), "start", "end", "label",
        F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("original")),
        "name-spans")
    vault = numbered(valued.select(key, "msg_idx", (-F.col("start")).alias("idx"), "label", "original"), key)
    placed = (valued.join(vault.select(key, "label", "original", "placeholder"), [key, "label", "original"])
              .groupBy(key, "msg_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("spans__")))
    # what stands before each name, then its placeholder, then the rest
    woven = F.expr("""concat(array_join(transform(spans__, (s, i) -> concat(substring(content, 1 + cast(if(i = 0, 0,
        spans__[i - 1].end) AS int), cast(s.start - if(i = 0, 0, spans__[i - 1].end) AS int)), s.placeholder)), ''),
        substring(content, 1 + cast(element_at(spans__, -1).end AS int), char_length(content)))""")
    out = (messages.join(placed, [key, "msg_idx"], "left")
           .withColumn("content", F.when(F.col("spans__").isNull(), F.col("content")).otherwise(woven)))
    return out.select(*messages.columns), vault


def numbered(entries: DataFrame, key: str = "request_id") -> DataFrame:
    """Number distinct (label, original) pairs of each request by first appearance.

    ``entries`` holds (key, msg_idx, idx, label, original). Ranks are taken within blocks of messages and shifted by
    the sizes of the blocks before, so that no task holds more than one block's values or one request's block sizes.
    """
    first = (entries.groupBy(key, "label", "original")
             .agg(F.min(F.struct("msg_idx", "idx")).alias("first"))
             .withColumn("block", F.floor(F.col("first.msg_idx") / BLOCK)))
    sizes = first.groupBy(key, "label", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key, "label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "label", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(key, "label", "block").orderBy("first"))
    index = (F.col("before") + F.col("rank")).cast("int")
    return (first.withColumn("rank", rank).join(offsets, [key, "label", "block"])
            .select(key, "label", index.alias("idx"),
                    F.concat(F.lit("["), "label", F.lit("_"), index.cast("string"), F.lit("]")).alias("placeholder"),
                    "original"))


def positions(messages: DataFrame, key: str = "request_id") -> DataFrame:
    """``messages`` with ``pos__``, the place in its request from 1 without gaps, whatever the steps of ``msg_idx``.
    Ranks are taken within blocks and shifted, as in ``numbered``."""
    narrow = messages.select(key, "msg_idx").withColumn("block", F.floor(F.col("msg_idx") / BLOCK))
    sizes = narrow.groupBy(key, "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(key, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(key, "block").orderBy("msg_idx"))
    placed = narrow.withColumn("rank", rank).join(before, [key, "block"])
    return messages.join(placed.select(key, "msg_idx", (F.col("before") + F.col("rank")).alias("pos__")), [key, "msg_idx"])


def scan_messages(messages: DataFrame, signatures: DataFrame, key: str = "request_id") -> DataFrame:
    """Distinct (key, sig_id, name) over each request's contents joined by newlines.

    Signatures without a newline lie within one message. Those with newlines may span messages, so they are looked for
    in each message together with as many following ones as they have newlines.
    """
    rows = messages.withColumn("at__", F.struct(key, "msg_idx"))
    plain = signatures.where(~F.contains("pattern", F.lit("\n")))
    found = scan.found(rows.select("at__", F.col("content").alias("text")), plain, "at__")
    broken = signatures.where(F.contains("pattern", F.lit("\n")))
    reach = broken.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("\n"), F.lit(""))))).first()[0]
    if reach:
        placed = positions(messages.select(key, "msg_idx", "content"), key)

        def follower(step: int) -> DataFrame:
            return placed.select(F.col(key), (F.col("pos__") - step).alias("pos__"), F.col("content").alias(f"next{step}"))

        joined = reduce(lambda left, step: left.join(follower(step), [key, "pos__"], "left"), range(1, reach + 1), placed)
        text: Column = F.concat_ws("\n", "content", *[f"next{step}" for step in range(1, reach + 1)])
        spanning = joined.select(F.struct(key, "msg_idx").alias("at__"), text.alias("text"))
        found = found.unionByName(scan.found(spanning, broken, "at__"))
    return found.select(F.col(f"at__.{key}").alias(key), "sig_id", "name").distinct()


def hit_counts(messages: DataFrame, signatures: DataFrame, key: str = "request_id") -> DataFrame:
    return scan_messages(messages, signatures, key).groupBy(key).agg(F.count("*").alias("n_hits"))


def label_counts(vault: DataFrame, key: str = "request_id") -> DataFrame:
    return vault.groupBy(key, "label").agg(F.count("*").alias("n"))
