"""Reversible redaction of requests that are one row each: ``texts`` is the array of message contents, in order.

Everything is a projection of the row: no shuffle, and the numbering of a request never leaves its row. Tables with
one message per row, whose requests may be too large for a row, go through ``message_rows`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptveil.functions.patterns import PLACEHOLDER, PiiPattern, pii_patterns
from promptveil.functions.text import sql_bind, sql_look_up, sql_lookup_table, sql_text, sql_weave
from promptveil.schemas import VAULT_ENTRY


def scrub_into(requests: DataFrame, texts: Column, into: str, patterns: Sequence[PiiPattern] | None = None,
               mark: str = "") -> DataFrame:
    """Add struct ``into`` (texts, vault) for an array of texts that are numbered together; null texts stay null.

    Labels run in their fixed order, each on the texts the one before has left. ``mark`` goes into the placeholders
    when they are not the final ones. Each step uses the one before exactly once, so the steps fold into one projection
    and stay one, whatever is filtered on later.
    """
    vault = F.array().cast(f"array<{VAULT_ENTRY}>")
    out = requests.withColumn(into, F.struct(texts.alias("texts"), vault.alias("vault")))
    for pattern in patterns or pii_patterns():
        out = out.withColumn(into, F.expr(label_step(into, pattern, mark)))
    return out


def label_step(state: str, pattern: PiiPattern, mark: str) -> str:
    """One label's pass over a (texts, vault) struct. The gate spares most texts the full pattern, and requests with
    nothing of the label keep their texts as they are."""
    regex, gate = sql_text(pattern.regex), sql_text(pattern.gate)
    hits = f"CASE WHEN t RLIKE {gate} THEN regexp_extract_all(t, {regex}, 0) ELSE cast(array() AS array<string>) END"
    found = sql_bind(state, "s", f"struct(s.texts AS texts, s.vault AS vault, transform(s.texts, t -> {hits}) AS hits)")
    entered = sql_bind(found, "s", "struct(s.texts AS texts, s.vault AS vault, s.hits AS hits, "
                       f"{vault_entries(pattern.label, 'array_distinct(flatten(s.hits))', mark)} AS entries)")
    names = sql_lookup_table("transform(s.entries, e -> struct(e.original AS key, e.placeholder AS value))")
    woven = sql_weave("t", pattern.regex, "h", sql_look_up("names", "hit"))
    renamed = sql_bind(names, "names",
                       f"zip_with(s.texts, s.hits, (t, h) -> CASE WHEN size(h) = 0 THEN t ELSE {woven} END)")
    return sql_bind(entered, "s", f"struct(CASE WHEN size(s.entries) = 0 THEN s.texts ELSE {renamed} END AS texts, "
                                  "concat(s.vault, s.entries) AS vault)")


def vault_entries(label: str, values: str, mark: str = "") -> str:
    """Vault entries (SQL) of one label; the index is the place in ``values``."""
    return (f"transform({values}, (v, i) -> struct({sql_text(label)} AS label, i + 1 AS idx, "
            f"concat({sql_text(f'[{mark}{label}_')}, cast(i + 1 AS string), ']') AS placeholder, v AS original))")


def scrub(requests: DataFrame, texts: str = "texts", patterns: Sequence[PiiPattern] | None = None) -> DataFrame:
    """Replace ``texts`` by its scrubbed form and add ``vault`` (array of label, idx, placeholder, original)."""
    return (scrub_into(requests, F.col(texts), "scrubbed__", patterns)
            .withColumns({texts: F.col("scrubbed__.texts"), "vault": F.col("scrubbed__.vault")}).drop("scrubbed__"))


def counts_by_label(vault: Column) -> Column:
    """Map label -> distinct placeholders, only for labels that occur, in order of first entry."""
    labels = F.array_distinct(F.transform(vault, lambda entry: entry["label"]))
    return F.map_from_entries(F.transform(labels, lambda label: F.struct(
        label, F.size(F.filter(vault, lambda entry: entry["label"] == label)))))


def vault_rows(redacted: DataFrame, *keys: str) -> DataFrame:
    """The vault as a table (keys, label, idx, placeholder, original)."""
    # an expression, not the bare column: for a bare column Spark adds a filter that computes the vault a second time
    return redacted.select(*keys, F.inline(F.filter("vault", lambda entry: entry["original"].isNotNull())))


def sealed(vault: DataFrame, key: Column) -> DataFrame:
    """Vault rows with ``original`` encrypted. ``key`` must be a column read from a protected table, never a literal:
    a literal key would be printed with the plan."""
    return vault.withColumn("original", F.aes_encrypt(F.col("original"), key))


def opened(vault: DataFrame, key: Column) -> DataFrame:
    return vault.withColumn("original", F.aes_decrypt(F.col("original"), key).cast("string"))


def restore(text: str, vault: str = "vault") -> Column:
    """Put the originals back into the SQL expression ``text``, in one pass. Unknown placeholders stay, and restored
    text is not searched again."""
    known = sql_lookup_table("transform(s.vault, e -> struct(e.placeholder AS key, e.original AS value))")
    woven = sql_weave("s.text", PLACEHOLDER, f"regexp_extract_all(s.text, {sql_text(PLACEHOLDER)}, 0)",
                      f"coalesce({sql_look_up('known', 'hit')}, hit)")
    return F.expr(sql_bind(f"struct({text} AS text, {vault} AS vault)", "s",
                           f"CASE WHEN size(s.vault) = 0 THEN s.text ELSE {sql_bind(known, 'known', woven)} END"))


def holds_placeholder(texts: Column) -> Column:
    """True if any input text already looks like it holds a placeholder, so restoring may change it."""
    return F.exists(texts, lambda text: F.rlike(text, F.lit(PLACEHOLDER)))
