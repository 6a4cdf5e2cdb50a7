"""One query per operator, over the given tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptveil.functions.patterns import PLACEHOLDER
from promptveil.functions.text import ascii_fold
from promptveil.functions.times import as_instant
from promptveil.operators import (
    auth, decisions, entities, hit_table, long_texts, message_rows, providers, redact, scan, token_bucket)
from promptveil.plans import requests as plan
from promptveil.plans import any_size, daily_sketches, long_requests, rollups
from promptveil.session import run_folder, spread, written
from promptveil.settings import Settings
from promptveil.sources import audit_store, demo_requests
from promptveil.sources import requests as request_source
from promptveil.sources import signatures as signature_source
from promptveil.streaming import flow
from promptveil.streaming import requests as request_stream
from promptveil.streaming import rollups as rollup_stream
from promptveil.streaming import token_bucket as bucket_stream

DEMO = Settings(jwt_secret=demo_requests.SECRET, rate_capacity=3, rate_refill_per_sec=1 / 3600, provider="anthropic")
# letters that end a word in one regex dialect and not in another; both sides of a check turn them into "z"
ACCENTED = "[À-ɏ]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def pieces(length: int):
    """All consecutive pieces of ``length`` characters of column text, the last one with the rest: nothing is left out."""
    count = F.greatest(F.lit(1), F.floor(F.char_length("text") / length)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.substr(
        F.col("text"), n * length + 1, F.when(n == count - 1, F.char_length("text")).otherwise(F.lit(length))))


def phrases(spark: SparkSession, folder: str, length: int = 30, part: int | None = None) -> DataFrame:
    """Signatures: the benchmark items cut into all their pieces, or every second one from piece ``part``."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet").where(F.length("text") > 0)
    cut = items.select("item_id", F.posexplode(pieces(length)).alias("n", "piece"))
    if part is not None:
        cut = cut.where(F.col("n") % 2 == part)
    return signature_source.signatures_from_table(cut, F.col("item_id") * 1000 + F.col("n"), F.col("piece"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as one row."""
    return request_source.assemble(table(spark, folder, "conversations"), "conv_id")


# --- requests ---

def conv_requests(spark, folder):
    assembled = conversations(spark, folder)
    return assembled.select(
        "conv_id", F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ">").alias("roles"),
        request_source.scan_text(F.col("messages")).alias("joined"))


def turn_requests(spark, folder):
    """Each turn as a request, with the faults that validation must find."""
    conv, turn = F.col("conv_id"), F.col("turn")
    role = F.when(F.pmod(conv, F.lit(11)) == 3, F.lit("tool")).otherwise(F.col("role"))
    content = F.when(F.pmod(conv + turn, F.lit(13)) != 4, F.col("text"))
    messages = F.array(F.struct(role.alias("role"), content.alias("content")))
    tokens = (F.when(F.pmod(conv, F.lit(7)) == 0, 0).when(F.pmod(conv, F.lit(7)) == 1, 40000)
              .when(F.pmod(conv, F.lit(7)) != 2, 500))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.pmod(conv, F.lit(17)) == 5, F.slice(messages, 1, 0)).otherwise(messages)
        .alias("messages"),
        F.lit("model-b").alias("model"), tokens.cast("int").alias("max_tokens"))


def validate_requests(spark, folder):
    return request_source.check_requests(turn_requests(spark, folder)).select(
        "conv_id", "turn", "invalid_reason", "max_tokens")


def quarantined_requests(spark, folder):
    return (request_source.quarantined(turn_requests(spark, folder)).groupBy("invalid_reason")
            .agg(F.count("*").alias("n")))


def request_parse(spark, folder):
    rows = turn_requests(spark, folder)
    body = F.to_json(F.struct("messages", "model", "max_tokens"))
    broken = F.when(F.pmod("conv_id", F.lit(9)) == 0, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    parsed = request_source.parse_bodies(rows.select("conv_id", "turn", broken.alias("body")), "body")
    good = F.col(request_source.CORRUPT).isNull()
    return parsed.select("conv_id", "turn", good.alias("parsed"),
                         F.when(good, F.size("messages")).cast("bigint").alias("n_messages"),
                         F.when(good, F.get("messages", F.lit(0))["content"]).alias("content"),
                         F.when(good, F.col("model")).alias("model"),
                         F.when(good, F.col("max_tokens")).alias("max_tokens"))


def stored_requests(spark, folder):
    """Requests written as JSON lines, read back and validated."""
    path = run_folder(spark, "requests")
    demo_requests.document_requests(documents(spark, folder)).write.json(path)
    back = request_source.valid_requests(request_source.read_requests(spark, path))
    return back.select("request_id", F.unix_micros("ts").alias("micros"), "client_ip", "model", "max_tokens",
                       F.md5(F.get("messages", F.lit(0))["content"]).alias("content_md5"))


# --- signatures and scanning ---

def signature_file(spark, folder):
    """Each benchmark item written as a signature file: its pieces in two lists, among keys to be skipped."""
    side = lambda odd: F.filter(pieces(12), lambda _, n: n % 2 == odd)
    body = F.to_json(F.struct(pieces(12).alias("_hidden"), side(0).alias("first"), F.lit("no list").alias("note"),
                              side(1).alias("second")))
    files = table(spark, folder, "benchmark").select("item_id", body.alias("value"))
    return signature_source.signatures_from_json(files, "value", "item_id")


def pattern_count(spark, folder):
    known = phrases(spark, folder)
    return signature_source.pattern_count(known.withColumn(
        "pattern", F.when(F.pmod(F.floor(F.col("sig_id") / 1000), F.lit(5)) == 4, F.lit("")).otherwise(F.col("pattern"))))


def scan_distinct(spark, folder):
    return scan.scan(documents(spark, folder), phrases(spark, folder), "doc_id").select(
        "doc_id", "sig_id", F.col("first_end").cast("bigint").alias("first_end"))


def scan_join(spark, folder):
    """The same through the plan for dictionaries of any size."""
    return scan.scan_join(documents(spark, folder), phrases(spark, folder), "doc_id").select(
        "doc_id", "sig_id", F.col("first_end").cast("bigint").alias("first_end"))


def scan_offsets(spark, folder):
    return scan.occurrences(documents(spark, folder), phrases(spark, folder), "doc_id")


def scan_offsets_cut(spark, folder):
    """The same with every text cut into overlapping pieces of a few hundred bytes."""
    return long_texts.occurrences(documents(spark, folder), phrases(spark, folder), "doc_id", piece=300)


def scan_delta(spark, folder):
    """A stored hit table brought up to date twice: texts come, change and go, signatures are added, removed and added
    again. The hits are those of a whole scan of what is there at the end."""
    store = hit_table.hit_store(spark, run_folder(spark, "hits"), T.StructField("doc_id", T.LongType()))
    docs = documents(spark, folder)
    item = F.floor(F.col("sig_id") / 1000)
    signatures = phrases(spark, folder)
    kind = F.pmod("doc_id", F.lit(6))
    first = docs.where(kind < 4)
    before = first.withColumn("text", F.when(kind == 0, F.reverse("text")).otherwise(F.col("text")))
    hit_table.update(store, 0, docs.where("false"), before, signatures.where(F.pmod(item, F.lit(5)) < 3), "doc_id")
    hit_table.update(store, 1, before, docs.where(kind == 4), signatures.where(F.pmod(item, F.lit(5)) > 1), "doc_id")
    # now texts of kind 0 change, those of kind 1 go, and signatures of residue 1 come back
    hit_table.update(store, 2, docs.where(kind <= 4), docs.where((kind == 0) | (kind == 5)),
                     signatures.where(F.pmod(item, F.lit(5)) > 0), "doc_id", gone=docs.where(kind <= 1).select("doc_id"))
    return hit_table.read_hits(store, "doc_id").select("doc_id", "sig_id", "first_end")


def scan_names(spark, folder):
    found = scan.matches(documents(spark, folder), phrases(spark, folder), "doc_id")
    return found.select("doc_id", F.array_join("names", "|").alias("names"))


def scan_hit_counts(spark, folder):
    return scan.hit_counts(documents(spark, folder), phrases(spark, folder, 6), "doc_id")


def scan_blocked(spark, folder):
    return scan.blocked(documents(spark, folder), phrases(spark, folder), "doc_id").select(
        "doc_id", F.md5("text").alias("text_md5"))


def scan_clean(spark, folder):
    return scan.clean(documents(spark, folder), phrases(spark, folder), "doc_id").select(
        "doc_id", F.md5("text").alias("text_md5"))


def ingress_scan(spark, folder):
    """Whole conversations against short phrases."""
    texts = conversations(spark, folder).select("conv_id", request_source.scan_text(F.col("messages")).alias("text"))
    return scan.hit_counts(texts, phrases(spark, folder, 6), "conv_id")


def message_scan(spark, folder):
    """The same hits with one message per row, no conversation gathered; signatures with newlines span messages, whose
    numbers have gaps."""
    rows = table(spark, folder, "conversations").select(
        "conv_id", (F.col("turn") * 3 + 1).cast("int").alias("msg_idx"), "role", F.col("text").alias("content"))
    return message_rows.hit_counts(rows, phrases(spark, folder, 6), "conv_id")


def egress_scan(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.col("html").alias("text"))
    return scan.hit_counts(pages, phrases(spark, folder, 5), "page_id")


# --- redaction ---

def redacted_documents(spark, folder):
    return redact.scrub(documents(spark, folder).select("doc_id", F.array("text").alias("texts")))


def pii_vault(spark, folder):
    return redact.vault_rows(redacted_documents(spark, folder), "doc_id").select(
        "doc_id", "label", F.col("idx").cast("bigint").alias("idx"), "placeholder",
        F.regexp_replace("original", ACCENTED, "z").alias("original"))


def vault_opened(spark, folder):
    """The vault sealed and opened again, with a key column that a table gives."""
    vault = redact.vault_rows(redacted_documents(spark, folder), "doc_id")
    keyed = vault.withColumn("key", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16))
    closed = written(redact.sealed(keyed, F.col("key")), "sealed")
    return redact.opened(closed, F.col("key")).select(
        "doc_id", "label", F.col("idx").cast("bigint").alias("idx"), "placeholder",
        F.regexp_replace("original", ACCENTED, "z").alias("original"))


def pii_planted(spark, folder):
    """Counts with an identity number and an address, made from the key, added to every text."""
    doc = F.col("doc_id")
    number = lambda of, least: (F.pmod(doc, F.lit(of)) + least).cast("string")
    more = F.concat(F.lit("\nid "), number(800, 100), F.lit("-"), number(80, 10), F.lit("-"), number(8000, 1000),
                    F.lit(", lives at "), number(200, 1), F.lit(" Old Mill Road, says so."))
    docs = documents(spark, folder).select("doc_id", F.array(F.concat("text", more)).alias("texts"))
    return (redact.vault_rows(redact.scrub(docs), "doc_id").groupBy("doc_id", "label").agg(F.count("*").alias("n")))


def pii_counts(spark, folder):
    counted = redacted_documents(spark, folder).select(
        "doc_id", F.explode(redact.counts_by_label(F.col("vault"))).alias("label", "n"))
    return counted.withColumn("n", F.col("n").cast("bigint"))


def pii_redacted(spark, folder):
    text = F.get("texts", F.lit(0))
    return redacted_documents(spark, folder).select(
        "doc_id", F.size("vault").cast("bigint").alias("redactions"),
        F.md5(F.regexp_replace(text, ACCENTED, "z")).alias("scrubbed_md5"))


def pii_restore(spark, folder):
    return redacted_documents(spark, folder).select("doc_id", F.md5(redact.restore("texts[0]")).alias("restored_md5"))


def page_pii_counts(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.array("html").alias("texts"))
    return (redact.vault_rows(redact.scrub(pages), "page_id")
            .groupBy("page_id", "label").agg(F.count("*").alias("n")))


def source_messages(spark, folder):
    """All documents of a source as the messages of one request."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("request_id"), F.col("doc_id").alias("msg_idx"),
        F.lit("user").alias("role"), F.col("text").alias("content"))


def message_vault(spark, folder):
    """Numbering across the many messages of few, large requests."""
    _, vault = message_rows.redact_messages(source_messages(spark, folder))
    return vault.select("request_id", "label", F.col("idx").cast("bigint").alias("idx"), "placeholder",
                        F.regexp_replace("original", ACCENTED, "z").alias("original"))


def message_redacted(spark, folder):
    texts, _ = message_rows.redact_messages(source_messages(spark, folder))
    return texts.select("request_id", F.col("msg_idx").cast("bigint").alias("msg_idx"),
                        F.md5(F.regexp_replace("content", ACCENTED, "z")).alias("scrubbed_md5"))


# --- entities ---

def names(spark, folder):
    """Names are the longer capitalised words of the benchmark items, labelled by item."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    label = F.element_at(F.lit(["PERSON", "GPE", "LOC", "ORG"]), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    words = items.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"),
                         label.alias("label"))
    return words.where((F.char_length("name") >= 6) & (F.col("name") != F.lower("name")))


def gazetteer(spark, folder):
    return entities.read_gazetteer(names(spark, folder))


def entity_spans(spark, folder):
    spans = entities.gazetteer_spans(F.col("text"), gazetteer(spark, folder))
    found = documents(spark, folder).select("doc_id", F.inline(spans))
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"),
                        F.col("end").cast("bigint").alias("end"), "label")


def entity_spans_join(spark, folder):
    """The same spans by the route for name lists of any size."""
    return entities.joined_spans(documents(spark, folder), names(spark, folder), "doc_id")


NO_VAULT = f"cast(array() AS array<{redact.VAULT_ENTRY}>)"


def entity_documents(spark, folder):
    done = entities.gazetteer_scrubbed(gazetteer(spark, folder), "array(text)", NO_VAULT)
    return documents(spark, folder).select("doc_id", done.alias("done")).select(
        "doc_id", F.get("done.texts", F.lit(0)).alias("text"), F.col("done.vault").alias("vault"))


def entity_vault(spark, folder):
    return redact.vault_rows(entity_documents(spark, folder), "doc_id").select(
        "doc_id", "label", F.col("idx").cast("bigint").alias("idx"), "original")


def entity_restored(spark, folder):
    return entity_documents(spark, folder).select(
        "doc_id", F.size("vault").cast("bigint").alias("redactions"),
        F.length(F.regexp_replace("text", PLACEHOLDER, "")).cast("bigint").alias("rest_length"),
        F.md5(redact.restore("text")).alias("restored_md5"))


def span_vault(spark, folder):
    """The same redaction from a span table: spans go out as rows and come back by join."""
    docs = documents(spark, folder)
    spans = docs.select("doc_id", F.lit(0).alias("msg_idx"), F.inline(
        entities.gazetteer_spans(F.col("text"), gazetteer(spark, folder))))
    joined = docs.join(entities.gather_spans(spans, "doc_id"), "doc_id", "left")
    done = entities.span_scrubbed(f"coalesce(spans, cast(array() AS array<array<{entities.SPAN}>>))", "array(text)",
                                  NO_VAULT)
    out = joined.select("doc_id", done.alias("done")).select("doc_id", F.col("done.vault").alias("vault"))
    return redact.vault_rows(out, "doc_id").select("doc_id", "label", F.col("idx").cast("bigint").alias("idx"),
                                                   "original")


# --- identity and rate limit ---

def events(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return rows.withColumn("ts", as_instant(rows, "ts"))


def bucket_columns(outcomes):
    return outcomes.select("event_id", "user_id", "allowed", "retry_after",
                           F.col("retry_after_header").cast("bigint").alias("retry_after_header"), "remaining")


def rate_outcomes(spark, folder):
    return bucket_columns(token_bucket.replay(events(spark, folder), 3, 1 / 86400))


def rate_outcomes_pieces(spark, folder):
    """Three users hold a third of the events each: their buckets are replayed in pieces, side by side."""
    rows = events(spark, folder).withColumn("user_id", F.pmod("user_id", F.lit(3)))
    piece = max(1, rows.count() // 16)
    return bucket_columns(token_bucket.replay(rows, 5, 1 / 900, hot_events=piece))


def rate_outcomes_single(spark, folder):
    """The same three users with buckets of one token."""
    rows = events(spark, folder).withColumn("user_id", F.pmod("user_id", F.lit(3)))
    return bucket_columns(token_bucket.replay(rows, 1, 1 / 900, hot_events=max(1, rows.count() // 16)))


def stream_rate_outcomes(spark, folder):
    """The same as keyed state over the events file, run until it has seen all of it."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    arriving = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
                .select("event_id", "ts", "user_id"))
    target = run_folder(spark, "bucket")
    query = (bucket_stream.replay_stream(arriving, 3, 1 / 86400).drop("ts").writeStream.format("parquet")
             .option("path", f"{target}/rows").option("checkpointLocation", f"{target}/state")
             .trigger(availableNow=True).start())
    finish(query)
    return bucket_columns(spark.read.parquet(f"{target}/rows"))


def finish(query, seconds: int = 900) -> None:
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("the stream did not end in time")


def auth_events(spark, folder):
    rows = demo_requests.with_authorization(events(spark, folder), F.col("event_id"), F.col("user_id"), F.col("ts"))
    return auth.authenticate(rows, DEMO, F.col("ts"))


def auth_outcomes(spark, folder):
    """Every class of token, claims of the wrong type among them."""
    rows = demo_requests.with_authorization(events(spark, folder), F.col("event_id"), F.col("user_id"), F.col("ts"), odd=True)
    return auth.authenticate(rows, DEMO, F.col("ts")).select("event_id", F.col("auth.ok").alias("ok"),
                                             F.col("auth.user_id").alias("user_id"),
                                             F.col("auth.reason").alias("reason"),
                                             F.col("auth.never_expires").alias("never_expires"))


def metered_events(spark, folder):
    """Only authenticated events take tokens."""
    known = written(auth_events(spark, folder).where(F.col("auth.ok")).select(
        "event_id", F.col("auth.user_id").alias("user_id"), "ts"), "takers")
    return bucket_columns(token_bucket.replay(known, 3, 1 / 86400))


# --- providers ---

def chat(spark, folder):
    return conversations(spark, folder).select(
        F.col("conv_id").cast("string").alias("request_id"), "conv_id", "messages",
        F.when(F.pmod("conv_id", F.lit(3)) == 0, F.lit("")).when(F.pmod("conv_id", F.lit(3)) == 1, "model-a")
        .alias("model"), (F.pmod("conv_id", F.lit(900)) + 1).cast("int").alias("max_tokens"))


def provider_body_block(spark, folder):
    return providers.request_bodies(chat(spark, folder), "Anthropic")


def provider_body_choice(spark, folder):
    return providers.request_bodies(chat(spark, folder), "openai")


def model_resolution(spark, folder):
    return chat(spark, folder).select("conv_id", providers.resolved_model(F.col("model")).alias("model"))


def echo_responses(spark, folder):
    return chat(spark, folder).select("conv_id", providers.echo_text(F.col("messages")).alias("content"))


def parse_block(spark, folder):
    """Responses built per turn: several blocks, other types, blocks without text, none at all."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    text, none = F.col("text"), F.lit(None).cast("string")
    blocks = (F.when(kind == 0, F.array(block("text", text), block("text", F.lit(" and more"))))
              .when(kind == 1, F.array(block("tool_use", text), block("text", text)))
              .when(kind == 2, F.array(block("text", none), block("text", text)))
              .when(kind == 3, F.array(block("tool_use", text))))
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", providers.block_text(F.to_json(F.struct(blocks.alias("content"))))
                       .alias("content"))


def parse_choice(spark, folder):
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    choice = lambda text: F.struct(F.struct(text.alias("content")).alias("message"))
    text, none = F.col("text"), F.lit(None).cast("string")
    choices = (F.when(kind == 0, F.array(choice(text), choice(F.lit("second"))))
               .when(kind == 1, F.array(choice(none))).when(kind == 2, F.slice(F.array(choice(text)), 1, 0)))
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", providers.choice_text(F.to_json(F.struct(choices.alias("choices"))))
                       .alias("content"))


def response_join(spark, folder):
    docs = documents(spark, folder)
    requests = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"))
    return providers.with_responses(requests, demo_requests.document_responses(docs), "anthropic").select(
        "request_id", "proxy_detail", F.md5("response_text").alias("response_md5"))


# --- decisions and audit ---

def dictionaries(spark, folder):
    return plan.Dictionaries(scan.usable(phrases(spark, folder, 30, 0)), scan.usable(phrases(spark, folder, 30, 1)))


def decided(spark, folder):
    docs = documents(spark, folder)
    return plan.decided_requests(demo_requests.document_requests(docs), dictionaries(spark, folder), DEMO,
                                 demo_requests.document_responses(docs))


def request_decisions(spark, folder):
    return decided(spark, folder).select("request_id", "decision", F.col("stage").alias("terminating_stage"),
                                         F.col("status_code").cast("bigint").alias("status_code"), "detail")


def audit(spark, folder):
    return decisions.audit_rows(decided(spark, folder), DEMO.provider)


def long_words(spark, folder, least: int = 8):
    """Signatures: the long words of the benchmark items. Few hold a word start inside, so they are joined as a table."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    words = items.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    folded = words.where(F.char_length("word") >= least).select(ascii_fold(F.col("word")).alias("word")).distinct()
    return signature_source.signatures_from_table(folded, F.row_number().over(Window.orderBy("word")), F.col("word"))


def audit_rows_large_dictionary(spark, folder):
    """The flow with more signatures than the plan holds."""
    words = plan.Dictionaries(scan.usable(long_words(spark, folder)), scan.usable(phrases(spark, folder, 30, 1)))
    docs = documents(spark, folder)
    decided_rows = plan.decided_requests(demo_requests.document_requests(docs), words, DEMO, demo_requests.document_responses(docs))
    return flat_audit(decisions.audit_rows(decided_rows, DEMO.provider))


def redacted_prompts(spark, folder):
    """The audit with scrubbed prompts, as the setting asks for."""
    rows = plan.audit(decided(spark, folder), replace(DEMO, store_redacted_prompt=True))
    return rows.select("request_id", F.md5(F.regexp_replace("redacted_prompt", ACCENTED, "z")).alias("prompt_md5"))


def audit_outcomes(spark, folder):
    """The narrow projection, from a stored audit of which only its columns are read."""
    path = run_folder(spark, "audit")
    audit_store.write_audit(plan_echo_audit(spark, folder), path, 0)
    columns = ["decision", "status_code", "terminating_stage"]
    back = audit_store.outcomes(audit_store.read_audit(spark, path, ("2024-01-01", None), columns))
    return back.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("status_code", F.col("status_code").cast("bigint"))


def flat_audit(rows):
    return rows.select(
        "request_id", F.unix_micros("ts").alias("micros"), "user_id", "client_ip", "decision", "terminating_stage",
        F.col("status_code").cast("bigint").alias("status_code"), "jwt_valid", "rate_limited",
        F.col("ingress_hits").cast("bigint").alias("ingress_hits"),
        F.col("egress_hits").cast("bigint").alias("egress_hits"),
        F.aggregate(F.map_values("redaction_counts"), F.lit(0), lambda total, n: total + n).cast("bigint")
        .alias("redactions"), "provider", "latency_ms")


def audit_rows(spark, folder):
    return flat_audit(audit(spark, folder))


def response_projection(spark, folder):
    out = decisions.responses_out(plan.stored(decided(spark, folder)))
    return out.select("request_id", "model", F.md5(F.regexp_replace("content", ACCENTED, "z")).alias("content_md5"),
                      F.col("redactions").cast("bigint").alias("redactions"))


def rejection_projection(spark, folder):
    out = decisions.rejections_out(plan.stored(decided(spark, folder)))
    return (out.select("request_id", "stage", F.col("status_code").cast("bigint").alias("status_code"), "detail",
                       F.try_element_at("headers", F.lit("Retry-After")).alias("retry_after"))
            .groupBy("request_id", "stage", "status_code", "detail", "retry_after").agg(F.count("*").alias("n")))


def source_requests(spark, folder):
    """Each source's documents as one request: envelopes, messages, responses and both signature tables."""
    messages = source_messages(spark, folder)
    number = F.substring("request_id", 4, 10).cast("bigint")
    sources = messages.select("request_id").distinct().select(
        "request_id", F.timestamp_seconds(F.lit(demo_requests.START) + number * 60).alias("ts"),
        F.lit("10.0.0.1").alias("client_ip"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("int").alias("max_tokens"), (number + 7).alias("key__"))
    envelopes = demo_requests.with_authorization(sources, F.col("key__"), F.pmod("key__", F.lit(3)), F.col("ts"))
    said = F.lit("Re: [EMAIL_1] [PHONE_2] [IP_99999]")
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))).alias("content")))
    responses = sources.where(F.pmod("key__", F.lit(20)) != 0).select(
        "request_id", F.lit(200).alias("http_status"), body.alias("body"))
    return envelopes.drop("key__"), messages, phrases(spark, folder, 60), phrases(spark, folder, 30, 1), responses


def source_rows(outcome, audit):
    answers = outcome.decided.select("request_id", F.regexp_replace("restored_text", ACCENTED, "z").alias("answer"))
    return flat_audit(audit).drop("micros", "client_ip", "latency_ms").join(answers, "request_id")


def source_audit(spark, folder):
    """The flow over few, long requests kept as message rows."""
    envelopes, messages, injection, internal, responses = source_requests(spark, folder)
    outcome = long_requests.decide_long(envelopes, messages, injection, internal, DEMO, responses)
    return source_rows(outcome, long_requests.audit_rows(outcome, DEMO.provider))


def source_audit_split(spark, folder):
    """The same requests through the flow for any size, with a bound that lies among their sizes."""
    envelopes, messages, injection, internal, responses = source_requests(spark, folder)
    sizes = messages.groupBy("request_id").agg(F.sum(F.octet_length("content")).alias("bytes"))
    bound = sizes.agg(F.percentile_approx("bytes", 0.5)).head()[0] or 0
    outcome = any_size.decide_all(envelopes, messages, injection, internal, DEMO, responses, max_bytes=bound)
    return source_rows(outcome, any_size.audit_rows(outcome, DEMO.provider))


def audit_upsert(spark, folder):
    """Two batches in the store, the second repeating a third of the keys; the newest row of each key is read."""
    path = run_folder(spark, "audit")
    rows = plan_echo_audit(spark, folder)
    audit_store.write_audit(rows, path, 0)
    again = audit_store.read_audit_rows(spark, path).drop("write_seq", "date").where(F.substring("request_id", 5, 20).cast("bigint") % 3 == 0)
    audit_store.write_audit(again.withColumn("latency_ms", F.lit(-1.0)), path, 1)
    back = audit_store.read_audit(spark, path)
    return back.select("request_id", "decision", F.col("status_code").cast("bigint").alias("status_code"),
                       "terminating_stage", "latency_ms")


def audit_compacted(spark, folder):
    """The same two writes, compacted after each."""
    path, target = run_folder(spark, "audit"), run_folder(spark, "compacted")
    audit_store.write_audit(plan_echo_audit(spark, folder), path, 0)
    audit_store.compact_new(spark, path, target)
    again = audit_store.read_audit_rows(spark, path).drop("write_seq", "date").where(F.substring("request_id", 5, 20).cast("bigint") % 3 == 0)
    audit_store.write_audit(again.withColumn("latency_ms", F.lit(-1.0)), path, 1)
    audit_store.compact_new(spark, path, target)
    return audit_store.read_compacted_rows(spark, target).select(
        "request_id", "decision", F.col("status_code").cast("bigint").alias("status_code"), "terminating_stage", "latency_ms")


def plan_echo_audit(spark, folder):
    settings = Settings(jwt_secret=demo_requests.SECRET, rate_capacity=3, rate_refill_per_sec=1 / 3600)
    docs = demo_requests.document_requests(documents(spark, folder))
    return decisions.audit_rows(plan.decided_requests(docs, dictionaries(spark, folder), settings), "mock")


def echo_audit(spark, folder):
    """The flow with the echo responder in place of stored responses."""
    return flat_audit(plan_echo_audit(spark, folder))


def stream_audit(spark, folder):
    """The flow over request files that arrive in a folder, run until it has seen all of them."""
    settings = Settings(jwt_secret=demo_requests.SECRET, rate_capacity=3, rate_refill_per_sec=1 / 3600)
    target = run_folder(spark, "flow")
    demo_requests.document_requests(documents(spark, folder)).write.json(f"{target}/in")
    arriving = request_source.stream_requests(spark, f"{target}/in")
    finish(request_stream.audit_stream(arriving, dictionaries(spark, folder), settings, f"{target}/audit",
                                       f"{target}/state"))
    return flat_audit(audit_store.read_audit(spark, f"{target}/audit")).drop("latency_ms")


ECHO = Settings(jwt_secret=demo_requests.SECRET, rate_capacity=3, rate_refill_per_sec=1 / 3600)


def flow_stores(spark, folder, arriving, settings=ECHO, responses=None):
    """The streams over a folder of arriving request files, and of response files if given, run until they have seen
    all: the stores of what was decided and answered."""
    target = arriving.rsplit("/", 1)[0]
    words = dictionaries(spark, folder)
    finish(flow.land(request_source.stream_requests(spark, arriving), settings, target, f"{target}/state-land"))
    finish(flow.decide(spark, words, settings, target, f"{target}/state-decide", later=responses is not None))
    if responses is not None:
        came = spark.readStream.schema(flow.ARRIVED_RESPONSE).json(responses)
        finish(flow.land_responses(came, target, f"{target}/state-replies"))
        finish(flow.answer(spark, flow.landed_responses(spark, target), words, settings, target, f"{target}/state-answer"))
    return flow.decided_store(spark, settings, target), flow.answered_store(spark, target)


def arriving_documents(spark, folder):
    target = f"{run_folder(spark, 'flow')}/in"
    demo_requests.document_requests(documents(spark, folder)).drop("latency_ms").write.json(target, compression="gzip")
    return target


def stream_vault(spark, folder):
    """The vault that the stream stores with its audit."""
    rows = flow_stores(spark, folder, arriving_documents(spark, folder))[0].read("vault")
    return rows.select("request_id", "label", F.col("idx").cast("bigint").alias("idx"), "placeholder",
                       F.regexp_replace("original", ACCENTED, "z").alias("original"))


def stream_responses(spark, folder):
    """The answers of the stream, originals put back."""
    rows = flow_stores(spark, folder, arriving_documents(spark, folder))[0].read("responses")
    return rows.select("request_id", "model", F.md5("content").alias("content_md5"), F.col("redactions").cast("bigint").alias("redactions"))


def stream_quarantine(spark, folder):
    """Refused rows of the stream, among them lines that are no JSON."""
    kind = F.pmod("key", F.lit(9))
    rows = demo_requests.document_requests(documents(spark, folder)).withColumn("key", F.substring("request_id", 5, 20).cast("bigint"))
    rows = rows.withColumns({"max_tokens": F.when(kind == 0, 0).otherwise(F.col("max_tokens")),
                             "messages": F.when(kind == 1, F.slice("messages", 1, 0)).otherwise(F.col("messages"))})
    line = F.to_json(F.struct("request_id", "ts", "authorization", "client_ip", "messages", "model", "max_tokens"))
    target = f"{run_folder(spark, 'flow')}/in"
    rows.select(F.when(kind == 2, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(target)
    refused = flow_stores(spark, folder, target)[0].read("quarantine")
    text = F.coalesce(F.col("request_id"), F.regexp_extract(request_source.CORRUPT, '"request_id":"([^"]+)"', 1))
    return refused.select(text.alias("request_id"), "invalid_reason")


def stream_repeated_requests(spark, folder):
    """A third of the requests arrive twice, in files of their own: the outcome is that of each once."""
    target = arriving_documents(spark, folder)
    rows = demo_requests.document_requests(documents(spark, folder)).drop("latency_ms")
    rows.where(F.substring("request_id", 5, 20).cast("bigint") % 3 == 0).write.mode("append").json(target)
    return flat_audit(flow_stores(spark, folder, target)[0].read("audit")).drop("latency_ms")


def stream_late_responses(spark, folder):
    """Responses that arrive as a stream, up to 49 seconds after their requests, some never."""
    docs = documents(spark, folder)
    target = arriving_documents(spark, folder)
    far = F.timestamp_seconds(F.lit(demo_requests.START + 10 ** 9))  # moves the watermark on, as later traffic would
    tick = docs.agg(F.count("*")).select(F.lit("tick").alias("request_id"), far.alias("ts"), F.lit("10.0.0.0").alias("client_ip"),
                                         F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("messages"))
    demo_requests.with_authorization(tick, F.lit(11), F.lit("tick"), F.col("ts")).write.mode("append").json(target)
    number = F.substring("request_id", 5, 20).cast("bigint")
    came = demo_requests.document_responses(docs).withColumn(
        "received", F.timestamp_seconds(F.lit(demo_requests.START) + number * 37 + F.pmod(number, F.lit(50))))
    responses = f"{target.rsplit('/', 1)[0]}/responses"
    came.unionByName(tick.select(F.lit("none").alias("request_id"), F.lit(200).alias("http_status"), F.lit("").alias("body"),
                                 F.col("ts").alias("received"))).write.json(responses, compression="gzip")
    before, after = flow_stores(spark, folder, target, DEMO, responses)
    rows = before.read("audit").unionByName(after.read("audit")).where("request_id <> 'tick'")
    return flat_audit(rows).drop("latency_ms")


def audit_by_decision(spark, folder):
    return rollups.by_decision(audit(spark, folder)).select(
        F.col("day").cast("string").alias("day"), "stage", F.col("status_code").cast("bigint").alias("status_code"),
        "n", F.col("level").cast("bigint").alias("level"))


def audit_by_user(spark, folder):
    return rollups.by_user(audit(spark, folder))


def audit_by_label(spark, folder):
    return rollups.by_label(audit(spark, folder))


def audit_denied_share(spark, folder):
    return rollups.denied_share(audit(spark, folder)).withColumn("hour", F.unix_seconds("hour"))


def stream_denied_share(spark, folder):
    """The same from a stream of audit rows. A tenth of them come when their hours are closed and are counted apart."""
    path, target = run_folder(spark, "audit"), run_folder(spark, "shares")
    rows = written(audit(spark, folder), "audit-rows")
    late = F.pmod(F.xxhash64("request_id"), F.lit(10)) == 0
    given = {"ts": F.col("last") + F.expr("INTERVAL 10 DAYS"), "jwt_valid": F.lit(True)}
    tick = rows.agg(F.max("ts").alias("last")).select(*[  # moves the watermark on, as later traffic would
        given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    for n, batch in enumerate((rows.where(~late), tick, rows.where(late))):
        audit_store.write_audit(batch, path, n)
        finish(rollup_stream.hourly_shares(rollup_stream.arriving_audit(spark, path), f"{target}/rows", f"{target}/state"))
    shares = rollup_stream.read_shares(spark, f"{target}/rows")
    found = rollup_stream.amended(audit_store.read_audit_rows(spark, path), shares)
    return found.withColumn("hour", F.unix_seconds("hour"))


def audit_latency(spark, folder):
    return rollups.latency(audit(spark, folder))


def audit_latency_merged(spark, folder):
    """Sketches of three batches of the audit merged by stage, against exact ranks and numbers of users."""
    store = daily_sketches.sketch_store(spark, run_folder(spark, "sketches"))
    rows = written(audit(spark, folder), "audit-rows")
    for n in range(3):
        daily_sketches.add_batch(store, n, rows.where(F.pmod(F.xxhash64("request_id"), F.lit(3)) == n))
    marks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = daily_sketches.answers(daily_sketches.merged(store.read("days"), "stage"), tuple(marks.values()))
    timed = rows.select(F.coalesce("terminating_stage", F.lit("none")).alias("stage"), "latency_ms", "user_id")
    ranks = timed.join(found.select("stage", *marks), "stage").groupBy("stage").agg(
        F.count("latency_ms").alias("timed"), F.count_distinct("user_id").alias("exact"),
        *[F.count_if(F.col("latency_ms") < F.col(p)).alias(f"below_{p}") for p in marks],
        *[F.count_if(F.col("latency_ms") <= F.col(p)).alias(f"upto_{p}") for p in marks])
    bound = daily_sketches.RANK_BOUND
    near = [((F.col(f"below_{p}") / F.col("timed") <= mark + bound) & (F.col(f"upto_{p}") / F.col("timed") >= mark - bound)).alias(f"{p}_near")
            for p, mark in marks.items()]
    users = F.abs(F.col("users") - F.col("exact")) <= F.col("exact") * daily_sketches.USERS_BOUND
    return found.join(ranks, "stage").select("stage", "n", "exact", users.alias("users_near"), *near)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    conv_requests, validate_requests, quarantined_requests, request_parse, stored_requests,
    signature_file, pattern_count, scan_distinct, scan_join, scan_offsets, scan_offsets_cut,
    scan_delta, scan_names, scan_hit_counts, scan_blocked,
    scan_clean, ingress_scan, message_scan, egress_scan,
    pii_vault, vault_opened, pii_planted, pii_counts, pii_redacted, pii_restore, page_pii_counts, message_vault, message_redacted,
    entity_spans, entity_spans_join, entity_vault, entity_restored, span_vault,
    rate_outcomes, rate_outcomes_pieces, rate_outcomes_single, stream_rate_outcomes, auth_outcomes, metered_events,
    provider_body_block, provider_body_choice, model_resolution, echo_responses, parse_block, parse_choice,
    response_join, request_decisions, audit_rows, audit_rows_large_dictionary, response_projection, rejection_projection, source_audit,
    source_audit_split, redacted_prompts, audit_outcomes, audit_upsert, audit_compacted, echo_audit,
    stream_audit, stream_vault, stream_responses, stream_quarantine, stream_repeated_requests, stream_late_responses, audit_by_decision, audit_by_user, audit_by_label, audit_denied_share,
    stream_denied_share, audit_latency, audit_latency_merged)}
