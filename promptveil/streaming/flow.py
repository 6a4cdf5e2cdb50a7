"""The request flow over arriving files, with everything it gives: audit, vault, answers, rejections, refused input.

Streams, each of which can be stopped and started again at any place:

``land`` stores arriving requests with their validity and identity, each request id once (a repetition within
``REPEATS`` of the first arrival takes no token and gets no second row; the raw token is not stored).

``decide`` meters what landed and takes it through the stages after the bucket. Only ids and times pass the keyed state;
the texts are joined back from the files that the micro-batch is made of, so a busy user's texts never meet in one
task. All tables of a micro-batch are committed together (``sources.batch_store``). With ``later=True`` the requests that
go to the provider are left waiting, their scrubbed texts and vault stored.

``answer`` joins waiting requests with responses that arrive as a stream: the first that comes within ``TIMEOUT`` of the
request's time answers it (of several in a micro-batch a good one counts before any other), and a request without one is
refused with 502 when the watermark has passed its time-out. Originals are put back from the stored vault. Responses are
stored first (``land_responses``); given to ``answer`` as ``landed_responses``, only ids and times pass the state of the join, and
bodies are read back from their files for requests that wait. A stream with bodies is taken too, and its state holds them.

What a micro-batch stores on the way is removed when it is committed.

A response can arrive before its request. One that is later than its time-out is not looked at. A request that reaches
``answer`` behind its watermark is left waiting; ``overdue`` closes such requests, so that every one gets its row. Rows
without request id are not compared with others. The stored tables of ``land`` and ``waiting`` and ``vault`` hold original values: guard the
folder as you guard the vault.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from promptveil.operators import auth, decisions, providers
from promptveil.operators.redact import vault_rows
from promptveil.plans import requests as plan
from promptveil.plans.requests import Dictionaries
from promptveil.schemas import AUDIT, REQUEST, RESPONSE, VAULT_ENTRY
from promptveil.session import passing, written
from promptveil.settings import Settings
from promptveil.sources.batch_store import BatchStore
from promptveil.sources.requests import CORRUPT, check_requests, with_corrupt
from promptveil.streaming.token_bucket import STATE_STORE, replay_stream

REPEATS = "1 day"
TIMEOUT = "60 seconds"
LATE = "10 minutes"
FILES = 1000

ANSWERS = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("model", T.StringType()),
                        T.StructField("content", T.StringType()), T.StructField("redactions", T.IntegerType())])
REJECTIONS = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("status_code", T.IntegerType()),
    T.StructField("detail", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType()))])
VAULT = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("idx", T.IntegerType()),
                      T.StructField("placeholder", T.StringType()), T.StructField("original", T.StringType())])
QUARANTINE = T.StructType([f for f in with_corrupt(REQUEST).fields if f.name != "authorization"] + [T.StructField("invalid_reason", T.StringType())])
ARRIVED_RESPONSE = T.StructType([*RESPONSE.fields, T.StructField("received", T.TimestampType())])
_CARRIED = T.StructType([T.StructField("ts", T.TimestampType()), *RESPONSE.fields])
_REPLY = T.StructType([*ARRIVED_RESPONSE.fields, T.StructField("reply", T.StringType())])
_LIMITED = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType()),
                         T.StructField("retry_after_header", T.IntegerType())])


def _checked(requests: DataFrame, settings: Settings) -> DataFrame:
    if CORRUPT not in requests.columns:
        requests = requests.withColumn(CORRUPT, F.lit(None).cast("string"))
    known = auth.authenticate(check_requests(requests), settings, F.col("ts"))
    return known.withColumn("model", providers.resolved_model(F.col("model"), settings.provider_model))


def _landed_schema(spark: SparkSession, settings: Settings) -> T.StructType:
    empty = _checked(spark.createDataFrame([], with_corrupt(REQUEST)), settings)
    names = [*QUARANTINE.names, "auth"]
    return T.StructType([*empty.select(*names).schema.fields, T.StructField("row_id", T.StringType())])


def land(requests: DataFrame, settings: Settings, path: str, checkpoint: str, repeats: str = REPEATS, **trigger) -> StreamingQuery:
    """Store the arriving ``requests`` below ``path``."""
    names = _landed_schema(requests.sparkSession, settings).names
    checked = _checked(requests, settings).withColumn("row_id", F.expr("uuid()")).select(*names)
    once = F.col("invalid_reason").isNull() & F.col("request_id").isNotNull()
    # the watermark is on the time of arrival, so no row is ever late
    first = (checked.where(once).withColumn("arrived__", F.current_timestamp()).withWatermark("arrived__", repeats)
             .dropDuplicatesWithinWatermark(["request_id"]).drop("arrived__"))
    return (first.unionByName(checked.where(~once)).writeStream.format("parquet").option("path", f"{path}/arrived")
            .option("compression", "zstd").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _arrived(spark: SparkSession, settings: Settings, path: str, files: int) -> DataFrame:
    return (spark.readStream.schema(_landed_schema(spark, settings)).option("maxFilesPerTrigger", files).parquet(f"{path}/arrived")
            .select("*", F.col("_metadata.file_path").alias("file")))


def land_responses(responses: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store the arriving ``responses`` (request_id, http_status, body, received) below ``path``."""
    return (responses.withColumn("reply", F.expr("uuid()")).select(*_REPLY.names).writeStream.format("parquet")
            .option("path", f"{path}/replies").option("compression", "zstd").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def landed_responses(spark: SparkSession, path: str) -> DataFrame:
    """The stream of what ``land_responses`` has stored, its bodies by reference."""
    return spark.readStream.schema(_REPLY).parquet(f"{path}/replies").select(
        "request_id", "http_status", "received", "reply", F.col("_metadata.file_path").alias("file"))


_TAKES = "invalid_reason IS NULL AND auth.ok"


def decided_store(spark: SparkSession, settings: Settings, path: str) -> BatchStore:
    """What ``decide`` has committed."""
    waiting = [f for f in _landed_schema(spark, settings).fields if f.name not in (CORRUPT, "invalid_reason", "row_id")]
    more = [*_LIMITED.fields, T.StructField("latency_ms", T.DoubleType()), T.StructField("ingress_hits", T.IntegerType()),
            T.StructField("scrubbed_texts", T.ArrayType(T.StringType())),
            T.StructField("vault", T.ArrayType(T._parse_datatype_string(VAULT_ENTRY)))]
    return BatchStore(spark, f"{path}/decided", {"audit": AUDIT, "responses": ANSWERS, "rejections": REJECTIONS, "vault": VAULT,
                                                 "quarantine": QUARANTINE, "waiting": T.StructType([*waiting, *more])})


def answered_store(spark: SparkSession, path: str) -> BatchStore:
    """What ``answer`` has committed."""
    return BatchStore(spark, f"{path}/answered", {"audit": AUDIT, "responses": ANSWERS, "rejections": REJECTIONS, "carried": _CARRIED})


def _outputs(decided: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    return {"audit": plan.audit(decided, settings), "responses": decisions.responses_out(decided),
            "rejections": decisions.rejections_out(decided)}


def decide(spark: SparkSession, words: Dictionaries, settings: Settings, path: str, checkpoint: str, responses: DataFrame | None = None,
           later: bool = False, files: int = FILES, **trigger) -> StreamingQuery:
    """Meter and decide what has landed below ``path``, ``files`` files at a time."""
    store = decided_store(spark, settings, path)
    schema = _landed_schema(spark, settings)
    narrow = _arrived(spark, settings, path, files).select(
        "row_id", "request_id", F.col("auth.user_id").alias("user_id"), "ts", "file", F.expr(_TAKES).alias("takes"))
    metered = replay_stream(narrow.where("takes"), settings.rate_capacity, settings.rate_refill_per_sec, event_id="request_id",
                            carry=("row_id", "file")).select("row_id", "file", *_LIMITED.names)
    others = narrow.where("NOT takes").select("row_id", "file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _LIMITED])

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not store.has(batch_id):
            with passing(spark):
                commit_new(batch, batch_id)

    def commit_new(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        outcome = written(batch, "outcomes")
        names = [r["file"] for r in outcome.select("file").distinct().collect()]  # ``files`` of them at most
        if not names:
            return
        rows = session.read.schema(schema).parquet(*names)
        valid = rows.where("invalid_reason IS NULL").drop("invalid_reason", CORRUPT)
        limited = valid.join(outcome.drop("file"), "row_id").drop("row_id").withColumn("latency_ms", F.lit(None).cast("double"))
        none = session.createDataFrame([], store.tables["waiting"])
        if later:
            waits = F.col("scrubbed_texts").isNotNull()
            scrubbed = written(plan.scanned_and_scrubbed(limited, words).withColumn("messages", F.when(waits, F.col("messages"))), "scrubbed")
            waiting, vault = scrubbed.where(waits), vault_rows(scrubbed.where(waits), "request_id")
            decided = plan.stored(decisions.decide(scrubbed.where(~waits).drop("messages").withColumns({
                "response_text": F.lit(None).cast("string"), "proxy_detail": F.lit(None).cast("string"),
                "egress_hits": F.lit(0), "restored_text": F.lit(None).cast("string")})))
        else:
            decided = plan.stored(plan.decided_from(limited, words, settings, responses).drop("messages"))
            waiting, vault = none, vault_rows(decided, "request_id")
        store.commit(batch_id, {**_outputs(decided, settings), "vault": vault, "waiting": waiting,
                                "quarantine": rows.where("invalid_reason IS NOT NULL")})

    return (metered.unionByName(others).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def answer(spark: SparkSession, responses: DataFrame, words: Dictionaries, settings: Settings, path: str, checkpoint: str,
           timeout: str = TIMEOUT, late: str = LATE, early: str = "0 seconds", files: int = FILES, **trigger) -> StreamingQuery:
    """Answer the waiting requests below ``path`` from a stream of (request_id, http_status, body, received), or from
    ``landed_responses``. Rows later than the watermark by ``late`` don't count; a response may be dated ``early`` before its
    request."""
    before, store = decided_store(spark, settings, path), answered_store(spark, path)
    asked = (_arrived(spark, settings, path, files).where(_TAKES).select("request_id", "ts").withWatermark("ts", late))
    given = ["body"] if "body" in responses.columns else ["reply", "file"]
    came = responses.select(F.col("request_id").alias("of"), "http_status", *given, "received").withWatermark("received", late)
    # one state store for each partition in place of four, whose files are laid out ahead; a stream begun with others keeps them
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    within = F.expr(f"of = request_id AND received >= ts - INTERVAL {early} AND received <= ts + INTERVAL {timeout}")
    joined = asked.join(came, within, "leftOuter").select("ts", "request_id", "http_status", *given)

    def bodies(todo: DataFrame) -> DataFrame:
        """``todo`` with the bodies that it refers to."""
        names = [r["file"] for r in todo.where("file IS NOT NULL").select("file").distinct().collect()]
        if not names:
            return todo.drop("reply", "file")
        stored = todo.sparkSession.read.schema(_REPLY).parquet(*names).select("reply", F.col("body").alias("stored__"))
        return todo.join(stored, "reply", "left").withColumn("body", F.coalesce("body", "stored__")).drop("reply", "file", "stored__")

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not store.has(batch_id):
            with passing(spark):
                commit_new(batch, batch_id)

    def commit_new(batch: DataFrame, batch_id: int) -> None:
        carried = store.read("carried").where(F.col("batch") == store.read("carried").agg(F.max("batch")).head()[0]).drop("batch")
        todo = written(batch.unionByName(carried, allowMissingColumns=True), "answers")
        if todo.isEmpty():
            return
        first, last = todo.agg(F.min("ts"), F.max("ts")).head()
        near = (F.col("ts") >= F.lit(first)) & (F.col("ts") <= F.lit(last))  # row groups of other times are not read
        done = store.read("audit").where(near).select("request_id")
        todo = todo.join(done, "request_id", "left_anti")
        for name in {"reply", "file"}.difference(todo.columns):
            todo = todo.withColumn(name, F.lit(None).cast("string"))
        todo = written(todo, "answers")
        ids = todo.select("request_id").distinct()
        rows = before.read("waiting").where(near).drop("batch", "messages").join(ids, "request_id", "left_semi")
        asking = bodies(todo.join(rows.select("request_id"), "request_id", "left_semi"))
        replied = providers.with_responses(rows, asking.where("http_status IS NOT NULL OR body IS NOT NULL").drop("ts"), settings.provider)
        decided = plan.stored(decisions.decide(plan.filtered(replied, words)))
        known = before.read("waiting").where(near).select("request_id").unionAll(before.read("audit").where(near).select("request_id"))
        left = bodies(todo.join(known, "request_id", "left_anti"))  # ``decide`` has not come to these yet
        store.commit(batch_id, {**_outputs(decided, settings), "carried": left})

    return (joined.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def overdue(spark: SparkSession, words: Dictionaries, settings: Settings, path: str, as_of: datetime, timeout: str = TIMEOUT) -> bool:
    """Refuse with 502 every waiting request of a time-out before ``as_of`` that has no answer, in a batch of its own
    (numbered below 0, by the time, so a repetition changes nothing)."""
    before, store = decided_store(spark, settings, path), answered_store(spark, path)
    old = before.read("waiting").where(F.col("ts") + F.expr(f"INTERVAL {timeout}") < F.lit(as_of)).drop("batch")
    rows = old.join(store.read("audit").select("request_id"), "request_id", "left_anti")
    replied = providers.with_responses(rows, spark.createDataFrame([], RESPONSE), settings.provider)
    decided = plan.stored(decisions.decide(plan.filtered(replied, words)))
    return store.commit(-int(as_of.timestamp()), {**_outputs(decided, settings), "carried": spark.createDataFrame([], _CARRIED)})
