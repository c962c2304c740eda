"""One tail cycle: stage a micro-batch, decide, evict, enqueue, publish, commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan import schemas
from veilspan.functions.predicates import (HEALTHY_MODULO, MAX_OPEN_TRACES, MAX_TRACE_SPANS,
                                           SLOW_MS)
from veilspan.functions.values import as_ts
from veilspan.operators import delivery, sampling, staging
from veilspan.operators.ingest import ACCEPTED
from veilspan.sources.tables import DAY_TABLES, MERGE_EVERY, STATE_SCHEMAS, StateStore
from veilspan.sources.topic import write_topic

INBOX = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("code", T.IntegerType()), T.StructField("received_at", T.TimestampType()),
    T.StructField("pos", T.IntegerType()), T.StructField("event_key", T.StringType()),
    T.StructField("trace_id", T.StringType()), T.StructField("envelope", schemas.ENVELOPE)])
STAGED = T.StructType(INBOX.fields)
IDS = T.StructType([f for f in INBOX.fields if f.name not in ("code", "envelope")])
REFUSED = T.StructType([T.StructField("request_id", T.StringType()),
                        T.StructField("reason", T.StringType())])
REQUEST_IDS = T.StructType(REFUSED.fields[:1])
SEGMENTS = T.StructType([*IDS.fields, T.StructField("segment", T.IntegerType())])
LIVES = T.StructType([T.StructField(n, t) for n, t in (
    ("tenant_id", T.StringType()), ("trace_id", T.StringType()),
    ("first_seen", T.TimestampType()), ("closes_at", T.TimestampType()))])
EVICTIONS = T.StructType([*LIVES.fields[:2], T.StructField("evicted_at", T.TimestampType())])
TAIL_TABLES = {**STATE_SCHEMAS, "inbox": INBOX, "staged": STAGED, "refused": REFUSED,
               "outbox_batch": schemas.TAIL_OUTBOX, "candidates": IDS, "taken": IDS,
               "over_limit": REQUEST_IDS, "late": REQUEST_IDS, "late_in_time": REQUEST_IDS,
               "segments": SEGMENTS, "lives": LIVES, "evictions": EVICTIONS,
               "closed_before": schemas.TAIL_TRACES}


@dataclass(frozen=True)
class TailConfig:
    quiet_seconds: float = 2.0
    modulo: int = HEALTHY_MODULO
    slow_ms: float = SLOW_MS
    open_cap: int = MAX_OPEN_TRACES
    span_cap: int = MAX_TRACE_SPANS
    keep_days: int = 30


def open_store(spark, root: str) -> StateStore:
    return StateStore(spark, root, TAIL_TABLES)


def tail_cycle(store: StateStore, inbox: DataFrame, topic: str,
               config: TailConfig = TailConfig(), as_of=None, epoch: int | None = None) -> None:
    """Run one cycle as the store's next version, over ``inbox_rows`` of a batch.

    ``epoch`` numbers the batches of a stream; one that is already taken in is skipped.  Each
    step that later steps build on is written to the store first and read back.  All state
    tables change together when the version is published.  Messages go to the topic before
    that, so a crash in between repeats them, and persistence drops the copies.

    Traces close at moments of their own, set by arrivals: after ``quiet_seconds`` without a new
    event, or when one opens beyond ``open_cap``.  ``as_of``, by default the newest arrival in the
    batch, only says up to when that has happened.  So batches that follow each other in time give the
    same decisions however the input is cut, and a repeated batch decides the same.

    A closed trace refuses late events for ``keep_days``.  Keys of open traces are those in the
    buffers; the key history is read only for the days on which closed traces that the batch mentions
    were open, and the closed traces only for the last ``keep_days``, so the files that a batch reads
    do not grow with the number of batches before it.
    """
    if epoch is not None and epoch <= store.epoch():
        return
    version = store.begin()
    store.write(version, "inbox", inbox, full=True)
    inbox = store.pending("inbox", version, full=True)
    batch = inbox.filter(F.col("code") == ACCEPTED)
    newest, day, last_day = inbox.agg(
        F.unix_micros(F.max("received_at")),
        F.date_sub(F.to_date(F.min("received_at")), config.keep_days + 1),
        F.date_sub(F.to_date(F.max("received_at")), 1)).first()
    if as_of is None:
        if newest is None:  # an empty batch has no time of its own and changes nothing
            store.publish(version, epoch)
            return
        as_of = F.timestamp_micros(F.lit(newest))
    as_of = as_ts(as_of)

    traces, buffers = store.read("traces_open"), store.read("tail_buffers")

    def cut(name: str, rows: DataFrame) -> DataFrame:
        store.write(version, name, rows, full=True)
        return store.pending(name, version, full=True).select(*rows.columns)

    closed = cut("closed_before", store.read_days("traces_closed", first=day).join(
        batch.select(*staging.TRACE).distinct(), list(staging.TRACE), "left_semi"))
    opened, ended = closed.agg(F.to_date(F.min("first_seen")), F.to_date(F.max("decided_at"))).first()
    keys = buffers.select(*staging.KEY)
    if opened is not None:
        keys = keys.unionByName(store.read_days("tail_event_keys", opened, ended).select(*staging.KEY))
    step = staging.stage_in_time(batch, traces, keys, closed, config.quiet_seconds,
                                 config.open_cap, config.span_cap, config.keep_days, cut)
    store.write(version, "staged", step.events, full=True)
    store.write(version, "refused", step.refused, full=False)
    staged = store.pending("staged", version, full=True)
    store.write(version, "tail_event_keys", step.event_keys, full=False)
    traces = step.traces
    buffers = buffers.unionByName(staging.to_buffers(staged))

    evicted = staging.evicted_decisions(step.evicted, buffers)
    unevicted = traces.join(step.evicted.select(*staging.TRACE), list(staging.TRACE), "left_anti")
    ready = staging.ready_traces(unevicted, as_of, config.quiet_seconds, limit=None)
    decided = sampling.decide_traces(
        staging.load_trace(buffers, ready), F.col("envelope.event.attributes"),
        config.modulo, config.slow_ms)
    quiet = F.make_dt_interval(secs=F.lit(config.quiet_seconds))
    closed_at = ready.select(*staging.TRACE, (F.col("last_seen") + quiet).alias("created_at"))
    decisions = decided.join(closed_at, list(staging.TRACE)).unionByName(evicted)
    store.write(version, "tail_decisions", decisions, full=False)
    decisions = store.pending("tail_decisions", version, full=False)

    after = staging.apply_decisions(traces, decisions)
    store.write(version, "traces_open", after.filter(F.col("decided_at").isNull()), full=True)
    store.write(version, "traces_closed", after.filter(F.col("decided_at").isNotNull()),
                full=False)
    store.write(version, "tail_buffers", staging.purge_buffers(buffers, decisions), full=True)

    # A key is buffered once and leaves the buffers with the decision, so none of them is published yet.
    waiting = store.read("outbox_pending")
    fresh = staging.enqueue_retained(buffers, decisions, waiting, as_of)
    store.write(version, "outbox_batch", waiting.unionByName(fresh), full=True)
    publish_outbox(store, version, topic, as_of)
    store.publish(version, epoch)
    if version % MERGE_EVERY == MERGE_EVERY - 1 and last_day is not None:
        for name in DAY_TABLES:
            store.merge_days(name, last_day)


def publish_outbox(store: StateStore, version: int, topic: str, as_of) -> None:
    """Send all waiting rows of a version and record them as published only after that."""
    rows = delivery.pending_outbox(store.pending("outbox_batch", version, full=True), None)
    write_topic(rows, topic)
    store.write(version, "outbox_published",
                rows.withColumn("published_at", as_ts(as_of)), full=False)
    store.write(version, "outbox_pending",
                store.spark.createDataFrame([], schemas.TAIL_OUTBOX), full=True)


def outcomes(store: StateStore) -> DataFrame:
    """Response code per request of the newest cycle; refused at staging is 503."""
    inbox, refused = store.read("inbox"), store.read("refused")
    requests = inbox.groupBy("request_id").agg(F.first("tenant_id").alias("tenant_id"),
                                               F.max("code").alias("code"))
    late = refused.select("request_id").distinct().withColumn("refused", F.lit(True))
    return requests.join(late, "request_id", "left").select(
        "request_id", "tenant_id",
        F.when(F.col("refused"), 503).otherwise(F.col("code")).alias("code"))
