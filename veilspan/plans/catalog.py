"""Queries over the given tables, one per operator.

Each takes ``(spark, sf_dir)``, reads whole tables and returns a lazy DataFrame of scalar
columns: maps are exploded or joined, times are millisecond texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions import predicates as P
from veilspan.functions import values as V
from veilspan.operators import (checks, delivery, ingest, lifecycle, observe, policy, redact,
                                sampling, spans, staging)
from veilspan.plans.persist import open_ledger, persist_batch
from veilspan.session import ensure_conf, shared_dir
from veilspan.sources import otlp, tables, topic
from veilspan.sources import testdata as data
from veilspan.sources.strict_json import strict_json_ok

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOOKUP_TENANT, LOOKUP_TRACE = "tenant-1", "trace-5-19737"
MODULO = 10
AS_OF = "2024-02-01 00:00:00"


def query(run: Query) -> Query:
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(ensure_conf(spark), sf_dir)

    QUERIES[run.__name__] = wrapped
    return run


def _ms(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: V.format_ts_millis(c) for c in columns})


# --- read side ----------------------------------------------------------------------------
@query
def usage_metrics(spark, sf):
    rows = data.spans(spark, sf)
    return spans.usage_metrics(rows, data.newest(rows), tenants=data.tenants(spark))


@query
def usage_metrics_tenant(spark, sf):
    rows = data.spans(spark, sf)
    return spans.usage_metrics(rows, data.newest(rows), tenant="tenant-2",
                               tenants=data.tenants(spark))


@query
def error_rate(spark, sf):
    rows = data.spans(spark, sf)
    return spans.error_rate(spans.usage_metrics(
        rows, data.newest(rows), tenants=data.tenants(spark))).select(
        "tenant_id", "span_count", "error_count", "error_rate")


@query
def service_dependencies(spark, sf):
    rows = data.spans(spark, sf)
    return spans.service_dependencies(rows, data.newest(rows))


@query
def dedupe_latest(spark, sf):
    return _ms(spans.dedupe_latest(data.spans(spark, sf)).select(
        "tenant_id", "event_key", "signal_type", "trace_id", "ingested_at"), "ingested_at")


@query
def last_hours(spark, sf):
    rows = data.spans(spark, sf)
    return spans.last_hours(rows, data.newest(rows)).groupBy("tenant_id", "signal_type").agg(
        F.count(F.lit(1)).alias("rows_in_window"))


@query
def trace_lookup(spark, sf):
    rows = spans.trace_lookup(data.spans(spark, sf), LOOKUP_TENANT, LOOKUP_TRACE)
    return _ms(rows.select(
        "event_key", "event_id", "signal_type", "trace_id", "span_id", "parent_span_id", "name",
        V.attr("attributes", "service.name").alias("service"), "policy_version",
        F.array_join("redacted_paths", ",").alias("redacted_paths"), "ingested_at"),
        "ingested_at")


@query
def trace_lookup_many(spark, sf):
    rows = data.spans(spark, sf)
    failing = rows.filter(P.is_error("attributes")).select("tenant_id", "trace_id").distinct()
    return _ms(spans.trace_lookup_many(rows, failing).select(
        "tenant_id", "trace_id", "event_key", "name", "ingested_at"), "ingested_at")


@query
def trace_timeline(spark, sf):
    rows = spans.trace_timeline(spans.dedupe_latest(data.spans(spark, sf)))
    return _ms(rows, "ingested_at")


@query
def audit_timeline(spark, sf):
    rows = spans.audit_timeline(data.audit(spark, sf), "tenant-1")
    return _ms(rows.select("id", "action", F.col("safe_metadata")["k"].alias("k"), "created_at"),
               "created_at")


def _decisions(spark, sf) -> DataFrame:
    batch = data.staging_batch(spark, sf)
    decided = sampling.decide_traces(batch, F.col("envelope.event.attributes"), MODULO)
    seen = batch.groupBy(*sampling.TRACE).agg(F.max("received_at").alias("created_at"))
    return decided.join(seen, list(sampling.TRACE))


@query
def sampling_decisions(spark, sf):
    return _ms(spans.sampling_decisions(_decisions(spark, sf), None), "created_at")


@query
def append_audit(spark, sf):
    old = data.audit(spark, sf)
    news = data.table(spark, sf, "conversations").select(
        F.concat(F.lit("tenant-"), (F.col("conv_id") % 4).cast("string")).alias("tenant_id"),
        F.concat_ws(":", F.lit("turn"), F.lpad(F.col("conv_id").cast("string"), 9, "0"),
                    F.lpad(F.col("turn").cast("string"), 4, "0")).alias("action"),
        F.create_map(F.lit("k"), F.col("role")).alias("safe_metadata"),
        F.to_timestamp(F.lit(AS_OF)).alias("created_at"))
    return _ms(lifecycle.append_audit(old, news).select(
        "id", "tenant_id", "action", F.col("safe_metadata")["k"].alias("k"), "created_at"),
        "created_at")


# --- redaction and policies ---------------------------------------------------------------
@query
def sanitize_documents(spark, sf):
    return redact.mask_text(data.table(spark, sf, "documents"), "text", data.TEXT_RULES).select(
        "doc_id", "text")


def _judged_logs(spark, sf) -> DataFrame:
    return ingest.accept_requests(
        data.log_requests(spark, sf), data.api_keys(spark),
        policy.active_policies(data.policies(spark)), "deploy-1", data.TEXT_RULES)


def _judged_traces(spark, sf) -> DataFrame:
    return ingest.accept_requests(
        data.trace_requests(spark, sf), data.api_keys(spark),
        policy.active_policies(data.policies(spark)), "deploy-1", ["@example"])


@query
def sanitize_conversations(spark, sf):
    bag = F.col("envelope.event.attributes")
    return ingest.envelopes(_judged_logs(spark, sf)).select(
        "request_id", "event_key", V.attr(bag, "log.severity").alias("severity"),
        V.attr(bag, "log.body").alias("body"),
        F.col("envelope.policy.policyVersion").alias("policy_version"))


@query
def redaction_receipts(spark, sf):
    return ingest.envelopes(_judged_traces(spark, sf)).select(
        "request_id", F.col("envelope.policy.policyVersion").alias("policy_version"),
        F.array_join("envelope.policy.redactedPaths", ",").alias("redacted_paths"))


@query
def sanitize_attributes(spark, sf):
    bag = F.create_map(
        F.lit("doc.text"), F.col("text"), F.concat(F.col("source"), F.lit("_Secret")),
        F.col("lang"), F.lit("source"), F.col("source"))
    rows = data.table(spark, sf, "documents").select("doc_id", bag.alias("attributes"))
    return (redact.sanitize_attributes(rows, data.TEXT_RULES, "docs-1")
            .select("doc_id", "policy.policyVersion",
                    F.size("policy.redactedPaths").alias("redacted"),
                    F.explode("attributes").alias("attr_key", "attr_value"))
            .withColumnRenamed("policyVersion", "policy_version"))


@query
def sensitive_keys(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (
        "_API_KEY", ".Cookie", ".passwd", "_Tokenizer", ".http_Authorization", ".name")]),
        (F.get_json_object("props", "$.k").cast("int") % 6 + 1))
    rows = data.table(spark, sf, "events").select(F.create_map(
        F.col("event_type"), F.lit("x"), F.concat("event_type", suffix), F.lit("y"))
        .alias("attributes"))
    return redact.sensitive_keys(rows)


def _event_policies(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return data.table(spark, sf, "events").select(
        F.concat(F.lit("tenant-u"), F.col("user_id").cast("string")).alias("tenant_id"),
        F.concat(F.lit("v"), (k % 5).cast("string")).alias("version"),
        F.when(k % 37 == 0, F.lit("(")).when(k % 41 == 1, F.lit("((a{10}){10}){11}"))
        .when(k % 41 == 2, F.lit("(?U)x{2,}[^\\p{Any}]?")).otherwise(F.concat("event_type", F.lit("-[0-9]{"), (k % 3 + 1).cast("string"), F.lit("}\\b")))
        .alias("expression"), F.col("ts").cast("timestamp").alias("created_at"))


@query
def active_policies(spark, sf):
    return policy.active_policies(_event_policies(spark, sf)).select(
        "tenant_id", "policy_version", F.array_join("expressions", " ").alias("expressions"),
        "policy_ok")


@query
def attach_policy(spark, sf):
    users = data.table(spark, sf, "events").select(
        F.concat(F.lit("tenant-u"), (F.col("user_id") + F.col("event_id") % 2).cast("string"))
        .alias("tenant_id"), "event_id")
    active = policy.active_policies(_event_policies(spark, sf))
    return policy.attach_policy(users, active, "deploy-1", ["@example"]).select(
        "event_id", "policy_version", F.size("patterns").alias("patterns"), "policy_ok")


@query
def resolve_tenants(spark, sf):
    return policy.resolve_tenants(data.trace_requests(spark, sf), data.api_keys(spark)).select(
        "request_id", "tenant_id")


@query
def register_tenant_keys(spark, sf):
    new = data.table(spark, sf, "events").select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
        V.sha256_hex(F.concat(F.lit("key-tenant-"), (F.col("user_id") % 10).cast("string")))
        .alias("key_hash"))
    tenants, keys = policy.register_tenant_keys(data.tenants(spark), data.api_keys(spark), new,
                                                AS_OF)
    return (tenants.select(F.lit("tenant").alias("kind"), F.col("id").alias("tenant_id"),
                           F.lit("").alias("key_hash"), "created_at")
            .unionByName(keys.select(F.lit("key").alias("kind"), "tenant_id", "key_hash",
                                     "created_at"))
            .withColumn("created_at", V.format_ts_millis("created_at")))


# --- ingest -------------------------------------------------------------------------------
@query
def parse_otlp_traces(spark, sf):
    rows = otlp.parse_otlp_traces(data.trace_requests(spark, sf, broken=False))
    return rows.select("request_id", "ordinal", F.col("event.eventId").alias("event_id"),
                       F.col("event.name").alias("name"),
                       F.explode("event.attributes").alias("attr_key", "attr_value"))


@query
def parse_otlp_logs(spark, sf):
    rows = otlp.parse_otlp_logs(data.log_requests(spark, sf))
    return rows.select("request_id", "ordinal", F.col("event.traceId").alias("trace_id"),
                       F.explode("event.attributes").alias("attr_key", "attr_value"))


@query
def parse_events(spark, sf):
    requests = data.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.to_json(F.struct(
            F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("eventId"),
            F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("traceId"),
            F.lit("s").alias("spanId"), F.col("event_type").alias("name"),
            F.create_map(F.lit("a.b"), F.col("props")).alias("attributes"))).alias("body"))
    e = F.col("event")
    return otlp.parse_events(requests).select(
        "request_id", e["eventId"].alias("event_id"), e["signal"].alias("signal"),
        e["traceId"].alias("trace_id"), e["name"].alias("name"),
        V.attr(e["attributes"], "a.b").alias("props"),
        V.tail_trace_id(e["traceId"], e["eventId"]).alias("tail_trace_id"))


@query
def log_event_ids(spark, sf):
    rows = otlp.parse_otlp_logs(data.log_requests(spark, sf))
    return rows.select("request_id", F.col("event.eventId").alias("event_id"))


@query
def strict_json(spark, sf):
    return strict_json_ok(data.trace_requests(spark, sf)).select("request_id", "strict_ok")


@query
def request_outcome(spark, sf):
    return ingest.request_outcome(_judged_traces(spark, sf))


def _judged_batches(spark, sf) -> DataFrame:
    return ingest.accept_requests(data.request_batches(spark, sf), data.api_keys(spark),
                                  policy.active_policies(data.broken_policies(spark)), "deploy-1")


@query
def request_outcome_batches(spark, sf):
    return ingest.request_outcome(_judged_batches(spark, sf))


@query
def staged_batches(spark, sf):
    """Rows that each request of several spans adds; a repeated request adds none."""
    none = [spark.createDataFrame([], schema) for schema in (schemas.TAIL_TRACES, schemas.TAIL_EVENT_KEYS)]
    step = staging.stage(ingest.envelopes(_judged_batches(spark, sf)), *none, cut=tables.cut_in(shared_dir(spark, "batches")))
    return step.events.groupBy("tenant_id", "request_id").agg(
        F.count(F.lit(1)).alias("staged"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query
def log_batch_ids(spark, sf):
    rows = otlp.parse_otlp_logs(data.log_batches(spark, sf))
    return rows.select("request_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("event.eventId").alias("event_id"))


@query
def event_validity(spark, sf):
    d = F.col("doc_id")
    event = F.struct(
        F.repeat(F.lit("é"), (d % 140).cast("int")).alias("eventId"),
        F.element_at(F.array(F.lit("log"), F.lit("trace"), F.lit(""), F.lit("metric")),
                     (d % 4 + 1).cast("int")).alias("signal"),
        F.when(d % 9 == 0, "").otherwise(F.col("source")).alias("traceId"),
        F.col("source").alias("spanId"), F.lit("").alias("parentSpanId"),
        F.col("lang").alias("name"), F.create_map(F.lit("text"), F.col("text")).alias("attributes"))
    return data.table(spark, sf, "documents").select(
        "doc_id", P.valid_event(event).alias("valid"),
        P.body_within_limit("text").alias("body_ok"))


@query
def single_tenant_check(spark, sf):
    batch = data.staging_batch(spark, sf).withColumn(
        "request_id", F.concat_ws("-", F.lit("r"), (F.col("source_event") / 3).cast("bigint")))
    return ingest.single_tenant_check(batch)


# --- sampling -----------------------------------------------------------------------------
@query
def fnv_sample(spark, sf):
    ids = data.spans(spark, sf, redelivered=False).select("trace_id").distinct()
    return ids.select("trace_id", V.fnv1a_32("trace_id").alias("hash"),
                      V.hash_sampled("trace_id", MODULO).alias("sampled"))


@query
def sample_traces(spark, sf):
    return sampling.sample_traces(data.spans(spark, sf, redelivered=False), MODULO, 100)


@query
def trace_flags(spark, sf):
    return sampling.trace_flags(data.spans(spark, sf, redelivered=False))


@query
def decide_traces(spark, sf):
    return sampling.decide_traces(data.spans(spark, sf, redelivered=False), modulo=MODULO)


@query
def decision_counts(spark, sf):
    return sampling.decision_counts(
        sampling.decide_traces(data.spans(spark, sf, redelivered=False), modulo=MODULO))


# --- staging ------------------------------------------------------------------------------
def _noon(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What arrived before noon of its day is state, the rest is the batch."""
    early = F.hour("received_at") < 12
    return batch.filter(early), batch.filter(~early)


def _traces(rows: DataFrame) -> DataFrame:
    """Trace table of staged rows: traces with a failed event are decided."""
    flags = sampling.trace_flags(rows, F.col("envelope.event.attributes"))
    none = F.lit(None)
    return (staging.trace_state(rows).join(flags.select(*sampling.TRACE, "has_error"),
                                           list(sampling.TRACE))
            .select(*sampling.TRACE, "first_seen", "last_seen", "generation", "span_count",
                    F.when(F.col("has_error"), schemas.RETAINED_ERROR)
                    .otherwise(none.cast("string")).alias("decision"),
                    F.when(F.col("has_error"), F.col("last_seen"))
                    .otherwise(none.cast("timestamp")).alias("decided_at")))


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select("event_key", *sampling.TRACE, F.col("received_at").alias("created_at"))


@query
def new_event_keys(spark, sf):
    batch = data.staging_batch(spark, sf)
    early, _ = _noon(batch)
    again = batch.withColumn("request_id", F.concat(F.col("request_id"), F.lit("-again")))
    return staging.new_event_keys(batch.unionByName(again), _keys(early)).select(
        "tenant_id", "event_key", "request_id")


@query
def late_events(spark, sf):
    early, late = _noon(data.staging_batch(spark, sf))
    return staging.late_events(late, _traces(early)).select("tenant_id", "trace_id", "event_key")


def _by_kind(batch: DataFrame) -> DataFrame:
    """Requests of several events: one per trace and event type, arriving with the first."""
    kind = F.col("envelope.event.name")
    request = F.concat_ws("/", "trace_id", kind)
    first = batch.groupBy("trace_id", kind.alias("kind")).agg(
        F.min("received_at").alias("at"))
    return (batch.withColumn("kind", kind).join(first, ["trace_id", "kind"])
            .withColumn("request_id", request).withColumn("received_at", F.col("at"))
            .drop("kind", "at"))


@query
def span_limit(spark, sf):
    batch = _by_kind(data.staging_batch(spark, sf))
    empty = spark.createDataFrame([], schemas.TAIL_TRACES)
    return staging.enforce_span_limit(batch, empty, cap=3)


@query
def stage(spark, sf):
    early, late = _noon(data.staging_batch(spark, sf))
    step = staging.stage(late, _traces(early), _keys(early), span_cap=4,
                         cut=tables.cut_in(shared_dir(spark, "stage")))
    return (step.events.select("request_id", F.lit("staged").alias("result"))
            .unionByName(step.refused.select("request_id", F.col("reason").alias("result"))))


@query
def trace_state(spark, sf):
    return _ms(staging.trace_state(data.staging_batch(spark, sf)), "first_seen", "last_seen")


@query
def upsert_traces(spark, sf):
    early, late = _noon(data.staging_batch(spark, sf))
    return _ms(staging.upsert_traces(_traces(early), staging.trace_state(late)).select(
        *sampling.TRACE, "first_seen", "last_seen", "generation", "span_count"),
        "first_seen", "last_seen")


@query
def open_trace_counts(spark, sf):
    return staging.open_trace_counts(_traces(data.staging_batch(spark, sf)))


@query
def buffer_counts(spark, sf):
    return staging.buffer_counts(staging.to_buffers(data.staging_batch(spark, sf)))


@query
def evict_pressure(spark, sf):
    batch = data.staging_batch(spark, sf)
    return _ms(staging.evict_pressure(_traces(batch), staging.to_buffers(batch), AS_OF, cap=50),
               "created_at")


@query
def evict_span_limit(spark, sf):
    traces = _traces(data.staging_batch(spark, sf))
    return _ms(staging.evict_span_limit(traces, AS_OF, cap=3), "created_at")


@query
def ready_traces(spark, sf):
    traces = _traces(data.staging_batch(spark, sf))
    newest = data.newest(traces, "last_seen")
    return _ms(staging.ready_traces(traces, newest, 21600, limit=None), "last_seen")


@query
def ready_traces_claim(spark, sf):
    traces = _traces(data.staging_batch(spark, sf))
    return _ms(staging.ready_traces(traces, AS_OF), "last_seen")


@query
def load_trace(spark, sf):
    batch = data.staging_batch(spark, sf)
    ready = staging.ready_traces(_traces(batch), AS_OF, limit=None)
    return _ms(staging.load_trace(staging.to_buffers(batch), ready).select(
        *sampling.TRACE, "event_key", "generation", "received_at"), "received_at")


def _verdicts(batch: DataFrame, traces: DataFrame) -> DataFrame:
    decided = sampling.decide_traces(batch, F.col("envelope.event.attributes"), MODULO)
    # Taken from the trace as it was when it held two events.
    return decided.withColumn("generation", F.lit(3).cast("bigint")).withColumn(
        "created_at", V.as_ts(AS_OF))


@query
def apply_decisions(spark, sf):
    batch = data.staging_batch(spark, sf)
    traces = _traces(batch)
    return _ms(staging.apply_decisions(traces, _verdicts(batch, traces)).select(
        *sampling.TRACE, "generation", "span_count", "decision", "decided_at"), "decided_at")


@query
def purge_buffers(spark, sf):
    batch = data.staging_batch(spark, sf)
    decided = sampling.decide_traces(batch, F.col("envelope.event.attributes"), MODULO)
    return staging.purge_buffers(staging.to_buffers(batch), decided.filter("retained")).select(
        *sampling.TRACE, "event_key")


@query
def enqueue_retained(spark, sf):
    batch = data.staging_batch(spark, sf)
    decided = sampling.decide_traces(batch, F.col("envelope.event.attributes"), MODULO)
    waiting = data.outbox(spark, sf).filter(F.col("published_at").isNull())
    return _ms(staging.enqueue_retained(staging.to_buffers(batch), decided, waiting, AS_OF).select(
        "event_key", "tenant_id", "attempts", "created_at"), "created_at")


# --- delivery -----------------------------------------------------------------------------
@query
def pending_outbox(spark, sf):
    return _ms(delivery.pending_outbox(data.outbox(spark, sf)).select(
        "event_key", "tenant_id", "attempts", "created_at"), "created_at")


@query
def publish_outbox(spark, sf):
    """Send everything pending to a topic folder, then mark it published."""
    outbox = data.outbox(spark, sf)
    sent = delivery.pending_outbox(outbox, None)
    topic.write_topic(sent, f"{shared_dir(spark, 'topic')}/messages")
    return _ms(delivery.mark_published(outbox, sent, AS_OF).select(
        "event_key", "attempts", "published_at"), "published_at")


@query
def topic_round_trip(spark, sf):
    path = f"{shared_dir(spark, 'topic')}/messages"
    topic.write_topic(data.outbox(spark, sf), path)
    got = topic.decode_messages(topic.read_topic(spark, path))
    e = F.col("envelope.event")
    return got.select("tenant_id", "event_key", e["signal"].alias("signal"),
                      e["name"].alias("name"),
                      V.attr(e["attributes"], "peer.service").alias("peer"))


@query
def claim_deliveries(spark, sf):
    return _ms(delivery.claim_deliveries(
        data.staging_batch(spark, sf), data.ledger(spark, sf), AS_OF), "created_at", "updated_at")


@query
def mark_persisted(spark, sf):
    ledger = data.ledger(spark, sf)
    claims = delivery.claim_deliveries(data.staging_batch(spark, sf), ledger, AS_OF)
    return _ms(delivery.merge_ledger(ledger, delivery.mark_persisted(claims, AS_OF)),
               "created_at", "updated_at")


@query
def record_loss(spark, sf):
    ledger = data.ledger(spark, sf)
    lost = ledger.select("tenant_id", "event_key", F.lit("retries_exhausted").alias("error_class"))
    return _ms(delivery.record_loss(ledger, lost, AS_OF), "created_at", "updated_at")


@query
def persist(spark, sf):
    """All messages twice through persistence; the span table as read afterwards."""
    root = shared_dir(spark, "persist")
    store, path = open_ledger(spark, f"{root}/ledger"), f"{root}/spans"
    messages = topic.to_messages(data.outbox(spark, sf))
    persist_batch(store, messages.unionByName(messages), path, V.as_ts(AS_OF))
    persist_batch(store, messages, path, V.as_ts("2024-02-02 00:00:00"))
    rows = tables.scan_spans(spark, path)
    ledger = store.read("ledger_settled").select("event_key", "status", "attempts")
    return _ms(rows.join(ledger, "event_key").select(
        "tenant_id", "event_key", "signal_type", "service_name", "usage_error", "ingested_at",
        "status", "attempts"), "ingested_at")


@query
def span_table(spark, sf):
    """Write every delivered version, read the current ones."""
    path = f"{shared_dir(spark, 'spans')}/spans"
    tables.write_spans(data.spans(spark, sf), path)
    return _ms(tables.read_spans(spark, path).select(
        "tenant_id", "event_key", "parent_span_id", V.attr("attributes", "duration_ms")
        .cast("double").alias("duration_ms"), "ingested_at"), "ingested_at")


# --- lifecycle ----------------------------------------------------------------------------
@query
def retention_policies(spark, sf):
    customers = data.table(spark, sf, "customer")
    name = F.concat(F.lit("tenant-c"), F.col("c_custkey").cast("string"))
    tenants = customers.select(name.alias("id"))
    days = customers.filter(F.col("c_nationkey") % 3 != 0).select(
        name.alias("tenant_id"), (F.col("c_custkey") * 7 % 4000).cast("int")
        .alias("retention_days"))
    return lifecycle.retention_policies(tenants, days)


def _state_tables(spark, sf) -> dict[str, DataFrame]:
    batch = data.staging_batch(spark, sf)
    decisions = _decisions(spark, sf)
    return {"spans": data.spans(spark, sf), "tail_outbox": data.outbox(spark, sf),
            "tail_event_keys": _keys(batch), "tail_decisions": decisions,
            "tail_traces": _traces(batch), "tail_buffers": staging.to_buffers(batch),
            "delivery_ledger": data.ledger(spark, sf), "audit_events": data.audit(spark, sf)}


@query
def apply_retention(spark, sf):
    policies = lifecycle.retention_policies(data.tenants(spark), data.retention(spark))
    _, report = lifecycle.apply_retention(_state_tables(spark, sf), policies, AS_OF)
    return report


@query
def expire_spans(spark, sf):
    policies = lifecycle.retention_policies(data.tenants(spark), data.retention(spark))
    return _ms(lifecycle.expire_spans(data.spans(spark, sf), policies, AS_OF).select(
        "tenant_id", "event_key", "ingested_at"), "ingested_at")


@query
def delete_tenant(spark, sf):
    kept = lifecycle.delete_tenant(_state_tables(spark, sf), "tenant-1",
                                   lifecycle.DELETE_PHRASE, AS_OF)
    return checks.tail_row_census(kept)


@query
def tail_row_census(spark, sf):
    state = _state_tables(spark, sf)
    names = ("tail_traces", "tail_buffers", "tail_decisions", "tail_outbox", "tail_event_keys")
    return checks.tail_row_census({name: state[name] for name in names})


# --- observation and checks -----------------------------------------------------------------
@query
def http_outcomes(spark, sf):
    return observe.http_outcomes(data.http_requests(spark, sf))


@query
def request_rate(spark, sf):
    return _ms(observe.request_rate(data.http_requests(spark, sf)), "window_start").withColumns({
        "rate": F.round("rate", 6), "error_rate_5xx": F.round("error_rate_5xx", 6)})


@query
def latency_percentiles(spark, sf):
    rows = data.http_requests(spark, sf).withColumn("route", P.route_bucket("path"))
    return observe.latency_percentiles(rows, ["service", "route"], "latency_ms",
                                       labels_bounded=True)


@query
def run_summary(spark, sf):
    rows = data.http_requests(spark, sf).withColumn("accepted", F.col("code") == 200)
    return observe.run_summary(rows, ["service"]).withColumns({
        c: F.round(c, 6) for c in ("elapsed_millis", "achieved_per_second")})


LEAK_MARKERS = ("@example", 'token = "', "src", "no such marker")


@query
def leak_scan(spark, sf):
    docs = data.table(spark, sf, "documents")
    return checks.leak_scan({
        "documents": docs, "conversations": data.table(spark, sf, "conversations"),
        "masked_documents": redact.mask_text(docs, "text", data.TEXT_RULES).select(
            "doc_id", "text")}, LEAK_MARKERS)


@query
def bench_gates(spark, sf):
    per_user = data.table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("worst"),
        F.count_if(F.col("event_type") == "error").alias("bad"))

    def num(value: Column, name: str) -> Column:
        return value.cast("double").alias(name)

    n, user = F.col("n"), F.col("user_id")
    runs = per_user.select(
        F.col("user_id").alias("run_id"),
        F.when(user % 5 != 0, "2026-01-01T00:00:00Z").alias("startedAt"),
        F.lit("2026-01-01T00:10:00Z").alias("finishedAt"),
        num(4900 + n * 2, "targetPerSecond"), num(F.lit(600), "durationSeconds"),
        num(599950 + n, "elapsedMillis"),
        F.when(user % 7 == 0, F.lit(float("nan"))).otherwise(num(4940 + n, "x"))
        .alias("achievedPerSecond"),
        num(n, "sent"), num(n - F.col("bad") % 2, "accepted"), num(F.lit(0), "failed"),
        num(F.lit(1), "p50Millis"), num(F.lit(2), "p95Millis"), num(F.lit(3), "p99Millis"),
        F.when(user % 4 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("t"))).alias("traceSamples"))
    lookups = per_user.filter(user % 6 != 0).select(
        F.col("user_id").alias("run_id"), num(F.lit(1), "p50Millis"),
        num(F.col("worst") * 10, "p95Millis"), num(F.col("worst") * 11, "p99Millis"),
        (F.col("worst") * 10 <= 3000).alias("lookupPass"))
    return checks.bench_gates(runs, lookups)


@query
def error_class(spark, sf):
    stage_name = F.element_at(F.array(*[F.lit(x) for x in (
        "claim_tail_traces: timeout", "record_tail_decision: lost", "mark_tail_outbox: lease",
        "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = data.table(spark, sf, "events").select(
        P.error_class(stage_name, F.when(F.col("event_type") == "error", "40001"))
        .alias("error_class"))
    return rows.groupBy("error_class").agg(F.count(F.lit(1)).alias("failures"))


@query
def scalar_functions(spark, sf):
    v = F.col("value")
    return data.table(spark, sf, "events").select(
        "event_id", V.shortest_double(v * 100000).alias("shortest"),
        V.shortest_double(v / 1000000).alias("small"),
        V.int32_or_zero(F.concat(F.lit("+"), F.col("event_id").cast("string"))).alias("int32"),
        V.parse_double(F.concat(v.cast("string"), F.when(F.col("event_type") == "view", "d")
                                .otherwise(""))).alias("number"),
        P.valid_trace_id(F.concat(F.col("event_type"), F.when(
            F.col("event_type") == "click", "\n").otherwise("_1"))).alias("trace_id_ok"),
        F.array_join(V.split_nonempty(F.concat_ws(",", F.lit(" a "), F.col("event_type"),
                                                  F.lit(""), F.lit(" "))), "|").alias("parts"),
        F.col("props").alias("bag"),
        V.attributes_json(V.attributes_from_json("props")).alias("bag_again"))
