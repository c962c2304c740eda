"""Fixed table and message schemas.

The event and policy structs keep the wire names, so a message is decoded and encoded by
``from_json`` / ``to_json`` without renaming.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _TS, _B = (T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(),
                       T.BooleanType())
STRING_MAP = T.MapType(_S, _S, True)

# --- messages -------------------------------------------------------------------------
ANY_VALUE = _struct(("stringValue", _S), ("boolValue", _B), ("intValue", _S),
                    ("doubleValue", T.DoubleType()))
ATTRIBUTES = T.ArrayType(_struct(("key", _S), ("value", ANY_VALUE)))
RESOURCE = _struct(("attributes", ATTRIBUTES))
OTLP_SPAN = _struct(("traceId", _S), ("spanId", _S), ("parentSpanId", _S), ("name", _S),
                    ("attributes", ATTRIBUTES))
OTLP_TRACES = _struct(("resourceSpans", T.ArrayType(_struct(
    ("resource", RESOURCE),
    ("scopeSpans", T.ArrayType(_struct(("spans", T.ArrayType(OTLP_SPAN)))))))))
OTLP_LOG = _struct(("timeUnixNano", _S), ("traceId", _S), ("spanId", _S), ("severityText", _S),
                   ("body", ANY_VALUE), ("attributes", ATTRIBUTES))
OTLP_LOGS = _struct(("resourceLogs", T.ArrayType(_struct(
    ("resource", RESOURCE),
    ("scopeLogs", T.ArrayType(_struct(("logRecords", T.ArrayType(OTLP_LOG)))))))))
EVENT = _struct(("eventId", _S), ("signal", _S), ("traceId", _S), ("spanId", _S),
                ("parentSpanId", _S), ("name", _S), ("attributes", STRING_MAP))
RECEIPT = _struct(("policyVersion", _S), ("redactedPaths", T.ArrayType(_S)))
ENVELOPE = _struct(("tenantId", _S), ("event", EVENT), ("policy", RECEIPT), ("eventKey", _S))

# --- tables ---------------------------------------------------------------------------
REQUESTS = _struct(("request_id", _S), ("route", _S), ("method", _S), ("key_hash", _S),
                   ("received_at", _TS), ("body", _S))
SPANS = _struct(("tenant_id", _S), ("event_key", _S), ("event_id", _S), ("signal_type", _S),
                ("trace_id", _S), ("span_id", _S), ("parent_span_id", _S), ("name", _S),
                ("attributes", STRING_MAP), ("policy_version", _S),
                ("redacted_paths", T.ArrayType(_S)), ("ingested_at", _TS))
TENANTS = _struct(("id", _S), ("created_at", _TS))
API_KEYS = _struct(("tenant_id", _S), ("key_hash", _S), ("disabled_at", _TS), ("created_at", _TS))
POLICIES = _struct(("tenant_id", _S), ("version", _S), ("expression", _S), ("created_at", _TS))
AUDIT = _struct(("id", _L), ("tenant_id", _S), ("action", _S), ("safe_metadata", STRING_MAP),
                ("created_at", _TS))
RETENTION = _struct(("tenant_id", _S), ("retention_days", _I), ("updated_at", _TS))
LEDGER = _struct(("event_key", _S), ("tenant_id", _S), ("status", _S), ("attempts", _I),
                 ("last_error_class", _S), ("created_at", _TS), ("updated_at", _TS))
TAIL_TRACES = _struct(("tenant_id", _S), ("trace_id", _S), ("first_seen", _TS),
                      ("last_seen", _TS), ("generation", _L), ("span_count", _I),
                      ("decision", _S), ("decided_at", _TS))
TAIL_BUFFERS = _struct(("event_key", _S), ("tenant_id", _S), ("trace_id", _S),
                       ("envelope", ENVELOPE), ("received_at", _TS))
TAIL_EVENT_KEYS = _struct(("event_key", _S), ("tenant_id", _S), ("trace_id", _S),
                          ("created_at", _TS))
TAIL_DECISIONS = _struct(("tenant_id", _S), ("trace_id", _S), ("reason", _S), ("retained", _B),
                         ("span_count", _I), ("created_at", _TS))
TAIL_OUTBOX = _struct(("event_key", _S), ("tenant_id", _S), ("envelope", ENVELOPE),
                      ("attempts", _I), ("published_at", _TS), ("created_at", _TS))
TOPIC = _struct(("key", _S), ("value", _S))
HTTP_REQUESTS = _struct(("ts", _TS), ("service", _S), ("path", _S), ("code", _I),
                        ("latency_ms", T.DoubleType()))
BENCH_RUN = _struct(
    ("startedAt", _S), ("finishedAt", _S), ("targetPerSecond", T.DoubleType()),
    ("batchSize", T.DoubleType()), ("durationSeconds", T.DoubleType()),
    ("elapsedMillis", T.DoubleType()), ("achievedPerSecond", T.DoubleType()),
    ("sent", T.DoubleType()), ("accepted", T.DoubleType()), ("failed", T.DoubleType()),
    ("p50Millis", T.DoubleType()), ("p95Millis", T.DoubleType()), ("p99Millis", T.DoubleType()),
    ("goos", _S), ("goarch", _S), ("cpus", _I), ("traceSamples", T.ArrayType(_S)))
BENCH_LOOKUP = _struct(
    ("sampledTraces", T.DoubleType()), ("p50Millis", T.DoubleType()),
    ("p95Millis", T.DoubleType()), ("p99Millis", T.DoubleType()), ("lookupPass", _B))

# Tail-sampling verdicts.  Fixed values.
RETAINED_ERROR = "retained_error"
RETAINED_SLOW = "retained_slow"
RETAINED_SAMPLE = "retained_healthy_sample"
DROPPED_SAMPLE = "dropped_healthy_sample"
EVICTED_PRESSURE = "evicted_pressure"
EVICTED_SPAN_LIMIT = "evicted_span_limit"
