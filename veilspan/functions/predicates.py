"""Row predicates: validity, error, slow, sensitive, and route labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.values import (ColumnLike, attr, col, int32_or_zero, let, parse_double,
                                       reuse, status_at_least, text)

# Limits in bytes or counts.  Fixed values.
MAX_BODY_BYTES = 1048576
MAX_ATTRIBUTES = 64
MAX_VALUE_BYTES = 4096
MAX_KEY_BYTES = 256
MAX_EVENT_ID_BYTES = 256
MAX_ID_BYTES = 128
MAX_NAME_BYTES = 512
MAX_EVENTS = 100
MAX_OPEN_TRACES = 1000
MAX_TRACE_SPANS = 100
MAX_EXPRESSION_BYTES = 512
SLOW_MS = 1000
HEALTHY_MODULO = 100

# Ingest routes and markers of sensitive keys.  Fixed values.
TRACES_ROUTE, LOGS_ROUTE, EVENT_ROUTE = "/v1/traces", "/v1/logs", "/v1/ingest"
SENSITIVE_MARKERS = ("authorization", "cookie", "api-key", "apikey", "token", "secret",
                     "password")


def _bytes(value: Column) -> Column:
    return F.octet_length(text(value))


@reuse
def valid_request(events: ColumnLike) -> Column:
    """Whether an event array holds 1 to 100 events, all of them valid."""
    return F.size(events).between(1, MAX_EVENTS) & F.forall(events, valid_event)


@reuse
def valid_event(event: ColumnLike) -> Column:
    """Every size and shape rule of one event struct; never NULL."""
    e = col(event)
    attributes = F.coalesce(e["attributes"], F.create_map().cast("map<string,string>"))
    signal = text(e["signal"])
    entries_ok = (
        F.forall(F.map_values(attributes), lambda v: _bytes(v) <= MAX_VALUE_BYTES)
        & F.forall(F.map_keys(attributes),
                   lambda k: F.octet_length(k).between(1, MAX_KEY_BYTES)))
    linked = (text(e["traceId"]) != "") & (text(e["spanId"]) != "")
    return (_bytes(e["eventId"]).between(1, MAX_EVENT_ID_BYTES)
            & _bytes(e["name"]).between(1, MAX_NAME_BYTES)
            & (_bytes(e["traceId"]) <= MAX_ID_BYTES)
            & (_bytes(e["spanId"]) <= MAX_ID_BYTES)
            & (_bytes(e["parentSpanId"]) <= MAX_ID_BYTES)
            & ((signal == "log") | (signal.isin("", "trace") & linked))
            & (F.size(attributes) <= MAX_ATTRIBUTES) & entries_ok)


def body_within_limit(body: ColumnLike) -> Column:
    return _bytes(col(body)) <= MAX_BODY_BYTES


def known_route(method: ColumnLike, route: ColumnLike) -> Column:
    return (text(method) == "POST") & text(route).isin(TRACES_ROUTE, LOGS_ROUTE, EVENT_ROUTE)


def valid_trace_id(value: ColumnLike) -> Column:
    return text(value).rlike(r"\A[A-Za-z0-9_-]{1,128}\z")


@reuse
def is_error(attributes: ColumnLike) -> Column:
    """The sampler's rule: status >= 500, or the flag."""
    return (status_at_least(attr(attributes, "http.status_code"), 500)
            | (attr(attributes, "error") == "true"))


@reuse
def is_usage_error(attributes: ColumnLike) -> Column:
    """The usage report's rule: a status outside 32 bits counts as 0 here."""
    return ((int32_or_zero(attr(attributes, "http.status_code")) >= 500)
            | (attr(attributes, "error") == "true"))


def is_slow(attributes: ColumnLike, threshold_ms: float = SLOW_MS) -> Column:
    nanos = parse_double(attr(attributes, "duration_ms")) * F.lit(1e6)
    return F.coalesce(nanos >= F.lit(float(threshold_ms) * 1e6), F.lit(False))


def is_sensitive_key(key: ColumnLike) -> Column:
    """Whether a marker occurs anywhere in the key, letter case and ``_`` / ``-`` aside."""
    return let(F.translate(F.lower(col(key)), "_", "-"),
               lambda name: reduce(lambda a, b: a | b,
                                   [name.contains(marker) for marker in SENSITIVE_MARKERS]))


def route_bucket(path: ColumnLike) -> Column:
    """A bounded label, so a metric never carries an id from the path."""
    p = text(path)
    return (F.when(p.startswith("/v1/traces/"), "trace")
            .when(p == "/v1/traces", "ingest")
            .when(p == "/v1/metrics", "metrics")
            .when(p == "/v1/dependencies", "dependencies")
            .when(p == "/v1/audit", "audit")
            .when(p == "/v1/retention/delete", "deletion")
            .otherwise("other"))


def error_class(message: ColumnLike, sql_state: ColumnLike | None = None) -> Column:
    """A bounded class for a failed tail stage; a database code wins.  The labels are fixed values."""
    m = text(message)
    label = F.lit("tail_failure")
    for stage in reversed(("claim_tail_traces", "load_tail_trace", "record_tail_decision",
                           "claim_tail_outbox", "publish_tail_outbox", "mark_tail_outbox")):
        label = F.when(m.contains(stage), F.lit(f"{stage}_failure")).otherwise(label)
    if sql_state is None:
        return label
    return F.when(text(sql_state) != "", F.concat(F.lit("postgres_"), col(sql_state))).otherwise(label)
