"""Request bodies to event arrays.

A request stays one row until it is accepted or refused as a whole, so parsing and
validation need no shuffle; accepted requests are exploded afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.predicates import EVENT_ROUTE, LOGS_ROUTE, TRACES_ROUTE
from veilspan.functions.values import (ColumnLike, col, log_event_id, reuse, shortest_double, text,
                                       trace_event_id)
from veilspan.session import ensure_conf

# The mark every parsed event carries.  Fixed value.
SOURCE_KEY, SOURCE_VALUE = "telemetry.source", "otlp_http_json"


def scalar_value(value: Column) -> Column:
    """First scalar present, as text; NULL when the value holds none."""
    return F.coalesce(value["stringValue"], value["boolValue"].cast("string"), value["intValue"],
                      shortest_double(value["doubleValue"]))


def scalar_pairs(attributes: Column) -> Column:
    """The scalar attributes with a key, as key-value structs."""
    pairs = F.transform(_items(attributes, schemas.ATTRIBUTES),
                        lambda a: _pair(a["key"], scalar_value(a["value"])))
    return F.filter(pairs, lambda p: (p["key"] != "") & p["value"].isNotNull())


def _pair(key: Column, value: Column) -> Column:
    return F.struct(text(key).alias("key"), value.alias("value"))


def _bag(*parts: Column) -> Column:
    """One map of all pairs; of several equal keys the last wins."""
    mark = F.array(_pair(F.lit(SOURCE_KEY), F.lit(SOURCE_VALUE)))
    return F.map_from_entries(F.concat(*parts, mark))


def _items(array: Column, kind) -> Column:
    return F.coalesce(array, F.array().cast(kind))


def _event(event_id, signal, trace_id, span_id, parent, name, attributes) -> Column:
    return F.struct(event_id.alias("eventId"), F.lit(signal).alias("signal"),
                    text(trace_id).alias("traceId"), text(span_id).alias("spanId"),
                    parent.alias("parentSpanId"), name.alias("name"),
                    attributes.alias("attributes"))


def _by_resource(resources: Column, kind, scopes: str, items: str) -> Column:
    """Per resource: its attributes, read once, and its items over all scopes."""
    scope_kind = kind.elementType[scopes].dataType
    item_kind = scope_kind.elementType[items].dataType
    return F.transform(_items(resources, kind), lambda r: F.struct(
        scalar_pairs(r["resource"]["attributes"]).alias("resource"),
        F.flatten(F.transform(_items(r[scopes], scope_kind),
                              lambda s: _items(s[items], item_kind))).alias("items")))


@reuse
def trace_events(body: ColumnLike) -> Column:
    """Events of a trace request, in document order."""
    kind = schemas.OTLP_TRACES["resourceSpans"].dataType
    doc = F.from_json(col(body), schemas.OTLP_TRACES)
    grouped = _by_resource(doc["resourceSpans"], kind, "scopeSpans", "spans")
    return F.flatten(F.transform(grouped, lambda r: F.transform(r["items"], lambda s: _event(
        trace_event_id(s["traceId"], s["spanId"]), "trace", s["traceId"], s["spanId"],
        text(s["parentSpanId"]), text(s["name"]),
        _bag(r["resource"], scalar_pairs(s["attributes"]))))))


@reuse
def log_events(body: ColumnLike) -> Column:
    """Events of a log request; the ordinal in a log's id runs over the whole request."""
    kind = schemas.OTLP_LOGS["resourceLogs"].dataType
    doc = F.from_json(col(body), schemas.OTLP_LOGS)
    grouped = _by_resource(doc["resourceLogs"], kind, "scopeLogs", "logRecords")

    def own(log: Column) -> Column:
        # Severity and body override attributes of the same name; an empty severity is none.
        late = F.array(
            _pair(F.lit("log.severity"), F.nullif(log["severityText"], F.lit(""))),
            _pair(F.lit("log.body"), scalar_value(log["body"])))
        return F.concat(scalar_pairs(log["attributes"]),
                        F.filter(late, lambda p: p["value"].isNotNull()))

    records = F.flatten(F.transform(grouped, lambda r: F.transform(r["items"], lambda log: F.struct(
        log["traceId"].alias("traceId"), log["spanId"].alias("spanId"),
        log["timeUnixNano"].alias("timeUnixNano"),
        _bag(r["resource"], own(log)).alias("attributes")))))
    return F.transform(records, lambda log, at: _event(
        log_event_id(log["traceId"], log["spanId"], log["timeUnixNano"], at + 1), "log",
        log["traceId"], log["spanId"], F.lit(""), F.lit("log"), log["attributes"]))


@reuse
def single_event(body: ColumnLike) -> Column:
    """The one event of a plain event body, as an array."""
    doc = F.from_json(col(body), schemas.EVENT)
    attributes = F.transform_values(
        F.coalesce(doc["attributes"], F.create_map().cast("map<string,string>")),
        lambda _, v: text(v))
    return F.array(F.struct(
        text(doc["eventId"]).alias("eventId"), text(doc["signal"]).alias("signal"),
        text(doc["traceId"]).alias("traceId"), text(doc["spanId"]).alias("spanId"),
        text(doc["parentSpanId"]).alias("parentSpanId"), text(doc["name"]).alias("name"),
        attributes.alias("attributes")))


@reuse
def route_events(body: ColumnLike, route: ColumnLike) -> Column:
    """The event array of a body by its route; NULL for a missing body."""
    r = col(route)
    events = (F.when(r == TRACES_ROUTE, trace_events(body))
              .when(r == LOGS_ROUTE, log_events(body))
              .when(r == EVENT_ROUTE, single_event(body)))
    return F.when(col(body).isNotNull(), events)


def _exploded(requests: DataFrame, events: Column) -> DataFrame:
    ensure_conf(requests.sparkSession)
    keep = [c for c in requests.columns if c != "body"]
    return (requests.select(*keep, F.posexplode(events).alias("pos", "event"))
            .select(*keep, (F.col("pos") + 1).alias("ordinal"), "event"))


def parse_otlp_traces(requests: DataFrame) -> DataFrame:
    """One row per span of each trace request, with its 1-based ordinal."""
    return _exploded(requests, trace_events("body"))


def parse_otlp_logs(requests: DataFrame) -> DataFrame:
    """One row per log record of each log request, with its request-wide ordinal."""
    return _exploded(requests, log_events("body"))


def parse_events(requests: DataFrame) -> DataFrame:
    """One row per plain event body."""
    return _exploded(requests, single_event("body"))
