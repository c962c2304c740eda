"""Small inputs in the library's shapes."""

import datetime as dt
import hashlib
import json

from pyspark.sql import types as T

from veilspan import schemas

NOW = dt.datetime(2026, 8, 1, 12, 0, 0)
KEY = hashlib.sha256(b"synthetic-key").hexdigest()
SEEDS = ("smoke-secret-must-not-persist", "person@example.test", "INV-31415")

BATCH = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("received_at", T.TimestampType()),
    T.StructField("tenant_id", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("event_key", T.StringType()), T.StructField("trace_id", T.StringType()),
    T.StructField("envelope", schemas.ENVELOPE)])


def at(seconds: float) -> dt.datetime:
    return NOW + dt.timedelta(seconds=seconds)


def attribute(key, **value):
    return {"key": key, "value": value}


def span(trace="trace-1", span_id="span-1", name="checkout", attributes=(), **more):
    return {"traceId": trace, "spanId": span_id, "name": name, "attributes": list(attributes),
            **more}


def trace_body(*spans, resource=()):
    return json.dumps({"resourceSpans": [{"resource": {"attributes": list(resource)},
                                          "scopeSpans": [{"spans": list(spans)}]}]})


def log_body(*records):
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": list(records)}]}]})


def requests(spark, rows, key=KEY):
    """``rows``: (request_id, route, body) or (request_id, route, body, received_at)."""
    full = [(r[0], r[1], "POST", key, r[3] if len(r) > 3 else NOW, r[2]) for r in rows]
    return spark.createDataFrame(full, schemas.REQUESTS)


def keys(spark, tenant="tenant-a"):
    return spark.createDataFrame([(tenant, KEY, None, NOW)], schemas.API_KEYS)


def policies(spark, rows=()):
    return spark.createDataFrame(list(rows), schemas.POLICIES)


def envelope(tenant, trace, event, attributes=None, signal="trace"):
    event_id = f"{trace}:{event}"
    return (tenant, (event_id, signal, trace, event, "", "checkout", attributes or {}),
            ("v1", []), f"{tenant}:{event_id}")


def batch(spark, rows):
    """``rows``: (request_id, seconds, tenant, trace, event[, attributes])."""
    out, seen = [], {}
    for r in rows:
        request, seconds, tenant, trace, event = r[:5]
        seen[request] = seen.get(request, 0) + 1
        out.append((request, at(seconds), tenant, seen[request], f"{tenant}:{trace}:{event}",
                    trace, envelope(tenant, trace, event, r[5] if len(r) > 5 else None)))
    return spark.createDataFrame(out, BATCH)


def empty(spark, schema):
    return spark.createDataFrame([], schema)
