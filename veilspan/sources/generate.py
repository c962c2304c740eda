"""Fabricated telemetry of any size, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.predicates import TRACES_ROUTE

LOAD_SPAN_NAME = "load"
LOAD_ATTRIBUTES = {"service.name": "load", **{f"label.{n}": f"text {n}" for n in range(3)}, "contact": "load@mail.invalid"}


def _id(kind: str, seed: str, number: Column, size: int) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit(kind), number.cast("string")), 256)
    return F.substring(digest, 1, 2 * size)


def _attribute(key: str, value: str) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(F.lit(value).alias("stringValue"))
                    .alias("value"))


def generate_spans(spark: SparkSession, spans: int, batch: int = 100, seed: str = "load",
                   key_hash: str = "", received_at: str = "2026-01-01 00:00:00") -> DataFrame:
    """Trace requests of ``batch`` spans, one trace per request, as one row per request.

    Each row builds its own body, so nothing is shuffled.
    """
    requests = -(-spans // batch)
    attributes = F.array(*[_attribute(k, v) for k, v in LOAD_ATTRIBUTES.items()])
    first = F.col("id") * batch
    size = F.least(F.lit(batch), F.lit(spans) - first)
    items = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        _id("trace", seed, F.col("id"), 16).alias("traceId"),
        _id("span", seed, first + i, 8).alias("spanId"), F.lit(LOAD_SPAN_NAME).alias("name"),
        attributes.alias("attributes")))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(items.alias("spans")))
                                               .alias("scopeSpans"))).alias("resourceSpans")))
    return spark.range(requests).select(
        F.concat(F.lit("load-"), F.col("id").cast("string")).alias("request_id"),
        F.lit(TRACES_ROUTE).alias("route"), F.lit("POST").alias("method"),
        F.lit(key_hash).alias("key_hash"),
        (F.lit(received_at).cast("timestamp")
         + F.make_dt_interval(secs=F.col("id") / 1000)).alias("received_at"),
        body.alias("body"))


def generate_calls(spark: SparkSession, traces: int, depth: int, seed: str = "calls") -> DataFrame:
    """Events of ``traces`` requests, in each of which service 0 calls service 1 and so on, ``depth`` in all."""
    trace, hop = _id("trace", seed, F.col("id"), 16), F.col("hop")
    number = F.col("id") * depth + hop
    service = lambda n: F.concat(F.lit("service-"), n.cast("string"))
    attributes = F.create_map(F.lit("service.name"), service(hop),
                              F.lit("peer.service"), F.when(hop < depth - 1, service(hop + 1)).otherwise(""))
    span = _id("span", seed, number, 8)
    event = F.struct(
        F.concat(trace, F.lit(":"), span).alias("eventId"), F.lit("trace").alias("signal"),
        trace.alias("traceId"), span.alias("spanId"),
        F.when(hop > 0, _id("span", seed, number - 1, 8)).otherwise("").alias("parentSpanId"),
        F.concat(F.lit("call "), hop.cast("string")).alias("name"), attributes.alias("attributes"))
    hops = spark.range(traces).withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return hops.select(event.cast(schemas.EVENT).alias("event"))


def generate_pressure(spark: SparkSession, tenant: str, traces: int = 1001,
                      received_at: str = "2026-01-01 00:00:00") -> DataFrame:
    """``traces`` one-span envelopes, each a staging request of its own, in staging shape."""
    number = F.lpad(F.col("id").cast("string"),
                    F.greatest(F.lit(4), F.length(F.col("id").cast("string"))), F.lit("0"))
    trace = F.concat(F.lit("pressure-trace-"), number)
    event_id = F.concat(F.lit("pressure-event-"), number)
    key = F.concat(F.lit(f"{tenant}:"), event_id)
    event = F.struct(
        event_id.alias("eventId"), F.lit("trace").alias("signal"), trace.alias("traceId"),
        F.lit("pressure-span").alias("spanId"), F.lit("").alias("parentSpanId"),
        F.lit("burst").alias("name"),
        F.create_map(F.lit("service.name"), F.lit("burst-client"),
                     F.lit("http.status_code"), F.lit("200")).alias("attributes"))
    policy = F.struct(F.lit("").alias("policyVersion"),
                      F.array().cast("array<string>").alias("redactedPaths"))
    return spark.range(traces).select(
        F.concat(F.lit("pressure-"), number).alias("request_id"),
        (F.lit(received_at).cast("timestamp")
         + F.make_dt_interval(secs=F.col("id") / 1000)).alias("received_at"),
        F.lit(tenant).alias("tenant_id"), F.lit(1).alias("pos"), key.alias("event_key"),
        trace.alias("trace_id"),
        F.struct(F.lit(tenant).alias("tenantId"), event.alias("event"), policy.alias("policy"),
                 key.alias("eventKey")).alias("envelope"))
