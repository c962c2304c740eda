"""From request rows to sanitized envelopes, whole requests at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.masking import sanitize
from veilspan.functions.predicates import body_within_limit, known_route, valid_request
from veilspan.functions.values import event_key, tail_trace_id, text
from veilspan.operators.policy import attach_policy, resolve_tenants
from veilspan.session import ensure_conf
from veilspan.sources.otlp import route_events
from veilspan.sources.strict_json import with_canonical_body

# Response classes.  Fixed values.
ACCEPTED, BAD_REQUEST, UNAUTHORIZED, NOT_FOUND, UNAVAILABLE = 202, 400, 401, 404, 503


def decode_requests(requests: DataFrame, strict: bool = True) -> DataFrame:
    """Replace ``body`` by ``events``; a request that must be refused has none.

    ``strict=False`` lets unknown fields pass.  Expects ``route`` and ``body``.
    """
    ensure_conf(requests.sparkSession)
    keep = [c for c in requests.columns if c != "body"]
    documents = (with_canonical_body(requests) if strict else requests.withColumn(
        "doc", F.when(body_within_limit("body"), F.col("body"))))
    parsed = documents.select(*keep, route_events("doc", "route").alias("events"))
    return parsed.select(*keep, F.when(valid_request("events"), F.col("events")).alias("events"))


def spread(requests: DataFrame) -> DataFrame:
    """The requests dealt anew over the tasks.

    Parsing and masking cost far more than reading, so a file that is read by few tasks would leave
    most of the cluster without work.
    """
    return requests.hint("rebalance")


def accept_requests(requests: DataFrame, api_keys: DataFrame, active: DataFrame,
                    deploy_version: str = "", deploy_expressions: Sequence[str] = (),
                    strict: bool = True) -> DataFrame:
    """One row per request with ``tenant_id``, ``code``, ``events`` and its policy.

    Narrow but for the two dimension joins: a request is judged on its own row.
    """
    known = known_route("method", "route")
    # A request without tenant or route is never parsed.
    resolved = resolve_tenants(requests, api_keys).withColumn(
        "body", F.when(known & F.col("tenant_id").isNotNull(), F.col("body")))
    judged = attach_policy(decode_requests(resolved, strict), active, deploy_version,
                           deploy_expressions)
    code = (F.when(~known, NOT_FOUND)
            .when(F.col("tenant_id").isNull(), UNAUTHORIZED)
            .when(F.col("events").isNull(), BAD_REQUEST)
            .when(~F.col("policy_ok"), UNAVAILABLE)
            .otherwise(ACCEPTED))
    return judged.withColumn("code", code)


def request_outcome(judged: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """``request_id, tenant_id, code``; requests refused at staging become 503."""
    out = judged.select("request_id", "tenant_id", "code")
    if refused is None:
        return out
    late = refused.select("request_id").distinct().withColumn("staging_refused", F.lit(True))
    return (out.join(late, "request_id", "left")
            .select("request_id", "tenant_id",
                    F.when(F.col("staging_refused") & (F.col("code") == ACCEPTED), UNAVAILABLE)
                    .otherwise(F.col("code")).alias("code")))


def inbox_rows(judged: DataFrame) -> DataFrame:
    """Sanitized envelopes in request order (``pos`` from 1), and one row without envelope per
    refused request.

    One pass without a filter: a filter on the verdict would be pushed below the parsing and
    parse every body again.
    """
    events = judged.select(
        "request_id", "received_at", "tenant_id", "code", "patterns", "policy_version",
        F.posexplode_outer(F.when(F.col("code") == ACCEPTED, F.col("events")))
        .alias("at", "event"))
    return sanitize_events(events.withColumn("pos", F.col("at") + 1).drop("at"))


def envelopes(judged: DataFrame) -> DataFrame:
    """Sanitized envelopes of the accepted requests, in request order."""
    return inbox_rows(judged).filter(F.col("pos").isNotNull()).drop("code")


def sanitize_events(events: DataFrame) -> DataFrame:
    """Mask each event's attributes and build its envelope, key and tail trace id."""
    ensure_conf(events.sparkSession)
    keep = [c for c in events.columns if c not in ("event", "patterns", "policy_version")]
    e = F.col("event")
    clean = events.select(*keep, "event", F.when(e.isNotNull(), sanitize(
        "event.attributes", "patterns", "policy_version")).alias("s"))
    key = event_key("tenant_id", e["eventId"])
    fields = [e[f.name].alias(f.name) for f in schemas.EVENT if f.name != "attributes"]
    return clean.select(
        *keep, key.alias("event_key"),
        F.when(e.isNotNull(), tail_trace_id(e["traceId"], e["eventId"])).alias("trace_id"),
        F.when(e.isNotNull(), F.struct(
            F.col("tenant_id").alias("tenantId"),
            F.struct(*fields, F.col("s.attributes").alias("attributes")).alias("event"),
            F.col("s.policy").alias("policy"), key.alias("eventKey"))).alias("envelope"))


def single_tenant_check(batch: DataFrame) -> DataFrame:
    """Per request whether all its envelopes name one non-empty tenant."""
    return batch.groupBy("request_id").agg(
        ((F.min(text("tenant_id")) != "")
         & (F.min(text("tenant_id")) == F.max(text("tenant_id")))).alias("single_tenant"))
