"""Outbox publishing and idempotent persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.values import as_ts, signal_type, text
from veilspan.operators.staging import KEY

# Delivery states.  Fixed values.
PENDING, PERSISTED, LOSS_EVIDENCED = "pending", "persisted", "loss_evidenced"


def pending_outbox(outbox: DataFrame, limit: int | None = 32) -> DataFrame:
    """Unpublished rows, oldest first, with the attempt counted.  ``limit=None`` takes all."""
    rows = outbox.filter(F.col("published_at").isNull()).withColumn(
        "attempts", (F.col("attempts") + 1).cast("int"))
    if limit is None:
        return rows
    return rows.orderBy("created_at", "event_key").limit(max(limit, 1))


def mark_published(outbox: DataFrame, published: DataFrame, as_of) -> DataFrame:
    """The outbox after ``published`` rows reached the topic."""
    done = published.select(*KEY, F.col("attempts").alias("_attempts"),
                            F.lit(True).alias("_done"))
    now_done = F.col("_done") & F.col("published_at").isNull()
    return outbox.join(done, list(KEY), "left").select(
        "event_key", "tenant_id", "envelope",
        F.when(now_done, F.col("_attempts")).otherwise(F.col("attempts")).cast("int")
        .alias("attempts"),
        F.when(now_done, as_ts(as_of)).otherwise(F.col("published_at")).alias("published_at"),
        "created_at")


def first_deliveries(batch: DataFrame) -> DataFrame:
    """One row per ``(tenant_id, event_key)`` of a batch.

    Copies of a key are normally equal; should they differ, the choice depends on content only,
    so a retry chooses the same one.
    """
    event = F.col("envelope.event")
    order = Window.partitionBy(*KEY).orderBy(F.xxhash64(
        F.col("envelope.policy.policyVersion"), event["name"], event["traceId"], event["spanId"],
        F.array_sort(F.map_entries(event["attributes"]))))
    return (batch.withColumn("_copy", F.row_number().over(order))
            .filter(F.col("_copy") == 1).drop("_copy"))


def claim_deliveries(batch: DataFrame, ledger: DataFrame, as_of) -> DataFrame:
    """Ledger rows after claiming the batch's keys, with ``claimed``.

    New key: pending, attempt 1.  Pending: one attempt more.  Persisted or given up: left
    alone and not claimed.
    """
    at = as_ts(as_of)
    keys = batch.select(*KEY).distinct()
    old = ledger.select(*KEY, F.lit(True).alias("_known"), "status", "attempts",
                        "last_error_class", "created_at", "updated_at")
    known = F.col("_known").isNotNull()
    claimed = ~known | (F.col("status") == PENDING)
    return keys.join(old, list(KEY), "left").select(
        "event_key", "tenant_id",
        F.coalesce("status", F.lit(PENDING)).alias("status"),
        F.when(~known, 1).when(claimed, F.col("attempts") + 1).otherwise(F.col("attempts"))
        .cast("int").alias("attempts"),
        "last_error_class",
        F.coalesce("created_at", at).alias("created_at"),
        F.when(claimed, at).otherwise(F.col("updated_at")).alias("updated_at"),
        claimed.alias("claimed"))


def merge_ledger(ledger: DataFrame, changed: DataFrame) -> DataFrame:
    """The ledger with the changed rows put in."""
    rows = changed.select(*ledger.columns)
    return ledger.join(rows.select(*KEY), list(KEY), "left_anti").unionByName(rows)


def mark_persisted(claims: DataFrame, as_of) -> DataFrame:
    """Claimed rows after a successful write; unclaimed ones stay as they are."""
    done = F.col("claimed") & (F.col("status") == PENDING)
    return claims.select(
        "event_key", "tenant_id",
        F.when(done, PERSISTED).otherwise(F.col("status")).alias("status"), "attempts",
        F.when(~done, F.col("last_error_class")).alias("last_error_class"), "created_at",
        F.when(done, as_ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"))


def record_loss(ledger: DataFrame, losses: DataFrame, as_of) -> DataFrame:
    """Give up pending keys; ``losses(tenant_id, event_key, error_class)``.  Evidence only."""
    lost = losses.groupBy(*KEY).agg(F.min("error_class").alias("_class"))
    hit = F.col("_class").isNotNull() & (F.col("status") == PENDING)
    return ledger.join(lost, list(KEY), "left").select(
        "event_key", "tenant_id",
        F.when(hit, LOSS_EVIDENCED).otherwise(F.col("status")).alias("status"), "attempts",
        F.when(hit, F.col("_class")).otherwise(F.col("last_error_class"))
        .alias("last_error_class"), "created_at",
        F.when(hit, as_ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"))


def to_span_rows(envelopes: DataFrame, as_of) -> DataFrame:
    """Span table rows of envelopes; arrival time in milliseconds."""
    event = F.col("envelope.event")
    return envelopes.select(
        "tenant_id", "event_key", event["eventId"].alias("event_id"),
        signal_type(event["signal"]).alias("signal_type"),
        text(event["traceId"]).alias("trace_id"), text(event["spanId"]).alias("span_id"),
        text(event["parentSpanId"]).alias("parent_span_id"), event["name"].alias("name"),
        event["attributes"].alias("attributes"),
        F.col("envelope.policy.policyVersion").alias("policy_version"),
        F.coalesce(F.col("envelope.policy.redactedPaths"), F.array().cast("array<string>"))
        .alias("redacted_paths"),
        F.date_trunc("millisecond", as_ts(as_of)).alias("ingested_at"))


def claimed_envelopes(batch: DataFrame, claims: DataFrame) -> DataFrame:
    """The batch rows to write: first copy of each claimed key."""
    return first_deliveries(batch).join(
        claims.filter("claimed").select(*KEY), list(KEY), "left_semi")
