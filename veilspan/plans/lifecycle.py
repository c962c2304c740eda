"""Retention and tenant deletion as jobs over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.values import retention_cutoff
from veilspan.operators import lifecycle
from veilspan.sources.tables import (StateStore, drop_partition, drop_tenant_spans, scan_spans,
                                     write_spans)

# Where the aging rows of each logical table are stored.  Open traces and pending outbox rows
# are not listed: they never age.
_AGING_TABLES = {"tail_outbox": "outbox_published", "tail_event_keys": "tail_event_keys",
                 "tail_decisions": "tail_decisions", "tail_traces": "traces_closed"}
# Stored tables, scratch included, that hold a tenant's rows and go with the tenant.
_TENANT_TABLES = ("outbox_pending", "outbox_published", "outbox_batch", "tail_event_keys",
                  "tail_decisions", "traces_open", "traces_closed", "tail_buffers", "inbox",
                  "staged", "candidates", "taken", "segments", "lives", "evictions", "closed_before")


def run_retention(store: StateStore, spans_path: str, kept_path: str | None, policies: DataFrame,
                  as_of) -> DataFrame:
    """Remove the rows that have expired, and return what stays and what was purged.

    Without ``kept_path`` the span table is changed where it is: partitions of dates before a tenant's
    cutoff are dropped, the partition of the cutoff's date is written anew, and all other files stay,
    also those added meanwhile.  With ``kept_path`` the rows that stay are written there instead, which
    compacts them; the caller points readers there.  The state tables change in one version.
    """
    tables = {name: store.read(stored) for name, stored in _AGING_TABLES.items()}
    tables["spans"] = scan_spans(store.spark, spans_path).drop("ingest_date")
    kept, report = lifecycle.apply_retention(tables, policies, as_of)
    counts = report.collect()  # one row per table and tenant, taken before anything changes
    if kept_path is None:
        expire_span_partitions(store.spark, spans_path, policies, as_of)
    else:
        write_spans(kept["spans"], kept_path, mode="overwrite")
    store.commit(replace={stored: kept[name] for name, stored in _AGING_TABLES.items()})
    return store.spark.createDataFrame(counts, report.schema)


def expire_span_partitions(spark: SparkSession, spans_path: str, policies: DataFrame, as_of) -> None:
    """Drop the (tenant, date) partitions before a tenant's cutoff; write that of the cutoff's date anew without its expired rows."""
    spans = scan_spans(spark, spans_path)
    cutoffs = policies.select("tenant_id", retention_cutoff(as_of, "retention_days").alias("_cut"))
    old = spans.select("tenant_id", "ingest_date").distinct().join(cutoffs, "tenant_id").filter(F.col("ingest_date") < F.to_date("_cut"))
    edge = spans.join(cutoffs, "tenant_id").filter(F.col("ingest_date") == F.to_date("_cut"))
    touched = edge.groupBy("tenant_id", "ingest_date").agg(
        F.count_if(F.col("ingested_at") < F.col("_cut")).alias("gone"), F.count(F.lit(1)).alias("n")).filter("gone > 0")
    touched = touched.collect()  # at most one partition per tenant
    # Names of partitions, not rows: a job that runs daily drops about one date per tenant.
    gone = [*old.collect(), *[t for t in touched if t["gone"] == t["n"]]]
    mixed = [(t["tenant_id"], t["ingest_date"]) for t in touched if t["gone"] < t["n"]]
    if mixed:
        pairs = spark.createDataFrame(mixed, "tenant_id string, ingest_date date")
        rows = edge.filter(F.col("ingested_at") >= F.col("_cut")).join(F.broadcast(pairs), ["tenant_id", "ingest_date"], "left_semi")
        write_spans(rows.drop("_cut", "ingest_date"), spans_path, replace_partitions=True)
    for row in gone:
        drop_partition(spark, spans_path, row["tenant_id"], row["ingest_date"])


def run_deletion(spark: SparkSession, store: StateStore, spans_path: str, tenant: str,
                 confirm: str, as_of) -> None:
    """Delete a tenant: its state, its spans, and old versions that still hold them.

    One state version removes the rows and adds the audit row.  The ledger stays, so deleted
    events that are sent again are not stored again.
    """
    tables = {"audit_events": store.read("audit_events")}
    audit = lifecycle.delete_tenant(tables, tenant, confirm, as_of)["audit_events"]
    replaced = {name: store.read(name) for name in _TENANT_TABLES if name in store.schemas}
    store.commit(replace={
        "audit_events": audit,
        **{name: rows.filter(rows["tenant_id"] != tenant) for name, rows in replaced.items()}})
    drop_tenant_spans(spark, spans_path, tenant)
    store.vacuum()
