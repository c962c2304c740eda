"""Retention, tenant deletion and audit."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.values import as_ts, retention_cutoff, valid_retention_days
from veilspan.operators import scan

# Retention default, the deletion phrase and its audit row.  Fixed values.
DEFAULT_RETENTION_DAYS = 30
DELETE_PHRASE = "DELETE_SANITIZED_TELEMETRY"
DELETE_ACTION = "tenant_telemetry_deletion_requested"
DELETE_METADATA = {"scope": "clickhouse_mutation_requested_and_tail_data_deleted",
                   "state": "mutation_requested"}

# Which rows of each table age out, and by which time.
_AGING = {
    "spans": ("ingested_at", None),
    "tail_outbox": ("created_at", lambda: F.col("published_at").isNotNull()),
    "tail_event_keys": ("created_at", None),
    "tail_decisions": ("created_at", None),
    "tail_traces": ("decided_at", lambda: F.col("decided_at").isNotNull()),
}
# Tables emptied by a tenant deletion; the delivery ledger and the audit stay.
DELETED_TABLES = ("tail_outbox", "tail_event_keys", "tail_decisions", "tail_traces",
                  "tail_buffers", "spans")


def retention_policies(tenants: DataFrame, retention: DataFrame) -> DataFrame:
    """Days to keep per tenant; 30 where no row is set.

    A row out of 1..3650 gives null: nothing of that tenant expires until the row is put right.
    """
    rows = retention.select(
        F.col("tenant_id").alias("id"), F.lit(True).alias("_set"),
        F.when(valid_retention_days("retention_days"), F.col("retention_days")).alias("_days"))
    return tenants.select("id").join(rows, "id", "left").select(
        F.col("id").alias("tenant_id"),
        F.when(F.col("_set"), F.col("_days")).otherwise(DEFAULT_RETENTION_DAYS)
        .alias("retention_days"))


def with_expired(df: DataFrame, policies: DataFrame, as_of, column: str,
                 eligible: Column | None = None) -> DataFrame:
    """Add ``expired``; rows of an unknown tenant never expire.

    Retention rows are one per tenant: Spark broadcasts them while they are small.
    """
    cutoffs = policies.select("tenant_id", retention_cutoff(as_of, "retention_days").alias("_cut"))
    old = F.col(column) < F.col("_cut")
    old = old if eligible is None else old & eligible
    return (df.join(cutoffs, "tenant_id", "left")
            .withColumn("expired", F.coalesce(old, F.lit(False))).drop("_cut"))


def expire_spans(spans: DataFrame, policies: DataFrame, as_of) -> DataFrame:
    """Spans that stay."""
    return _kept(with_expired(spans, policies, as_of, "ingested_at"), spans)


def _kept(marked: DataFrame, like: DataFrame) -> DataFrame:
    return marked.filter(~F.col("expired")).select(*like.columns)


def apply_retention(tables: Mapping[str, DataFrame], policies: DataFrame, as_of
                    ) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after retention, and ``table_name, tenant_id, kept, purged``.

    Undecided traces and unpublished outbox rows stay however old they are: removing them
    would turn a delay into a loss.
    """
    kept, reports = {}, []
    for name, df in tables.items():
        if name not in _AGING:
            kept[name] = df
            continue
        column, eligible = _AGING[name]
        marked = with_expired(df, policies, as_of, column, eligible() if eligible else None)
        kept[name] = _kept(marked, df)
        reports.append(marked.groupBy("tenant_id").agg(
            F.count_if(~F.col("expired")).alias("kept"), F.count_if("expired").alias("purged"))
            .select(F.lit(name).alias("table_name"), "tenant_id", "kept", "purged"))
    return kept, reduce(DataFrame.unionByName, reports)


def append_audit(audit: DataFrame, events: DataFrame) -> DataFrame:
    """Append ``events(tenant_id, action, safe_metadata, created_at)``.

    Ids grow per tenant, which is how the timeline reads them, by time, action and metadata.  New rows
    are numbered over ranged partitions, so a tenant with very many of them is not one task.
    """
    last = audit.groupBy("tenant_id").agg(F.max("id").alias("last"))
    details = F.to_json(F.array_sort(F.map_entries("safe_metadata")))
    order = [F.col("created_at"), F.col("action"), details]
    rows = (scan.numbered(events, ["tenant_id"], order, "n").join(last, "tenant_id", "left")
            .select((F.coalesce("last", F.lit(0)) + F.col("n")).cast("bigint").alias("id"),
                    "tenant_id", "action", "safe_metadata", "created_at"))
    return audit.unionByName(rows)


def delete_tenant(tables: Mapping[str, DataFrame], tenant: str, confirm: str, as_of,
                  forget_ledger: bool = False) -> dict[str, DataFrame]:
    """The tables after a tenant's deletion, with one audit row.

    Needs the exact phrase.  The ledger stays unless ``forget_ledger``, so deleted events that
    are sent again are not stored again.
    """
    if confirm != DELETE_PHRASE:
        raise ValueError("explicit deletion confirmation required")
    if not tenant:
        raise ValueError("tenant required")
    targets = DELETED_TABLES + (("delivery_ledger",) if forget_ledger else ())
    out = {name: df.filter(F.col("tenant_id") != tenant) if name in targets else df
           for name, df in tables.items()}
    audit = out["audit_events"]
    event = audit.sparkSession.range(1).select(
        F.lit(tenant).alias("tenant_id"), F.lit(DELETE_ACTION).alias("action"),
        F.create_map(*[F.lit(x) for pair in DELETE_METADATA.items() for x in pair])
        .alias("safe_metadata"), as_ts(as_of).alias("created_at"))
    out["audit_events"] = append_audit(audit, event)
    return out
