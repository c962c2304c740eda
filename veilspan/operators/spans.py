"""Reading the span table: versions, windows, lookups and tenant reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.predicates import is_usage_error, valid_trace_id
from veilspan.functions.values import as_ts, attr, clamp_limit

# Attributes the reports need, as columns of their own, so reports do not read the bag.
HOT = ("service_name", "peer_service", "usage_error")


def with_hot_columns(spans: DataFrame) -> DataFrame:
    """Add the report columns where the table does not have them already."""
    derived = {"service_name": lambda: attr("attributes", "service.name"),
               "peer_service": lambda: attr("attributes", "peer.service"),
               "usage_error": lambda: is_usage_error("attributes")}
    return spans.withColumns({name: make() for name, make in derived.items()
                              if name not in spans.columns})


def for_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    """Bind to one tenant; ``None`` is for reports over all tenants, keyed by tenant."""
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def last_hours(df: DataFrame, as_of, hours: int = 24, column: str = "ingested_at") -> DataFrame:
    """Rows that arrived within the window: lower bound inclusive, no upper bound.

    The stored table is partitioned by arrival date, which the bound prunes as well.
    """
    since = as_ts(as_of) - F.make_dt_interval(hours=F.lit(hours))
    rows = df.filter(F.col(column) >= since)
    if column == "ingested_at" and "ingest_date" in df.columns:
        rows = rows.filter(F.col("ingest_date") >= F.to_date(since))
    return rows


def dedupe_latest(spans: DataFrame) -> DataFrame:
    """Newest version per ``(tenant_id, event_key)``; equal times are settled by content.

    Only the key and a lower bound on ``ingested_at`` may be filtered below this.  The row
    limit runs before the shuffle too, so a key with very many versions stays small.
    """
    tie = [c for c in spans.columns if c not in ("tenant_id", "event_key", "ingested_at")]
    plain = [F.map_entries(c) if c == "attributes" else F.col(c) for c in tie]
    plain = [F.array_sort(e) if c == "attributes" else e for c, e in zip(tie, plain)]
    newest = Window.partitionBy("tenant_id", "event_key").orderBy(
        F.desc("ingested_at"), F.xxhash64(*plain) if plain else F.lit(0))
    return (spans.withColumn("_version", F.row_number().over(newest))
            .filter(F.col("_version") == 1).drop("_version"))


def _current(spans: DataFrame, unique: bool) -> DataFrame:
    return spans if unique else dedupe_latest(spans)


def usage_metrics(spans: DataFrame, as_of, tenant: str | None = None,
                  tenants: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Span, distinct trace, error and log counts of the last 24 hours, per tenant.

    With ``tenants(id)`` every tenant gets a row, of zeros when it had no data.  ``unique``
    skips version resolution for a table known to hold one version per key.
    """
    window = last_hours(for_tenant(spans, tenant), as_of)
    # Narrow before the shuffle: the bag never travels.
    narrow = with_hot_columns(window).select(
        "tenant_id", "event_key", "ingested_at", "signal_type", "trace_id", "usage_error")
    traces = F.col("signal_type") == "trace"
    counts = (_current(narrow, unique).groupBy("tenant_id").agg(
        F.count_if(traces).alias("span_count"),
        F.count_distinct(F.when(traces, F.col("trace_id"))).alias("trace_count"),
        F.count_if(traces & F.col("usage_error")).alias("error_count"),
        F.count_if(F.col("signal_type") == "log").alias("log_count")))
    if tenants is not None:
        wanted = tenants.select(F.col("id").alias("tenant_id"))
        counts = for_tenant(wanted, tenant).join(counts, "tenant_id", "left").fillna(0)
    return counts.select("tenant_id", F.lit(24).cast("bigint").alias("window_hours"),
                         "span_count", "error_count", "trace_count", "log_count")


def error_rate(metrics: DataFrame) -> DataFrame:
    """Errors per hundred spans, two decimals; 0 without spans."""
    rate = F.when(F.col("span_count") > 0, F.round(
        F.col("error_count") / F.col("span_count") * 100, 2)).otherwise(F.lit(0.0))
    return metrics.withColumn("error_rate", rate)


def service_dependencies(spans: DataFrame, as_of, tenant: str | None = None,
                         unique: bool = False, ordered: bool = True) -> DataFrame:
    """Service edges of trace spans in the last 24 hours, most frequent first."""
    window = last_hours(for_tenant(spans, tenant), as_of)
    narrow = with_hot_columns(window).select(
        "tenant_id", "event_key", "ingested_at", "signal_type",
        F.col("service_name").alias("source"), F.col("peer_service").alias("target"))
    edges = (_current(narrow, unique)
             .filter((F.col("signal_type") == "trace") & (F.col("source") != "")
                     & (F.col("target") != ""))
             .groupBy("tenant_id", "source", "target").agg(F.count(F.lit(1)).alias("edge_count")))
    if not ordered:
        return edges
    return edges.orderBy("tenant_id", F.desc("edge_count"), "source", "target")


def trace_lookup(spans: DataFrame, tenant: str, trace: str, unique: bool = False) -> DataFrame:
    """Sanitized spans and linked logs of one trace, in arrival order; empty when unknown.

    Only the tenant may be filtered before versions are resolved, because a newer version may
    carry another trace id.  So the candidate keys are found first, from the rows that mention
    the trace, and only those keys' versions are resolved: the range of the keys is pushed to the
    second scan, where files are in order of the key, whose first part is the trace for spans.  With
    ``unique`` the trace filter reaches the scan.
    """
    if not isinstance(trace, str):
        raise TypeError("trace id must be text")
    scoped = for_tenant(spans, tenant)
    wanted = (F.col("trace_id") == trace) & valid_trace_id(F.lit(trace))
    return _lookup(scoped, scoped.filter(wanted), wanted, unique).orderBy(
        "ingested_at", "event_key")


def _lookup(spans: DataFrame, mention: DataFrame, wanted: Column, unique: bool) -> DataFrame:
    if unique:
        return mention
    keys = mention.select("tenant_id", "event_key").distinct()
    key = F.col("event_key")
    versions = spans.filter((key >= mention.agg(F.min("event_key")).scalar())
                            & (key <= mention.agg(F.max("event_key")).scalar())).join(keys, ["tenant_id", "event_key"], "left_semi")
    return dedupe_latest(versions).filter(wanted)


def trace_lookup_many(spans: DataFrame, ids: DataFrame, unique: bool = False) -> DataFrame:
    """Lookup of ``ids(tenant_id, trace_id)`` in one pass.

    Versions are resolved before the ids are looked at, in one scan: the row limit per key runs before
    the shuffle, and finding the candidate keys first would take a second scan and shuffle as much.
    """
    keys = ["tenant_id", "trace_id"]
    ids = ids.select(*keys).filter(valid_trace_id("trace_id")).distinct()
    return _current(spans, unique).join(ids, keys, "left_semi")


def trace_timeline(spans: DataFrame) -> DataFrame:
    """Display labels of looked-up rows."""
    log = F.col("signal_type") == "log"
    paths = F.coalesce("redacted_paths", F.array().cast("array<string>"))
    return spans.select(
        "tenant_id", "trace_id", "event_key", "ingested_at",
        F.when(log, "Log record").otherwise(F.col("name")).alias("title"),
        F.when(F.coalesce("span_id", F.lit("")) != "", F.col("span_id")).otherwise("unlinked")
        .alias("span_label"),
        F.when(log, "Trace-linked sanitized log")
        .when(F.coalesce("parent_span_id", F.lit("")) != "",
              F.concat(F.lit("Causal parent: "), F.col("parent_span_id")))
        .otherwise("Trace root").alias("relation"),
        "policy_version",
        F.when(F.size(paths) > 0, F.array_join(paths, ", ")).otherwise("none")
        .alias("redacted_fields"))


def audit_timeline(audit: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """A tenant's audit rows, newest first."""
    return (for_tenant(audit, tenant).orderBy(F.desc("id")).limit(clamp_limit(limit))
            .select("id", "action", "safe_metadata", "created_at"))


def sampling_decisions(decisions: DataFrame, tenant: str | None, limit: int = 100) -> DataFrame:
    """Newest decisions of a tenant, or of every tenant when ``tenant`` is None."""
    n = clamp_limit(limit)
    newest = [F.desc("created_at"), F.desc("trace_id")]
    columns = ["tenant_id", "trace_id", "reason", "retained", "span_count", "created_at"]
    if tenant is not None:
        return for_tenant(decisions, tenant).orderBy(*newest).limit(n).select(*columns)
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*newest))
    return decisions.withColumn("_n", rank).filter(F.col("_n") <= n).select(*columns)
