"""The driver's tables seen as telemetry.

``events`` rows become spans and requests, ``conversations`` turns become log requests.
Dimensions are literal.  Every rule is row-wise but the parent link, which looks at the
previous span of the trace.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.predicates import LOGS_ROUTE, TRACES_ROUTE
from veilspan.functions.values import event_key
from veilspan.session import ensure_conf

TENANTS = ("tenant-0", "tenant-1", "tenant-2", "tenant-3")
IDLE_TENANT = "tenant-idle"
TEXT_RULES = (r'token = "[0-9a-f]{40}"', r"src-?[0-9]+")


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    static = ensure_conf(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    if not stream:
        return static
    return (spark.readStream.schema(static.schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def _base(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events", stream).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        k.alias("k"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string"), F.lit("-"),
                 F.unix_date(F.to_date("ts")).cast("string")).alias("trace_id"),
        F.concat(F.lit("span-"), F.col("event_id").cast("string")).alias("span_id"))


def attributes() -> Column:
    peer = F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("svc-"), (F.col("k") % 5).cast("string")))
    return F.create_map(
        F.lit("service.name"), F.concat(F.lit("svc-"), F.col("event_type")),
        F.lit("peer.service"), peer,
        F.lit("http.status_code"), F.when(F.col("event_type") == "error", "503").otherwise("200"),
        F.lit("duration_ms"), F.round(F.col("value") * 3, 2).cast("string"))


def spans(spark: SparkSession, sf_dir: str, redelivered: bool = True) -> DataFrame:
    """Span rows; every twentieth event arrives again an hour later."""
    base = _base(spark, sf_dir)
    before = Window.partitionBy("user_id", "trace_id").orderBy("ts", "event_id")
    event_id = F.concat("trace_id", F.lit(":"), "span_id")
    rows = base.select(
        "tenant_id", event_key("tenant_id", event_id).alias("event_key"),
        event_id.alias("event_id"),
        F.when(F.col("k") % 10 == 0, "log").otherwise("trace").alias("signal_type"),
        "trace_id", "span_id",
        F.coalesce(F.lag("span_id").over(before), F.lit("")).alias("parent_span_id"),
        F.col("event_type").alias("name"), attributes().alias("attributes"),
        F.lit("v1").alias("policy_version"),
        F.when(F.col("k") % 3 == 0, F.array(F.lit("attributes.customer.email")))
        .otherwise(F.array().cast("array<string>")).alias("redacted_paths"),
        F.date_trunc("millisecond", "ts").alias("ingested_at"),
        F.col("event_id").alias("source_event"))
    if redelivered:
        # Both copies come from one row, so the source is read and ordered once.
        hours = F.when(F.col("source_event") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))
        rows = rows.withColumn("_hours", F.explode(hours)).withColumn(
            "ingested_at", F.col("ingested_at") + F.make_dt_interval(hours=F.col("_hours")))
        rows = rows.drop("_hours")
    return rows.drop("source_event")


def newest(df: DataFrame, column: str = "ingested_at") -> Column:
    """The table's newest time, as a scalar subquery inside the plan."""
    return df.agg(F.max(column)).scalar()


def staging_batch(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Envelopes in staging shape, one request per event."""
    base = _base(spark, sf_dir, stream)
    event_id = F.concat("trace_id", F.lit(":"), "span_id")
    event = F.struct(
        event_id.alias("eventId"),
        F.when(F.col("k") % 10 == 0, "log").otherwise("trace").alias("signal"),
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
        F.lit("").alias("parentSpanId"), F.col("event_type").alias("name"),
        attributes().alias("attributes"))
    receipt = F.struct(F.lit("v1").alias("policyVersion"),
                       F.array().cast("array<string>").alias("redactedPaths"))
    key = event_key("tenant_id", event_id)
    return base.select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("ts").alias("received_at"), "tenant_id", F.lit(1).alias("pos"),
        key.alias("event_key"), "trace_id", F.col("event_id").alias("source_event"),
        F.struct(F.col("tenant_id").alias("tenantId"), event.alias("event"),
                 receipt.alias("policy"), key.alias("eventKey")).alias("envelope"))


# --- requests ---------------------------------------------------------------------------
def digest(tenant: str) -> str:
    return hashlib.sha256(f"key-{tenant}".encode()).hexdigest()


def _key_hash(tenant: Column) -> Column:
    return F.sha2(F.concat(F.lit("key-"), tenant), 256)


def trace_requests(spark: SparkSession, sf_dir: str, broken: bool = True,
                   stream: bool = False) -> DataFrame:
    """One trace request per event.

    With ``broken``, some are spoilt by event id: empty span id (50), a 4097-byte value (53),
    an unknown field (59), trailing data (61), an unknown key (67).
    """
    base = _base(spark, sf_dir, stream)
    eid = F.col("event_id")

    def hits(n: int) -> Column:
        return (eid % n == 0) if broken else F.lit(False)

    def text_attr(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.struct(
            value.alias("stringValue"), F.lit(None).cast("string").alias("intValue"),
            F.lit(None).cast("double").alias("doubleValue")).alias("value"))

    items = F.array(
        text_attr("peer.service", attributes()["peer.service"]),
        F.struct(F.lit("http.status_code").alias("key"), F.struct(
            F.lit(None).cast("string").alias("stringValue"),
            attributes()["http.status_code"].alias("intValue"),
            F.lit(None).cast("double").alias("doubleValue")).alias("value")),
        F.struct(F.lit("value").alias("key"), F.struct(
            F.lit(None).cast("string").alias("stringValue"),
            F.lit(None).cast("string").alias("intValue"),
            F.col("value").alias("doubleValue")).alias("value")),
        text_attr("note", F.when(hits(53), F.repeat(F.lit("x"), 4097)).otherwise(
            F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.test")))))
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.when(hits(50), "").otherwise(F.col("span_id")).alias("spanId"),
        F.col("event_type").alias("name"), items.alias("attributes"),
        F.when(hits(59), F.lit(1)).alias("kind"))
    resource = F.struct(F.array(text_attr(
        "service.name", F.concat(F.lit("svc-"), F.col("event_type")))).alias("attributes"))
    doc = F.to_json(F.struct(F.array(F.struct(
        resource.alias("resource"),
        F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans")))
        .alias("resourceSpans")))
    return base.select(
        F.concat(F.lit("req-"), eid.cast("string")).alias("request_id"),
        F.lit(TRACES_ROUTE).alias("route"), F.lit("POST").alias("method"),
        F.when(hits(67), F.lit("0" * 64)).otherwise(_key_hash(F.col("tenant_id")))
        .alias("key_hash"),
        F.col("ts").alias("received_at"),
        F.when(hits(61), F.concat(doc, F.lit("{}"))).otherwise(doc).alias("body"))


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace requests of up to five spans, and of 101 for every tenth block of events.

    Blocks of 101 events go to one tenant each, by block number; some to an unknown route (remainder 5
    by 7), with another method (6 by 11) or with an unknown key (4 by 5).  A span without id spoils its
    whole request.  Requests of every fourth block are sent again an hour later.
    """
    base = _base(spark, sf_dir)
    eid = F.col("event_id")
    block = F.floor(eid / 101).cast("bigint")
    request = F.when(block % 10 == 3, F.concat(F.lit("big-"), block.cast("string"))).otherwise(F.concat(
        F.lit("few-"), block.cast("string"), F.lit("-"), F.floor((eid % 101) / 5).cast("string")))
    note = F.struct(F.lit("note").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.when(eid % 50 == 0, "").otherwise(F.col("span_id")).alias("spanId"),
                    F.col("event_type").alias("name"), F.array(note).alias("attributes"))
    grouped = base.groupBy(request.alias("request_id"), block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(eid.alias("n"), span.alias("span")))).alias("spans"), F.min("ts").alias("ts"))
    spans_of = F.transform("spans", lambda x: x["span"])
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(spans_of.alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    tenant = F.concat(F.lit("tenant-"), (F.col("block") % 5).cast("string"))
    sent = grouped.withColumn("body", doc).withColumn("again", F.explode(F.when(
        F.col("block") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return sent.select(
        F.concat(F.when(F.col("again") == 1, "again-").otherwise(""), F.col("request_id")).alias("request_id"),
        F.when(F.col("block") % 7 == 5, "/v1/other").otherwise(TRACES_ROUTE).alias("route"),
        F.when(F.col("block") % 11 == 6, "PUT").otherwise("POST").alias("method"), _key_hash(tenant).alias("key_hash"),
        (F.col("ts") + F.make_dt_interval(hours=F.col("again"))).alias("received_at"), "body")


def log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log request per conversation, with a record per turn."""
    record = F.struct(F.col("turn").cast("string").alias("timeUnixNano"),
                      F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("traceId"),
                      F.struct(F.col("text").alias("stringValue")).alias("body"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", record.alias("record")))).alias("turns"))
    records = F.transform("turns", lambda t: t["record"])
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(records.alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return grouped.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("request_id"), F.lit(LOGS_ROUTE).alias("route"),
        F.lit("POST").alias("method"), _key_hash(F.lit(TENANTS[0])).alias("key_hash"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("received_at"), doc.alias("body"))


def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log request per conversation turn, the text as the log body."""
    turns = table(spark, sf_dir, "conversations")
    record = F.struct(
        F.col("turn").cast("string").alias("timeUnixNano"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("traceId"),
        F.upper("role").alias("severityText"),
        F.struct(F.col("text").alias("stringValue")).alias("body"))
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(
        F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    tenant = F.concat(F.lit("tenant-"), (F.col("conv_id") % 4).cast("string"))
    return turns.select(
        F.concat_ws("-", F.lit("log"), "conv_id", "turn").alias("request_id"),
        F.lit(LOGS_ROUTE).alias("route"), F.lit("POST").alias("method"),
        _key_hash(tenant).alias("key_hash"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("received_at"), doc.alias("body"))


def http_requests(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    base = _base(spark, sf_dir, stream)
    kind = F.col("event_type")
    path = (F.when(kind == "click", "/v1/traces")
            .when(kind == "view", F.concat(F.lit("/v1/traces/"), "trace_id"))
            .when(kind == "purchase", "/v1/metrics").when(kind == "signup", "/v1/audit")
            .otherwise("/v1/dependencies"))
    return base.select(
        "ts", F.when(F.col("k") % 2 == 0, "gateway").otherwise("query").alias("service"),
        path.alias("path"), F.when(kind == "error", 503).otherwise(200).alias("code"),
        F.col("value").alias("latency_ms"))


# --- literal dimensions -----------------------------------------------------------------
def _literal(spark: SparkSession, schema, rows: list[tuple]) -> DataFrame:
    # Inline values keep an exact size estimate, so joins with them are broadcast.
    def lit(value) -> str:
        return "NULL" if value is None else "'" + str(value) + "'"

    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    names = ", ".join(f.name for f in schema)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})",)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


_T0, _T1 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def tenants(spark: SparkSession) -> DataFrame:
    return _literal(spark, schemas.TENANTS, [(t, _T0) for t in (*TENANTS, IDLE_TENANT)])


def api_keys(spark: SparkSession) -> DataFrame:
    """One key per tenant, and a disabled one."""
    rows = [(t, digest(t), None, _T0) for t in TENANTS]
    return _literal(spark, schemas.API_KEYS, rows + [(TENANTS[0], digest("old"), _T1, _T0)])


def policies(spark: SparkSession) -> DataFrame:
    """Two versions for tenant-0, one for tenant-1 and tenant-2, none for tenant-3."""
    return _literal(spark, schemas.POLICIES, [
        ("tenant-0", "t0-v1", "user[0-9]+", _T0), ("tenant-0", "t0-v2", "[0-9]{4,}", _T1),
        ("tenant-0", "t0-v2", "svc-[01]", _T0), ("tenant-1", "t1-v1", "svc-3", _T0),
        ("tenant-2", "t2-v1", "er{1,2}or", _T1)])


def broken_policies(spark: SparkSession) -> DataFrame:
    """A rule that cannot be used for tenant-3."""
    return _literal(spark, schemas.POLICIES, [("tenant-1", "t1-v1", "svc-3", _T0), ("tenant-3", "t3-v1", "((a{10}){10}){11}", _T0)])


def retention(spark: SparkSession) -> DataFrame:
    return _literal(spark, schemas.RETENTION, [
        ("tenant-0", "7", _T0), ("tenant-1", "14", _T0), ("tenant-2", "30", _T0)])


# --- state tables derived from the spans ---------------------------------------------------
def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event queued on arrival; published unless its id divides by 3."""
    rows = staging_batch(spark, sf_dir)
    done = F.col("source_event") % 3 != 0
    return rows.select(
        "event_key", "tenant_id", "envelope", done.cast("int").alias("attempts"),
        F.when(done, F.col("received_at") + F.make_dt_interval(secs=F.lit(1)))
        .alias("published_at"), F.col("received_at").alias("created_at"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the events known: persisted (even ids), pending (7), given up (11)."""
    rows = staging_batch(spark, sf_dir)
    eid = F.col("source_event")
    status = (F.when(eid % 11 == 0, "loss_evidenced").when(eid % 7 == 0, "pending")
              .otherwise("persisted"))
    return rows.filter((eid % 2 == 0) | (eid % 7 == 0) | (eid % 11 == 0)).select(
        "event_key", "tenant_id", status.alias("status"), (eid % 3 + 1).cast("int")
        .alias("attempts"), F.when(eid % 11 == 0, "sink_failed").alias("last_error_class"),
        F.col("received_at").alias("created_at"), F.col("received_at").alias("updated_at"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row per sign-up event."""
    return _base(spark, sf_dir).filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), "tenant_id",
        F.concat(F.lit("user_"), F.col("event_type")).alias("action"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("safe_metadata"),
        F.col("ts").alias("created_at"))
