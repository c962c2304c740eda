import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import NOW, at, empty
from veilspan import schemas
from veilspan.operators import checks, ingest, lifecycle, observe, redact
from veilspan.operators import spans as read
from veilspan.sources import generate, reports, tables

HOUR = dt.timedelta(hours=1)


def row(key="a:1", tenant="a", signal="trace", trace="t", span="s", parent="", attributes=None,
        when=NOW, paths=(), name="n"):
    return (tenant, key, key.split(":")[1], signal, trace, span, parent, name, attributes or {},
            "v1", list(paths), when)


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SPANS)


def test_usage(spark):
    rows = spans(
        spark, row("a:1", attributes={"http.status_code": "500"}),
        row("a:1", attributes={"http.status_code": "200"}, when=NOW - HOUR),
        row("a:2", trace="u", attributes={"error": "true"}), row("a:3", signal="log"),
        row("a:4", when=NOW - 24 * HOUR), row("a:5", when=NOW - 24 * HOUR - dt.timedelta(seconds=1)),
        row("b:1", "b", attributes={"http.status_code": "2147483648"}),
        row("a:6", attributes={"error": "true"}, when=NOW - 2 * HOUR),
        row("a:6", signal="log", when=NOW - HOUR))
    tenants = spark.createDataFrame([(t, NOW) for t in ("a", "b", "idle")], schemas.TENANTS)
    got = {r.tenant_id: (r.span_count, r.trace_count, r.error_count, r.log_count)
           for r in read.usage_metrics(rows, NOW, tenants=tenants).collect()}
    # The newer log version of a:6 hides its error span.
    assert got == {"a": (3, 2, 2, 2), "b": (1, 1, 0, 0), "idle": (0, 0, 0, 0)}
    one = read.error_rate(read.usage_metrics(rows, NOW, "idle", tenants)).collect()
    assert [(r.tenant_id, r.window_hours, r.error_rate) for r in one] == [("idle", 24, 0.0)]


def test_dependencies(spark):
    calls = generate.generate_calls(spark, 5, 4)
    stored = calls.select(
        F.lit("a").alias("tenant_id"), F.col("event.eventId").alias("event_key"),
        F.lit("trace").alias("signal_type"), F.col("event.attributes").alias("attributes"),
        F.lit(NOW).alias("ingested_at"))
    edges = read.service_dependencies(stored, NOW, "a").collect()
    assert [(e.source, e.target, e.edge_count) for e in edges] == [
        (f"service-{n}", f"service-{n + 1}", 5) for n in range(3)]
    linked = calls.select("event.*").alias("c").join(
        calls.select("event.*").alias("p"), F.expr("c.parentSpanId = p.spanId AND c.traceId = p.traceId"))
    assert {(r[0], r[1]) for r in linked.select("p.name", "c.name").collect()} == {
        (f"call {n}", f"call {n + 1}") for n in range(3)} and linked.count() == 15


def test_lookup(spark):
    rows = spans(spark, row("a:1", when=NOW), row("a:2", when=NOW - HOUR),
                 row("a:3", trace="t", when=NOW - HOUR), row("a:3", trace="moved", when=NOW),
                 row("b:1", "b"))
    assert [r.event_key for r in read.trace_lookup(rows, "a", "t").collect()] == ["a:2", "a:1"]
    assert read.trace_lookup(rows, "a", "none").count() == 0
    assert read.trace_lookup(rows, "a", "t' OR 1=1").count() == 0
    ids = spark.createDataFrame([("a", "t"), ("a", "moved"), ("b", "none")],
                                "tenant_id string, trace_id string")
    assert sorted(r.event_key for r in read.trace_lookup_many(rows, ids).collect()) == [
        "a:1", "a:2", "a:3"]


def test_dedupe_is_idempotent_and_order_free(spark):
    rng = random.Random(1)
    data = [row(f"a:{rng.randrange(20)}", when=at(rng.randrange(3)), name=f"n{i}")
            for i in range(100)]
    once = read.dedupe_latest(spans(spark, *data))
    rng.shuffle(data)
    other = read.dedupe_latest(spans(spark, *data))
    assert sorted(once.drop("attributes").collect()) == sorted(other.drop("attributes").collect())
    assert read.dedupe_latest(once).count() == once.count() == len({r[1] for r in data})


def test_timeline(spark):
    rows = spans(spark, row("a:1", span="", signal="log", paths=["attributes.x"]),
                 row("a:2", parent="p"), row("a:3"))
    got = {r.event_key: (r.title, r.span_label, r.relation, r.redacted_fields)
           for r in read.trace_timeline(rows).collect()}
    assert got == {"a:1": ("Log record", "unlinked", "Trace-linked sanitized log", "attributes.x"),
                   "a:2": ("n", "s", "Causal parent: p", "none"),
                   "a:3": ("n", "s", "Trace root", "none")}


def test_span_table_prunes(spark, folder):
    tables.write_spans(spans(spark, row("a:1"), row("b:1", "b"),
                             row("a:2", when=NOW - 48 * HOUR)), folder)
    stored = tables.scan_spans(spark, folder)
    usage = read.usage_metrics(stored, NOW, tenant="a")
    plan = usage._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "tenant_id" in pruned and "ingest_date" in pruned and "attributes" not in plan
    assert tables.scan_spans(spark, folder, since=F.lit(NOW)).count() == 2
    assert usage.first().span_count == 1
    assert tables.read_spans(spark, folder).columns == [f.name for f in schemas.SPANS]
    tables.drop_tenant_spans(spark, folder, "a")
    assert [r.tenant_id for r in tables.read_spans(spark, folder).collect()] == ["b"]


def test_timelines_are_bounded(spark):
    audit = spark.createDataFrame(
        [(i, "a" if i % 2 else "b", "x", {}, NOW) for i in range(300)], schemas.AUDIT)
    got = [r.id for r in read.audit_timeline(audit, "a", 0).collect()]
    assert got == list(range(299, 99, -2)) and read.audit_timeline(audit, "a", 3).count() == 3
    decisions = spark.createDataFrame(
        [("a", f"t{i:03d}", "x", False, 1, at(i)) for i in range(150)], schemas.TAIL_DECISIONS)
    assert read.sampling_decisions(decisions, "a", 500).count() == 100
    assert read.sampling_decisions(decisions, None).count() == 100
    assert read.sampling_decisions(decisions, "b").collect() == []


def _state(spark):
    old, new = NOW - 40 * 24 * HOUR, NOW
    trace = lambda name, when, decided: (
        "a", name, when, when, 1, 1, "retained_error" if decided else None, decided)
    return {
        "spans": spans(spark, row("a:1", when=old), row("a:2"), row("x:1", "x", when=old)),
        "tail_outbox": spark.createDataFrame(
            [("a:1", "a", None, 1, old, old), ("a:2", "a", None, 0, None, old),
             ("a:3", "a", None, 1, new, new)], schemas.TAIL_OUTBOX),
        "tail_event_keys": spark.createDataFrame([("a:1", "a", "t", old), ("a:2", "a", "t", new)],
                                                 schemas.TAIL_EVENT_KEYS),
        "tail_decisions": spark.createDataFrame([("a", "t", "x", True, 1, old)],
                                                schemas.TAIL_DECISIONS),
        "tail_traces": spark.createDataFrame(
            [trace("t", old, old), trace("open", old, None), trace("n", old, new)],
            schemas.TAIL_TRACES),
        "tail_buffers": spark.createDataFrame([("a:2", "a", "open", None, old)],
                                              schemas.TAIL_BUFFERS),
        "delivery_ledger": spark.createDataFrame([("a:1", "a", "persisted", 1, None, old, old)],
                                                 schemas.LEDGER),
        "audit_events": spark.createDataFrame([(7, "a", "x", {}, old)], schemas.AUDIT)}


def test_retention(spark):
    tenants = spark.createDataFrame([("a", NOW), ("b", NOW)], schemas.TENANTS)
    days = spark.createDataFrame([("b", 7, NOW)], schemas.RETENTION)
    policies = lifecycle.retention_policies(tenants, days)
    assert {r.tenant_id: r.retention_days for r in policies.collect()} == {"a": 30, "b": 7}
    kept, report = lifecycle.apply_retention(_state(spark), policies, NOW)
    assert {(r.table_name, r.purged) for r in report.filter("tenant_id = 'a'").collect()} == {
        ("spans", 1), ("tail_outbox", 1), ("tail_event_keys", 1), ("tail_decisions", 1),
        ("tail_traces", 1)}
    assert sorted(r.trace_id for r in kept["tail_traces"].collect()) == ["n", "open"]
    assert sorted(r.event_key for r in kept["tail_outbox"].collect()) == ["a:2", "a:3"]
    # A tenant without a row in the tenant table never expires.
    assert sorted(r.event_key for r in kept["spans"].collect()) == ["a:2", "x:1"]
    edge = spans(spark, row("a:1", when=NOW - 30 * 24 * HOUR))
    assert lifecycle.expire_spans(edge, policies, NOW).count() == 1


@pytest.mark.parametrize("days", [0, -1, 3651, 4000])
def test_nothing_expires_under_an_invalid_retention_row(spark, days):
    tenants = spark.createDataFrame([("a", NOW), ("b", NOW)], schemas.TENANTS)
    rows = spark.createDataFrame([("b", 3650, NOW), ("a", days, NOW)], schemas.RETENTION)
    policies = lifecycle.retention_policies(tenants, rows)
    assert {r.tenant_id: r.retention_days for r in policies.collect()} == {"a": None, "b": 3650}
    _, report = lifecycle.apply_retention(_state(spark), policies, NOW)
    assert report.filter("tenant_id = 'a'").agg(F.sum("purged")).first()[0] == 0


def test_deletion(spark):
    state = _state(spark)
    for phrase in ("", "delete_sanitized_telemetry"):
        with pytest.raises(ValueError):
            lifecycle.delete_tenant(state, "a", phrase, NOW)
    left = lifecycle.delete_tenant(state, "a", lifecycle.DELETE_PHRASE, NOW)
    census = {r.table_name: r.row_count for r in checks.tail_row_census(left, "a").collect()}
    assert census == {"delivery_ledger": 1, "audit_events": 2}
    event = left["audit_events"].orderBy(F.desc("id")).first()
    assert (event.id, event.action, event.safe_metadata["state"]) == (
        8, "tenant_telemetry_deletion_requested", "mutation_requested")
    assert left["spans"].count() == 1
    assert lifecycle.delete_tenant(state, "a", lifecycle.DELETE_PHRASE, NOW, True)[
        "delivery_ledger"].count() == 0


def percentile(values, p):
    return sorted(values)[(len(values) - 1) * p // 100]


@pytest.mark.parametrize("size,accuracy", [(1, 100), (2, 100), (7, 100), (100, 100), (101, 100),
                                           (5000, 100), (3000, 1000)])
def test_percentiles(spark, size, accuracy):
    rng = random.Random(size)
    values = [rng.choice([rng.random() * 1000, float(rng.randrange(5))]) for _ in range(size)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    ps = (0, 1, 50, 95, 99, 100)
    got = {r.percentile: r.value
           for r in observe.latency_percentiles(df, ["g"], "v", ps, accuracy).collect()}
    assert got == {p: percentile(values, p) for p in ps}


def test_rates_and_summary(spark):
    df = spark.createDataFrame(
        [(at(i), "gateway", "/v1/traces", 503 if i % 3 == 0 else 202, float(i))
         for i in range(60)], schemas.HTTP_REQUESTS)
    rate = observe.request_rate(df).first()
    assert (rate.requests, rate.rate, rate.error_rate_5xx) == (60, 1.0, 20 / 60)
    assert observe.request_rate(df, slide="30 seconds").count() == 3
    outcome = {(r.route, r.code): r.requests for r in observe.http_outcomes(df).collect()}
    assert outcome == {("ingest", 503): 20, ("ingest", 202): 40}
    run = observe.run_summary(df.withColumn("accepted", F.col("code") == 202), ["service"]).first()
    assert (run.sent, run.accepted, run.failed, run.elapsed_millis) == (60, 40, 20, 59000.0)


GOOD_RUN = {"startedAt": "2026-01-01T00:00:00Z", "finishedAt": "2026-01-01T00:10:00Z",
            "targetPerSecond": 5000, "durationSeconds": 600, "elapsedMillis": 600000,
            "achievedPerSecond": 5000, "sent": 3000000, "accepted": 3000000, "failed": 0,
            "p50Millis": 1, "p95Millis": 2, "p99Millis": 3, "traceSamples": ["synthetic-id"]}
GOOD_LOOKUP = {"p50Millis": 1, "p95Millis": 2, "p99Millis": 3, "lookupPass": True}


@pytest.mark.parametrize("change,failing", [
    ({}, set()), ({"targetPerSecond": 4999}, {"target"}), ({"durationSeconds": 599}, {"duration"}),
    ({"startedAt": None}, {"timestamps"}), ({"traceSamples": []}, {"trace_samples"}),
    ({"accepted": 2999999}, {"no_failures"}), ({"failed": 1}, {"no_failures"}),
    ({"elapsedMillis": 599999}, {"elapsed"}), ({"achievedPerSecond": 4999.9}, {"throughput"}),
    ({"p50Millis": None}, {"finite_numbers"}), ({"lookup": {"p95Millis": 3001}}, {"lookup_p95"}),
    ({"lookup": {"lookupPass": False}}, {"lookup_p95"})])
def test_gates(spark, folder, change, failing):
    change = dict(change)
    lookup = {**GOOD_LOOKUP, **change.pop("lookup", {})}
    for name, doc in (("run", {**GOOD_RUN, **change}), ("lookup", lookup)):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(doc, f, indent=2)
    runs = reports.read_bench_runs(spark, f"{folder}/run.json").withColumn("run_id", F.lit(1))
    looks = reports.read_bench_lookups(spark, f"{folder}/lookup.json").withColumn("run_id", F.lit(1))
    gates = checks.bench_gates(runs, looks).collect()
    assert len(gates) == 9 and {g.gate for g in gates if not g.passed} == failing


def test_leak_scan(spark):
    df = spark.createDataFrame(
        [({"k": 'say "hi"\n'}, ["x"], ("deep-seed",)), ({"key-seed": ""}, [], ("",))],
        "m map<string,string>, a array<string>, s struct<v: string>")
    got = [r.matches for r in checks.leak_scan(
        {"t": df}, ['"hi"\n', "deep-seed", "key-seed", "x", "absent"]).orderBy("marker_no")
        .collect()]
    assert got == [1, 1, 1, 1, 0]
    nothing = checks.leak_scan({"t": df.limit(0)}, ["x"]).first()
    assert nothing.inspected == 0 and not nothing.passed
    with pytest.raises(ValueError):
        checks.leak_scan({"t": df}, [""])


def test_lookup_pushes_the_range_of_keys(spark, folder):
    rows = [row(f"a:t{n // 4}-{n}", trace=f"t{n // 4}", when=NOW - n * HOUR / 60) for n in range(400)]
    rows += [row("a:t7-28", trace="moved", when=NOW + HOUR), row("a:t7-late", trace="t7", when=NOW + HOUR)]
    tables.write_spans(spans(spark, *rows), folder)
    stored = tables.scan_spans(spark, folder).select(*schemas.SPANS.fieldNames())
    found = read.trace_lookup(stored, "a", "t7")
    assert {r.event_key for r in found.collect()} == {"a:t7-29", "a:t7-30", "a:t7-31", "a:t7-late"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("DataFilters: ")[1].split(", Format")[0] for x in plan.splitlines() if "DataFilters" in x]
    assert any("event_key" in f and "Subquery" in f and ">=" in f for f in filters)
    many = read.trace_lookup_many(stored, spark.createDataFrame([("a", "t7"), ("a", "moved")], "tenant_id string, trace_id string"))
    assert {r.event_key for r in many.collect()} == {"a:t7-28", "a:t7-29", "a:t7-30", "a:t7-31", "a:t7-late"}
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("attributes") and plan.count("parquet") == 1


def test_percentiles_of_wide_brackets(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), float(rng.randrange(40))) for _ in range(3000)] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.percentile): (r.samples, r.value) for r in observe.latency_percentiles(df, ["g"], "v", accuracy=50).collect()}
    for g in ("a", "b", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for p in (50, 95, 99):
            assert got[g, p] == (len(values), values[(len(values) - 1) * p // 100])


def test_audit_ids_follow_time_action_and_metadata(spark):
    rows = [("a", action, {"k": str(k)}, NOW - k % 3 * HOUR) for k in range(20) for action in ("x", "y")]
    events = spark.createDataFrame(rows, "tenant_id string, action string, safe_metadata map<string,string>, created_at timestamp")
    old = spark.createDataFrame([(7, "a", "old", {}, NOW)], schemas.AUDIT)
    got = sorted(lifecycle.append_audit(old, events.repartition(3)).collect())[1:]
    want = sorted(rows, key=lambda r: (r[3], r[1], json.dumps([{"key": "k", "value": r[2]["k"]}])))
    assert [(r.id, r.action, r.safe_metadata) for r in got] == [(8 + n, r[1], r[2]) for n, r in enumerate(want)]


def test_generated_load(spark):
    rows = generate.generate_spans(spark, 250, 100)
    assert sorted(rows.collect()) == sorted(generate.generate_spans(spark, 250, 100).collect())
    decoded = ingest.decode_requests(rows).select(F.size("events").alias("n"))
    assert sorted(r.n for r in decoded.collect()) == [50, 100, 100]


def test_mask_text_reads_whole_texts(spark):
    text = "w " * 200000 + "person@example.test"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = {r.id: r.text for r in redact.mask_text(df, "text", ["nothing"]).collect()}
    assert got[1].endswith("w [REDACTED_EMAIL]") and got[2] is None
    assert empty(spark, schemas.TENANTS).count() == 0
