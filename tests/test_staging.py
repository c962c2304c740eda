import random
import tempfile
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from helpers import BATCH, NOW, at, batch, empty
from veilspan import schemas
from veilspan.operators import sampling, staging
from veilspan.sources import generate
from veilspan.sources.tables import cut_in


def one_by_one(rows, span_cap=100):
    """Sequential staging of requests in arrival order, without a cap on traces."""
    keys, traces, refused, by_request = set(), {}, {}, {}
    for r in rows:
        by_request.setdefault((r[1], r[0]), []).append(r)
    for (_, request), events in sorted(by_request.items()):
        fresh, need, ok = [], {}, True
        for _, _, tenant, trace, event, *_ in events:
            key = (tenant, trace, event)
            if key in keys or key in fresh:
                continue
            fresh.append(key)
            need[(tenant, trace)] = need.get((tenant, trace), 0) + 1
        for trace, n in need.items():
            if traces.get(trace, 0) + n > span_cap:
                ok = False
        if not ok:
            refused[request] = "span_limit"
            continue
        keys.update(fresh)
        for trace, n in need.items():
            traces[trace] = traces.get(trace, 0) + n
    return keys, traces, refused


def stage(spark, rows, traces=None, keys=None, **kw):
    """One step, with everything written and read back as the tail cycle does."""
    cut = cut_in(tempfile.mkdtemp(prefix="veilspan-stage-"))
    step = staging.stage(batch(spark, rows), traces or empty(spark, schemas.TAIL_TRACES),
                         keys or empty(spark, schemas.TAIL_EVENT_KEYS), cut=cut, **kw)
    return staging.Staged(*[cut(f"out_{f.name}", getattr(step, f.name)) for f in fields(step)])


@pytest.mark.parametrize("seed", range(2))
def test_single_trace_requests_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows, when = [], 0
    for i in range(120):
        tenant, trace = f"t{rng.randrange(2)}", f"trace-{rng.randrange(4)}"
        when += rng.randrange(0, 3)  # some requests arrive at the same moment
        # Request sizes vary, so that small requests fit where large ones did not.
        rows += [(f"r{i:03d}", when, tenant, trace, f"e{i}-{j}")
                 for j in range(rng.choice([1, 1, 2, 5, 9]))]
    keys, traces, refused = one_by_one(rows, span_cap=30)
    step = stage(spark, rows, span_cap=30)
    assert {(r.tenant_id, r.trace_id, r.envelope.event.spanId)
            for r in step.events.collect()} == keys
    assert {r.request_id: r.reason for r in step.refused.collect()} == refused
    assert {(r.tenant_id, r.trace_id): r.span_count
            for r in step.evictable.collect()} == traces


def test_staging_twice_is_staging_once(spark):
    rows = [("r1", 0, "a", "t1", "e1"), ("r1", 0, "a", "t1", "e2"), ("r2", 1, "a", "t2", "e1")]
    first = stage(spark, rows)
    again = stage(spark, rows, first.evictable, first.event_keys)
    assert again.events.count() == 0 and again.refused.count() == 0
    assert sorted(again.evictable.collect()) == sorted(first.evictable.collect())


def test_generations_and_times(spark):
    rows = [("r1", 0, "a", "t", "e1"), ("r1", 0, "a", "t", "e2"), ("r2", 5, "a", "t", "e3"),
            ("r3", 6, "a", "t", "e3")]
    got = stage(spark, rows).evictable.collect()
    assert [(r.generation, r.span_count, r.first_seen, r.last_seen) for r in got] == [
        (3, 3, NOW, at(5))]


def test_closed_trace_refuses_the_whole_request(spark):
    closed = spark.createDataFrame(
        [("a", "old", NOW, NOW, 2, 1, "dropped_healthy_sample", NOW)], schemas.TAIL_TRACES)
    known = spark.createDataFrame([("a:old:e1", "a", "old", NOW)], schemas.TAIL_EVENT_KEYS)
    rows = [("late", 1, "a", "old", "e2"), ("late", 1, "a", "new", "e1"),
            ("again", 1, "a", "old", "e1"), ("fine", 1, "a", "new", "e1")]
    step = stage(spark, rows, closed, known)
    assert {(r.request_id, r.reason) for r in step.refused.collect()} == {("late", "late")}
    # The copy in the refused request does not hide the valid one.
    assert [r.request_id for r in step.events.collect()] == ["fine"]


def test_a_request_that_leans_on_a_refused_copy_is_refused(spark):
    rows = [("r0", 0, "a", "t", f"x{i}") for i in range(3)]
    rows += [("r1", 1, "a", "t", "k1"), ("r1", 1, "a", "t", "k2"), ("r2", 2, "a", "t", "k1")]
    step = stage(spark, rows, span_cap=4)
    assert {(r.request_id, r.reason) for r in step.refused.collect()} == {
        ("r1", "span_limit"), ("r2", "unstaged_copy")}
    assert {r.request_id for r in step.events.collect()} == {"r0"}


def test_same_key_in_two_tenants(spark):
    step = stage(spark, [("r1", 0, "a", "t", "e"), ("r2", 0, "b", "t", "e")])
    assert step.events.count() == 2


def test_pressure(spark):
    rows = generate.generate_pressure(spark, "tenant-a", 1001).select(
        *[F.col(f.name).cast(f.dataType) for f in BATCH])
    cut = cut_in(tempfile.mkdtemp(prefix="veilspan-stage-"))
    step = staging.stage(rows, empty(spark, schemas.TAIL_TRACES),
                         empty(spark, schemas.TAIL_EVENT_KEYS), cut=cut)
    step = staging.Staged(*[cut(f"out_{f.name}", getattr(step, f.name)) for f in fields(step)])
    buffers = staging.to_buffers(step.events)
    evicted = staging.evict_pressure(step.evictable, buffers, NOW)
    assert [(r.trace_id, r.reason, r.retained, r.span_count) for r in evicted.collect()] == [
        ("pressure-trace-0000", "evicted_pressure", False, 1)]
    after = staging.apply_decisions(step.evictable, evicted)
    assert staging.open_trace_counts(after).first().open_traces == 1000
    assert staging.purge_buffers(buffers, evicted).count() == 1000


def test_ready_and_stale_decisions(spark):
    rows = [("r1", 0, "a", "quiet", "e1"), ("r2", 9, "a", "busy", "e1")]
    traces = stage(spark, rows).evictable
    ready = staging.ready_traces(traces, at(10))
    assert [(r.trace_id, r.generation) for r in ready.collect()] == [("quiet", 2)]
    assert staging.ready_traces(traces, at(11)).count() == 2
    assert staging.ready_traces(traces, at(11), limit=0).count() == 1
    verdict = ready.select("tenant_id", "trace_id", (F.col("generation") - 1).alias("generation"),
                           F.lit("retained_error").alias("reason"), F.lit(1).alias("span_count"),
                           F.lit(NOW).alias("created_at"))
    assert staging.apply_decisions(traces, verdict).filter("decision is not null").count() == 0
    fresh = verdict.withColumn("generation", F.col("generation") + 1)
    closed = staging.apply_decisions(traces, fresh)
    assert closed.filter("decision is not null").count() == 1
    # A decided trace is not decided again.
    other = fresh.withColumn("reason", F.lit("retained_slow"))
    assert [r.decision for r in staging.apply_decisions(closed, other)
            .filter("trace_id = 'quiet'").collect()] == ["retained_error"]


DECISIONS = [
    ({"http.status_code": "503"}, "retained_error"), ({"error": "true"}, "retained_error"),
    ({"duration_ms": "1001"}, "retained_slow"), ({"duration_ms": "999"}, None),
    ({"log.severity": "ERROR"}, None), ({"http.status_code": "x"}, None)]


@pytest.mark.parametrize("attributes,reason", DECISIONS)
def test_decisions(spark, attributes, reason):
    bag = F.col("envelope.event.attributes")
    rows = batch(spark, [("r", 0, "a", "smoke-trace-001", "e1"),
                         ("r", 0, "a", "smoke-trace-001", "e2", attributes)])
    got = sampling.decide_traces(rows, bag, modulo=10).collect()
    assert [(r.reason, r.span_count) for r in got] == [(reason or "dropped_healthy_sample", 2)]
    assert got[0].retained is (reason is not None)
    every = sampling.decide_traces(rows, bag, modulo=1).first()
    assert every.reason == (reason or "retained_healthy_sample") and every.retained


def test_error_goes_before_slow_and_defaults(spark):
    rows = batch(spark, [("r", 0, "a", "t", "e1", {"duration_ms": "5000"}),
                         ("r", 0, "a", "t", "e2", {"error": "true"})])
    got = sampling.decide_traces(rows, F.col("envelope.event.attributes"), modulo=0, slow_ms=-1)
    assert got.first().reason == "retained_error"


def test_outbox_rows(spark):
    rows = batch(spark, [("r", 0, "a", "kept", "e1"), ("r", 0, "a", "kept", "e2"),
                         ("r", 0, "a", "dropped", "e1")])
    decisions = spark.createDataFrame(
        [("a", "kept", "retained_error", True, 2, NOW), ("a", "dropped", "x", False, 1, NOW)],
        schemas.TAIL_DECISIONS)
    buffers = staging.to_buffers(rows)
    outbox = staging.enqueue_retained(buffers, decisions, empty(spark, schemas.TAIL_OUTBOX), NOW)
    assert sorted(r.event_key for r in outbox.collect()) == ["a:kept:e1", "a:kept:e2"]
    assert staging.enqueue_retained(buffers, decisions, outbox, NOW).count() == 0
    assert staging.purge_buffers(buffers, decisions).count() == 0


def test_hot_trace_is_folded_over_few_rows(spark):
    rows = [(f"r{i:05d}", i, "a", "hot", f"e{i}") for i in range(3000)]
    refused = staging.enforce_span_limit(batch(spark, rows), empty(spark, schemas.TAIL_TRACES))
    assert refused.count() == 2900
    plan = refused._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the row limit also runs before the shuffle
