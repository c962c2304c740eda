"""Tail cycles over any cut of the input against a request-by-request model."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import at, batch, empty
from veilspan import schemas
from veilspan.functions.values import hash_sampled
from veilspan.operators import staging
from veilspan.operators.ingest import ACCEPTED
from veilspan.plans.tail import LIVES, TailConfig, open_store, outcomes, tail_cycle

CONFIG = TailConfig(quiet_seconds=2.0, modulo=1, open_cap=4, span_cap=6)


def model(requests, config, end):
    """Decisions and codes, one request after the other; requests are (id, second, tenant, trace, events)."""
    open_, closed, known, codes, decisions = {}, set(), set(), {}, {}

    def quiet(now):
        for key in [k for k, t in open_.items() if t["last"] + config.quiet_seconds <= now]:
            decide(key, "retained_error" if open_[key]["error"] else "retained_healthy_sample")

    def decide(key, reason):
        decisions[key] = (reason, open_.pop(key)["n"])
        closed.add(key)

    for request, second, tenant, trace, events in sorted(requests, key=lambda r: r[1]):
        quiet(second)
        key = (tenant, trace)
        fresh = {e for e in events if (*key, e) not in known}
        codes[request] = 202
        if not fresh:
            continue
        count = open_[key]["n"] if key in open_ else 0
        if key in closed or count + len(fresh) > config.span_cap:
            codes[request] = 503
            continue
        if key not in open_:
            mine = [k for k in open_ if k[0] == tenant]
            if len(mine) >= config.open_cap:
                decide(min(mine, key=lambda k: (open_[k]["first"], k[1])), "evicted_pressure")
            open_[key] = {"first": second, "last": second, "n": 0, "error": False}
        known.update((*key, e) for e in fresh)
        open_[key]["n"] += len(fresh)
        open_[key]["last"] = second
        open_[key]["error"] |= any(e.startswith("e") for e in fresh)
    quiet(end)
    return decisions, codes, set(open_)


def requests_of(seed, n=160):
    rng = random.Random(seed)
    out, second = [], 0.0
    for k in range(n):
        second += rng.choice([0.05, 0.05, 0.1, 0.1, 0.2, 0.3]) if rng.random() < 0.95 else rng.choice([2.0, 2.5, 0.9])
        tenant = rng.choice(["big", "big", "big", "small"])
        trace = f"t{rng.randrange(max(0, k // 2 - 5), k // 2 + 3)}"
        events = [f"{rng.choice('eabcd')}{k}x{i}" for i in range(rng.choice([1, 1, 1, 2, 3, 6]))]
        out.append((f"r{k:03d}", round(second, 2), tenant, trace, events))
    refused = {r for r, code in model(out, CONFIG, 1e9)[1].items() if code != 202}
    again = [r for r in out if r[0] not in refused and rng.random() < 0.1]  # copies of what was taken in
    return out + [(f"{r}-again", round(s + rng.choice([0.01, 5.0]), 2) + 0.003, *more) for r, s, *more in again]


def inbox(spark, requests):
    rows = [(r, s, tenant, trace, e, {"http.status_code": "503" if e.startswith("e") else "200"})
            for r, s, tenant, trace, events in requests for e in events]
    return batch(spark, rows).withColumn("code", F.lit(ACCEPTED))


@pytest.mark.parametrize("cuts", [1, 4, 16])
def test_any_cut_gives_the_decisions_of_the_model(spark, folder, cuts):
    requests = sorted(requests_of(5), key=lambda r: r[1])
    decisions, codes, open_ = model(requests, CONFIG, requests[-1][1])
    assert {r for r, _ in decisions.values()} == {"evicted_pressure", "retained_error", "retained_healthy_sample"}
    assert 503 in codes.values() and sum(r == "evicted_pressure" for r, _ in decisions.values()) > 5
    store = open_store(spark, f"{folder}/state")
    size, got_codes = -(-len(requests) // cuts), {}
    for k in range(0, len(requests), size):
        tail_cycle(store, inbox(spark, requests[k:k + size]), f"{folder}/topic", CONFIG, epoch=k)
        got_codes |= {r.request_id: r.code for r in outcomes(store).collect()}
    got = {(r.tenant_id, r.trace_id): (r.reason, r.span_count) for r in store.read("tail_decisions").collect()}
    assert got == decisions
    assert got_codes == codes
    assert {(r.tenant_id, r.trace_id) for r in store.read("traces_open").collect()} == open_
    kept = {k for k, (reason, _) in decisions.items() if reason.startswith("retained")}
    published = store.read("outbox_published").select("tenant_id", F.col("envelope.event.traceId").alias("t"), "event_key").collect()
    assert {(r.tenant_id, r.t) for r in published} == kept
    assert len(published) == len({r.event_key for r in published}) == sum(n for k, (_, n) in decisions.items() if k in kept)


def lives(spark, rows):
    return spark.createDataFrame([(t, trace, at(a), at(b)) for t, trace, a, b in rows], LIVES)


def test_overlapping_traces_evict_and_consecutive_ones_do_not(spark):
    overlapping = lives(spark, [("a", f"t{i:04d}", i / 1000, 100 + i / 1000) for i in range(1001)])
    assert [(r.trace_id, r.evicted_at) for r in staging.pressure_evictions(overlapping).collect()] == [("t0000", at(1.0))]
    consecutive = lives(spark, [("a", f"t{i:04d}", i * 2.0, i * 2.0 + 2) for i in range(1001)])
    assert staging.pressure_evictions(consecutive).collect() == []
    assert staging.pressure_evictions(overlapping.limit(0)).collect() == []


@pytest.mark.parametrize("points", [7, 40, 100_000])
def test_evictions_do_not_depend_on_the_stretches(spark, points):
    rng = random.Random(2)
    rows = [(tenant, f"{tenant}{i}", start := round(rng.random() * 60, 3), start + rng.choice([0.5, 2, 9, 50]))
            for tenant in ("x", "y", "z") for i in range(120 if tenant != "z" else 9)]
    want = set()
    for tenant in ("x", "y", "z"):
        held = []
        mine = sorted((r for r in rows if r[0] == tenant), key=lambda r: r[2])
        for _, trace, start, end in mine:
            held = [h for h in held if h[2] > start] + [(start, trace, end)]
            if len(held) > 10:
                want.add((tenant, held.pop(0)[1], at(start)))
    got = staging.pressure_evictions(lives(spark, rows), cap=10, points=points).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_a_trace_is_late_from_the_moment_it_is_quiet(spark):
    rows = [("a", 0, "t", "x", "1"), ("b", 1.99, "t", "x", "2"), ("c", 3.99, "t", "x", "3"), ("d", 4, "t", "x", "2"),
            ("e", 9, "t", "x", "4")]
    none = empty(spark, schemas.TAIL_TRACES)
    step = staging.stage_in_time(batch(spark, rows), none, empty(spark, schemas.TAIL_EVENT_KEYS), none)
    assert {(r.request_id, r.reason) for r in step.refused.collect()} == {("c", "late"), ("e", "late")}
    assert sorted(r.request_id for r in step.events.collect()) == ["a", "b"]
    assert [(r.span_count, r.last_seen) for r in step.traces.collect()] == [(2, at(1.99))]
    assert hash_sampled("trace_id", 1) is not None
