import json

import pytest
from pyspark.sql import functions as F

from helpers import NOW, SEEDS, attribute, at, keys, log_body, policies, requests, span, trace_body
from veilspan.functions.values import as_ts
from veilspan.operators import checks, ingest, policy
from veilspan.operators import spans as read
from veilspan.plans.persist import open_ledger, persist_batch
from veilspan.plans.tail import TailConfig, open_store, outcomes, tail_cycle
from veilspan.sources import tables, topic

CONFIG = TailConfig(modulo=1)


def take_in(spark, store, path, rows, config=CONFIG, **kw):
    judged = ingest.accept_requests(requests(spark, rows), keys(spark),
                                    policy.active_policies(policies(spark)),
                                    deploy_expressions=["INV-[0-9]+"])
    tail_cycle(store, ingest.inbox_rows(judged), path, config, **kw)
    return {r.request_id: r.code for r in outcomes(store).collect()}


def body(trace, *ids, **attributes):
    return trace_body(*[span(trace, i, attributes=[
        attribute(k.replace("__", "."), stringValue=v) for k, v in attributes.items()])
        for i in ids])


def decisions(store):
    return {(r.trace_id, r.reason, r.span_count) for r in store.read("tail_decisions").collect()}


def test_life_of_a_trace(spark, folder):
    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    got = take_in(spark, store, path, [
        ("r1", "/v1/traces", body("t1", "a", "b", http__status_code="503")),
        ("r2", "/v1/traces", body("t2", "a"), at(5)),
        ("bad", "/v1/traces", '{"resourceSpans":[]}')])
    assert got == {"r1": 202, "r2": 202, "bad": 400}
    # t1 is quiet by the newest arrival, t2 is not.
    assert decisions(store) == {("t1", "retained_error", 2)}
    assert [r.trace_id for r in store.read("traces_open").collect()] == ["t2"]
    assert store.read("tail_buffers").count() == 1
    assert store.read("outbox_pending").count() == 0
    sent = topic.decode_messages(topic.read_topic(spark, path))
    assert sorted(r.event_key for r in sent.collect()) == ["tenant-a:t1:a", "tenant-a:t1:b"]

    # A late event refuses its request; a repeated one is accepted without effect.
    got = take_in(spark, store, path, [
        ("late", "/v1/traces", body("t1", "c"), at(20)),
        ("again", "/v1/traces", body("t1", "a"), at(20)),
        ("tick", "/v1/traces", body("t3", "a"), at(20))])
    assert got == {"late": 503, "again": 202, "tick": 202}
    assert decisions(store) == {("t1", "retained_error", 2),
                                ("t2", "retained_healthy_sample", 1)}
    assert topic.read_topic(spark, path).count() == 3
    assert store.read("outbox_published").count() == 3


def test_epoch_is_taken_in_once(spark, folder):
    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    rows = [("r", "/v1/traces", body("t", "a")), ("x", "/v1/traces", body("u", "a"), at(9))]
    take_in(spark, store, path, rows, epoch=0)
    version = store.version()
    take_in(spark, store, path, rows, epoch=0)
    assert store.version() == version and topic.read_topic(spark, path).count() == 1


def test_failed_publish_leaves_no_trace_in_the_state(spark, folder, monkeypatch):
    import veilspan.plans.tail as module

    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    rows = [("r", "/v1/traces", body("t", "a")), ("x", "/v1/traces", body("u", "a"), at(9))]

    def broken(*_):
        raise OSError("topic away")

    with monkeypatch.context() as patch:
        patch.setattr(module, "write_topic", broken)
        with pytest.raises(OSError):
            take_in(spark, store, path, rows, epoch=0)
    assert store.version() == -1 and store.read("outbox_published").count() == 0
    take_in(spark, store, path, rows, epoch=0)
    assert decisions(store) == {("t", "retained_healthy_sample", 1)}
    assert store.read("outbox_published").count() == 1


def test_pressure_and_accounting(spark, folder):
    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    rows = [(f"r{i:02d}", "/v1/traces", body(f"t{i:02d}", "a", "b"), at(i / 100))
            for i in range(30)]
    take_in(spark, store, path, rows, TailConfig(open_cap=10, modulo=1))
    got = decisions(store)
    assert {t for t, reason, n in got if (reason, n) == ("evicted_pressure", 2)} == {
        f"t{i:02d}" for i in range(20)}
    open_now = {r.trace_id for r in store.read("traces_open").collect()}
    # Every staged trace is either open or decided, and none is both.
    assert open_now | {t for t, *_ in got} == {f"t{i:02d}" for i in range(30)}
    assert not open_now & {t for t, *_ in got}


def test_quiet_traces_are_decided_however_many(spark, folder):
    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    rows = [(f"r{i}", "/v1/traces", body(f"t{i}", "a", http__status_code="503"), at(3 * i))
            for i in range(6)]
    take_in(spark, store, path, rows, TailConfig(open_cap=2, modulo=1))
    assert decisions(store) == {(f"t{i}", "retained_error", 1) for i in range(5)}
    assert [r.trace_id for r in store.read("traces_open").collect()] == ["t5"]


def test_nothing_stored_holds_the_seeds(spark, folder):
    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    secret, email, customer = SEEDS
    rows = [("r", "/v1/traces", trace_body(span(attributes=[
        attribute("authorization", stringValue=secret), attribute("email", stringValue=email),
        attribute("order", stringValue=customer)]))),
        ("l", "/v1/logs", log_body({"body": {"stringValue": f"{email} {customer}"}}), at(9)),
        ("bad", "/v1/traces", trace_body(span(name=""), span(attributes=[
            attribute("x", stringValue=secret)])), at(9))]
    take_in(spark, store, path, rows)
    written = {name: store.read(name) for name in store.schemas if store._names(name)}
    written["topic"] = topic.read_topic(spark, path)
    scan = checks.leak_scan({n: df for n, df in written.items()}, SEEDS).collect()
    assert {r.matches for r in scan} == {0}
    assert {r.table_name for r in scan if r.inspected} >= {
        "inbox", "staged", "topic", "tail_decisions", "tail_event_keys", "outbox_published"}


def test_persist_is_idempotent(spark, folder):
    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    take_in(spark, store, path, [("r", "/v1/traces", body("t", "a", "b")),
                                 ("l", "/v1/logs", log_body({"traceId": "t"}), at(1)),
                                 ("x", "/v1/traces", body("u", "a"), at(99))])
    ledger, spans = open_ledger(spark, f"{folder}/ledger"), f"{folder}/spans"
    messages = topic.read_topic(spark, path)
    persist_batch(ledger, messages.unionByName(messages), spans, NOW)
    persist_batch(ledger, messages, spans, at(60))
    rows = tables.read_spans(spark, spans)
    assert rows.count() == 3 and tables.scan_spans(spark, spans).count() == 3
    assert {(r.status, r.attempts) for r in ledger.read("ledger_settled").collect()} == {
        ("persisted", 1)}
    usage = read.usage_metrics(rows, at(60), "tenant-a").first()
    assert (usage.span_count, usage.trace_count, usage.log_count, usage.error_count) == (
        2, 1, 1, 0)
    found = read.trace_lookup(rows, "tenant-a", "t").collect()
    assert len(found) == 3 and read.trace_lookup(rows, "tenant-b", "t").count() == 0


def test_failed_write_leaves_the_claim_pending(spark, folder):
    path = f"{folder}/topic"
    store = open_store(spark, f"{folder}/state")
    take_in(spark, store, path, [("r", "/v1/traces", body("t", "a")),
                                 ("x", "/v1/traces", body("u", "a"), at(9))])
    ledger, spans = open_ledger(spark, f"{folder}/ledger"), f"{folder}/spans"

    def broken(rows, target):
        raise OSError("table away")

    for _ in range(2):
        with pytest.raises(OSError):
            persist_batch(ledger, topic.read_topic(spark, path), spans, NOW, broken, epoch=0)
    assert [(r.status, r.attempts) for r in ledger.read("ledger_open").collect()] == [
        ("pending", 2)]
    persist_batch(ledger, topic.read_topic(spark, path), spans, at(5), epoch=0)
    assert [(r.status, r.attempts) for r in ledger.read("ledger_settled").collect()] == [
        ("persisted", 3)]
    assert ledger.read("ledger_open").count() == 0
    assert tables.read_spans(spark, spans).count() == 1


def test_malformed_messages_fail_loudly(spark):
    good = json.dumps({"tenantId": "a", "eventKey": "a:e", "event": {"eventId": "e"},
                       "policy": {"policyVersion": "v1"}})
    rows = spark.createDataFrame([("a:e", good), ("k", "{"), ("k", '{"tenantId":"a"}'),
                                  ("k", None)], "key string, value string")
    with pytest.raises(Exception, match="envelope invalid"):
        topic.decode_messages(rows).collect()
    flagged = topic.decode_messages(rows, "flag")
    assert [r.event_key for r in flagged.filter("not malformed").collect()] == ["a:e"]
    evidence = topic.quarantine(flagged)
    assert evidence.count() == 3 and evidence.columns == ["key_digest", "value_bytes"]


def test_wire_format(spark):
    from helpers import batch

    value = topic.to_messages(batch(spark, [("r", 0, "a", "t", "e", {"k": "v"})])).first().value
    assert json.loads(value) == {
        "tenantId": "a", "eventKey": "a:t:e",
        "event": {"eventId": "t:e", "signal": "trace", "traceId": "t", "spanId": "e",
                  "name": "checkout", "attributes": {"k": "v"}},
        "policy": {"policyVersion": "v1", "redactedPaths": []}}


def test_store_versions(spark, folder):
    from veilspan import schemas

    store = tables.StateStore(spark, folder, {"tenants": schemas.TENANTS})
    rows = [spark.createDataFrame([(name, NOW)], schemas.TENANTS) for name in "abcd"]
    names = lambda: sorted(r.id for r in tables.read_meta(store, "tenants").collect())
    assert names() == [] and store.version() == -1
    tables.write_meta(store, "tenants", rows[0])
    store.commit(append={"tenants": rows[1]})
    assert names() == ["a", "b"]
    version = store.begin()
    store.write(version, "tenants", rows[2], full=True)  # never published
    assert names() == ["a", "b"]
    store.commit(append={"tenants": rows[3]})
    assert names() == ["a", "b", "d"]
    tables.write_meta(store, "tenants", rows[2])
    store.vacuum()
    assert names() == ["c"] and len(store._names("tenants")) == 1
    assert as_ts(F.lit(1)) is not None


def test_retention_and_deletion_jobs(spark, folder):
    import datetime as dt
    import os

    from veilspan import schemas
    from veilspan.operators import lifecycle
    from veilspan.plans.lifecycle import run_deletion, run_retention

    store, path = open_store(spark, f"{folder}/state"), f"{folder}/topic"
    take_in(spark, store, path, [("r", "/v1/traces", body("t", "a")),
                                 ("x", "/v1/traces", body("u", "a"), at(9))])
    old, new = f"{folder}/spans", f"{folder}/spans-2"
    persist_batch(open_ledger(spark, f"{folder}/ledger"), topic.read_topic(spark, path), old, NOW)
    days = spark.createDataFrame([("tenant-a", 7)], "tenant_id string, retention_days int")
    early, late = NOW + dt.timedelta(days=6), NOW + dt.timedelta(days=8)
    report = run_retention(store, old, new, days, early)
    assert {r.purged for r in report.collect()} == {0} and tables.read_spans(spark, new).count() == 1
    report = run_retention(store, new, old, days, late)
    assert {(r.table_name, r.kept, r.purged) for r in report.collect()} == {
        ("spans", 0, 1), ("tail_outbox", 0, 1), ("tail_event_keys", 0, 2),
        ("tail_decisions", 0, 1), ("tail_traces", 0, 1)}
    # The open trace is kept whatever its age.
    assert [r.trace_id for r in store.read("traces_open").collect()] == ["u"]
    assert store.read("tail_buffers").count() == 1

    with pytest.raises(ValueError):
        run_deletion(spark, store, new, "tenant-a", "yes", late)
    run_deletion(spark, store, new, "tenant-a", lifecycle.DELETE_PHRASE, late)
    left = {n: store.read(n).count() for n in store.schemas if "tenant_id" in
            store.schemas[n].fieldNames()}
    assert {n for n, count in left.items() if count} == {"audit_events"}
    assert not os.path.exists(f"{new}/tenant_id=tenant-a")
    assert store.read("audit_events").first().action == lifecycle.DELETE_ACTION
    assert isinstance(schemas.AUDIT["id"].dataType.simpleString(), str)
