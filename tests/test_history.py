"""Tables by day, persistence without history and retention in place."""

import datetime as dt
import os

from pyspark.sql import functions as F

from helpers import NOW, at, batch, empty, envelope
from test_reports import row, spans
from veilspan import schemas
from veilspan.operators import staging
from veilspan.operators.ingest import ACCEPTED
from veilspan.plans import tail
from veilspan.plans.lifecycle import expire_span_partitions
from veilspan.plans.persist import open_ledger
from veilspan.plans.tail import TailConfig, open_store, outcomes, tail_cycle
from veilspan.sources import tables, topic
from veilspan.streaming import batches

KEYS = {"tail_event_keys": schemas.TAIL_EVENT_KEYS}


def key_rows(spark, *rows):
    return spark.createDataFrame([(f"k{n}", "a", "t", when) for n, when in rows], schemas.TAIL_EVENT_KEYS)


def test_files_read_stay_few_over_many_batches(spark, folder):
    store = tables.StateStore(spark, folder, KEYS)
    files, days = [], [NOW + dt.timedelta(days=n // 25) for n in range(50)]
    for n, when in enumerate(days):
        store.commit(append={"tail_event_keys": key_rows(spark, (n, when)).coalesce(1)})
        if n % tables.MERGE_EVERY == tables.MERGE_EVERY - 1:
            store.merge_days("tail_event_keys", when.date() - dt.timedelta(days=1))
        files.append(len(store.read("tail_event_keys").inputFiles()))
    assert max(files) <= 2 + tables.MERGE_EVERY and max(files[32:]) <= max(files[:16]) + 2
    assert {r.event_key for r in store.read("tail_event_keys").collect()} == {f"k{n}" for n in range(50)}
    first_day = store.read_days("tail_event_keys", last=NOW.date())
    assert {r.event_key for r in first_day.collect()} == {f"k{n}" for n in range(25)}
    assert len(store._names("_commits")) <= 3


def test_rows_of_a_failed_attempt_are_not_seen_and_go(spark, folder):
    store = tables.StateStore(spark, folder, KEYS)
    store.commit(append={"tail_event_keys": key_rows(spark, (1, NOW), (2, NOW + dt.timedelta(days=2)))})
    untouched = {f for f in store.read_days("tail_event_keys").inputFiles() if "2026-08-03" in f}
    version = store.begin()
    store.write(version, "tail_event_keys", key_rows(spark, (3, NOW), (4, NOW + dt.timedelta(days=1))), full=False)
    names = lambda: sorted(r.event_key for r in store.read("tail_event_keys").collect())
    assert names() == ["k1", "k2"]  # not published
    store.commit(append={"tail_event_keys": key_rows(spark, (5, NOW))})
    assert names() == ["k1", "k2", "k5"]
    assert untouched < set(store.read("tail_event_keys").inputFiles())
    store.commit(replace={"tail_event_keys": key_rows(spark, (6, NOW))})
    assert names() == ["k6"]
    store.vacuum()
    assert names() == ["k6"] and len(store._names("tail_event_keys")) == 1


def test_a_cycle_reads_only_the_days_it_needs(spark, folder, monkeypatch):
    store, asked = open_store(spark, f"{folder}/state"), []
    read_days, read = store.read_days, store.read
    monkeypatch.setattr(store, "read_days", lambda name, *a, **k: asked.append((name, a, k)) or read_days(name, *a, **k))
    monkeypatch.setattr(store, "read", lambda name: asked.append((name, (), {})) or read(name))
    take = lambda rows: tail_cycle(store, batch(spark, rows).withColumn("code", F.lit(ACCEPTED)), f"{folder}/topic",
                                   TailConfig(modulo=1, keep_days=5))
    day = 86400
    take([("a", 0, "t", "x", "1"), ("b", 10, "t", "y", "1")])
    asked.clear()
    take([("again", 2 * day, "t", "x", "1"), ("late", 2 * day, "t", "x", "2"), ("c", 2 * day + 10, "t", "z", "1")])
    assert {r.request_id: r.code for r in outcomes(store).collect()} == {"again": 202, "late": 503, "c": 202}
    assert not {"outbox_published", "tail_event_keys", "traces_closed"} & {n for n, a, k in asked if not a and not k}
    assert [a for n, a, _ in asked if n == "tail_event_keys"] == [(NOW.date(), NOW.date())]
    # After keep_days the trace is forgotten; nothing closed is mentioned, so no key is looked up.
    asked.clear()
    take([("much later", 9 * day, "t", "x", "2")])
    assert {r.request_id: r.code for r in outcomes(store).collect()} == {"much later": 202}
    assert "tail_event_keys" not in {n for n, *_ in asked}
    assert tail.MERGE_EVERY == tables.MERGE_EVERY


def test_late_events_within_the_time_kept(spark):
    rows = batch(spark, [("a", 86400, "t", "x", "1"), ("b", 3 * 86400, "t", "x", "2")])
    closed = spark.createDataFrame([("t", "x", NOW, NOW, 1, 1, "d", at(10))], schemas.TAIL_TRACES)
    late = lambda days: sorted(r.request_id for r in staging.late_events(rows, closed, days).collect())
    assert (late(None), late(2), late(3), late(0)) == (["a", "b"], ["a"], ["a", "b"], [])


def test_persist_stream_reads_no_settled_claims(spark, folder, monkeypatch):
    ledger, asked, failing = open_ledger(spark, f"{folder}/ledger"), [], [True]
    read = ledger.read
    monkeypatch.setattr(ledger, "read", lambda name: asked.append(name) or read(name))

    def sink(rows, path):
        if failing:
            failing.pop()
            raise OSError("table away")
        tables.write_spans(rows, path)

    def go():
        stream = batches.persist_stream(topic.read_topic(spark, f"{folder}/topic", stream=True), ledger, f"{folder}/spans",
                                        f"{folder}/c", clock=lambda epoch: F.lit(NOW), sink=sink, available_now=True)
        try:
            stream.awaitTermination(120)
        except Exception:
            pass
        stream.stop()
        return sorted(r.event_key for r in tables.scan_spans(spark, f"{folder}/spans").collect()) if os.path.exists(f"{folder}/spans") else []

    send = lambda *events: topic.write_topic(spark.createDataFrame(
        [(f"t:x:{e}", "t", envelope("t", "x", e)) for e in events], "event_key string, tenant_id string, envelope " +
        schemas.ENVELOPE.simpleString()), f"{folder}/topic")
    send("1", "2", "2")
    assert go() == [] and {(r.status, r.attempts) for r in ledger.read("ledger_open").collect()} == {("pending", 1)}
    assert go() == ["t:x:1", "t:x:2"]  # the claims of a failed batch do not stand
    assert {(r.event_key, r.status, r.attempts) for r in read("ledger_settled").collect()} == {
        ("t:x:1", "persisted", 2), ("t:x:2", "persisted", 2)}
    send("2", "3")
    assert go() == ["t:x:1", "t:x:2", "t:x:3"]
    assert "ledger_settled" not in asked and read("ledger_open").count() == 0


def test_retention_in_place_keeps_untouched_files(spark, folder):
    path, day = f"{folder}/spans", dt.timedelta(days=1)
    rows = [row(f"{tenant}:{n}", tenant, when=NOW - n * day + extra) for tenant in ("a", "b") for n in range(6)
            for extra in (dt.timedelta(hours=-6), dt.timedelta(hours=6))]
    tables.write_spans(spans(spark, *rows), path)
    files = set(tables.scan_spans(spark, path).inputFiles())
    days = spark.createDataFrame([("a", 3), ("b", 30)], "tenant_id string, retention_days int")
    expire_span_partitions(spark, path, days, NOW)
    left = {(r.tenant_id, r.ingested_at) for r in tables.scan_spans(spark, path).collect()}
    assert left == {(r[0], r[-1]) for r in rows if r[0] == "b" or r[-1] >= NOW - 3 * day}
    after = set(tables.scan_spans(spark, path).inputFiles())
    gone, new = files - after, after - files
    edge = (NOW - 3 * day).date().isoformat()
    assert {f.split("ingest_date=")[1][:10] for f in new} == {edge} and all("tenant_id=a" in f for f in gone)
    assert {f for f in files if "tenant_id=b" in f} <= after
    expire_span_partitions(spark, path, days, NOW)
    assert set(tables.scan_spans(spark, path).inputFiles()) == after
    assert empty(spark, schemas.SPANS).count() == 0
