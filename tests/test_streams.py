import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

from helpers import BATCH, NOW, at, batch, keys, policies, requests, span, trace_body
from veilspan import schemas
from veilspan.operators import observe, policy
from veilspan.plans import stream_catalog
from veilspan.plans.tail import TailConfig, open_store
from veilspan.plans.persist import open_ledger
from veilspan.functions.values import as_ts
from veilspan.sources import tables, topic
from veilspan.streaming import batches, processors

ERROR = {"http.status_code": "503"}
SLOW = {"duration_ms": "1001"}


def feed(spark, folder, part, rows):
    batch(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{part}")


def source(spark, folder):
    return (spark.readStream.schema(BATCH).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))


def run(df, folder, name="out"):
    query = (df.writeStream.format("parquet").option("path", f"{folder}/{name}")
             .option("checkpointLocation", f"{folder}/{name}-checkpoint")
             .trigger(availableNow=True).start())
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def decisions(out):
    return sorted((r.trace_id, r.reason, r.span_count)
                  for r in out.filter("kind = 'decision'").collect())


def test_observe(spark, folder):
    feed(spark, folder, "a", [
        ("r0", 0, "t", "old", "e1"), ("r1", 1, "t", "bad", "e1"), ("r2", 2, "t", "bad", "e2", ERROR),
        ("r3", 3, "t", "bad", "e3"), ("r4", 4, "t", "new", "e1")])
    args = dict(shards=1, max_traces=2, max_spans=2, modulo=1)
    out = run(processors.observe_stream(source(spark, folder), **args), folder)
    # The third open trace evicts the oldest; the error answer forgot its trace before.
    assert decisions(out) == [("bad", "retained_error", 2), ("old", "evicted_pressure", 0)]
    kept = out.filter("kind = 'retained'")
    assert sorted(r.event_key for r in kept.collect()) == ["t:bad:e1", "t:bad:e2"]
    # State survives a restart: the two open traces are remembered.
    feed(spark, folder, "b", [("r5", 5, "t", "bad", "e4"), ("r6", 6, "t", "bad", "e5"),
                              ("r7", 7, "t", "new", "e2", SLOW)])
    out = run(processors.observe_stream(source(spark, folder), **args), folder)
    assert decisions(out) == [
        ("bad", "evicted_span_limit", 0), ("bad", "retained_error", 2),
        ("new", "retained_slow", 2), ("old", "evicted_pressure", 0)]


def test_trace_stream_matches_batch_and_restarts(spark, folder):
    feed(spark, folder, "a", [
        ("r0", 0, "t", "a", "e1"), ("r1", 0, "t", "a", "e2", ERROR), ("r2", 1, "t", "b", "e1"),
        ("r3", 1, "u", "a", "e1"), ("tick", 60, "t", "tick", "e1")])
    make = lambda: processors.trace_stream(source(spark, folder), modulo=1)
    out = run(make(), folder)
    first = [("a", "retained_error", 2), ("a", "retained_healthy_sample", 1),
             ("b", "retained_healthy_sample", 1)]
    assert decisions(out) == first
    # Late and repeated events after a restart: the closed mark is in the state.
    feed(spark, folder, "b", [("late", 61, "t", "a", "e3"), ("again", 61, "t", "a", "e1"),
                              ("tick2", 120, "t", "tock", "e1")])
    out = run(make(), folder)
    assert decisions(out) == first + [("tick", "retained_healthy_sample", 1)]
    refused = out.filter("kind = 'refused'").collect()
    assert [(r.request_id, r.reason) for r in refused] == [("late", "late")]


def test_trace_stream_keeps_evidence_of_events_behind_the_watermark(spark, folder):
    feed(spark, folder, "a", [("r0", 0, "t", "a", "e1"), ("tick", 600, "t", "tick", "e1")])
    make = lambda: processors.trace_stream(source(spark, folder), modulo=1)
    assert decisions(run(make(), folder)) == [("a", "retained_healthy_sample", 1)]
    feed(spark, folder, "b", [("behind", 5, "t", "a", "e2"), ("unknown", 7, "t", "old", "e1", ERROR), ("again", 1, "t", "a", "e1"),
                              ("tick2", 700, "t", "tock", "e1")])
    out = run(make(), folder)
    assert decisions(out) == [("a", "retained_healthy_sample", 1), ("old", "retained_error", 1), ("tick", "retained_healthy_sample", 1)]
    assert [(r.request_id, r.reason) for r in out.filter("kind = 'refused'").collect()] == [("behind", "late")]


class CountedState:
    """A handle that holds one value and counts the calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_trace_processor_calls_the_state_store_a_few_times_whatever_the_rows():
    row = Row("event_key", "request_id", "micros", "pos", "is_error", "is_slow", "sampled", "value")
    state, of = CountedState(), processors.TraceProcessor(2000, 86_400_000, 60)
    of.init(state)
    rows = [row(f"e{n % 50}", f"r{n:02}", 1_000_000 * n, 1, n == 7, None, False, f"v{n}") for n in range(59, -1, -1)]
    assert list(of.handleInputRows(("t", "a"), iter(rows), None)) == []
    assert state.timers == {51_000} and state.calls <= 4
    more = [row(f"f{n}", "big", 50_000_000, n, False, False, False, "") for n in range(11)] + [
        row("g", None, 50_000_000, 1, False, False, False, ""), row("h", "untimed", None, 1, False, False, True, "vh")]
    got = list(of.handleInputRows(("t", "a"), iter(more), None))
    assert [(r.kind, r.request_id, r.reason) for r in got] == [("refused", "big", "span_limit")]
    assert state.timers == {51_000} and state.calls <= 8
    due = ExpiredTimerInfo(51_000)
    kept = list(of.handleExpiredTimer(("t", "a"), None, due))
    assert [r.span_count for r in kept if r.kind == "decision"] == [51] and kept[0].reason == schemas.RETAINED_ERROR
    assert [(r.event_key, r.value) for r in kept[1:]] == sorted([(f"e{n}", f"v{n}") for n in range(50)] + [("h", "vh")])
    late = list(of.handleInputRows(("t", "a"), iter([rows[0], row("new", "r99", 60_000_000, 1, False, False, False, "")]), None))
    assert [(r.request_id, r.reason) for r in late] == [("r99", "late")] and state.calls <= 14
    assert list(of.handleExpiredTimer(("t", "a"), None, due)) == [] and state.value is None


class LaneState:
    """A handle of one lane that counts the calls."""

    def __init__(self):
        self.calls, self.value, self.parts, self.timers = 0, None, {}, set()

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def _counted(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._counted(self.value)

    def update(self, value):
        self.value = self._counted(value)

    def clear(self):
        self.value = self._counted()

    def getValue(self, n):
        return self._counted(self.parts[n])

    def updateValue(self, n, value):
        self.parts[n] = self._counted(value)

    def removeKey(self, n):
        self._counted(self.parts.pop(n))

    def registerTimer(self, at):
        self._counted(self.timers.add(at))

    def deleteTimer(self, at):
        self._counted(self.timers.remove(at))


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_lane_does_what_its_traces_do_alone(monkeypatch):
    monkeypatch.setattr(processors, "_TABLE_ROWS", 20)  # a lane may give several tables
    random, day = np.random.default_rng(4), 86_400_000
    lane, of = LaneState(), processors.LaneProcessor(2000, day, 5)
    of.init(lane)
    alone, now, n, said = {}, 0, 0, []
    for count, seconds in [(400, 5), (0, 5), (400, 20), (0, 20), (9, 21), (0, 60), (300, 2 * 86_400), (0, 2 * 86_400), (0, 3 * 86_400 + 9), (0, 4 * 86_400)]:
        rows = []
        for _ in range(count):
            k = int(random.integers(60))
            tenant, trace = (None, "t", "u")[random.integers(3)], f"x{k}"
            rows.append((tenant, trace, k % 16, f"{tenant}:{trace}:{random.integers(9)}", f"r{n // 3}" if n % 50 else None,
                         int((seconds - random.random() * 9) * 1e6) if random.integers(8) else None,
                         int(random.integers(4)) if random.integers(4) else None, bool(random.random() < .1), False, k % 2 == 0, f"v{n}"))
            n += 1
        expected = []
        for trace in {row[:2] for row in rows}:
            state = alone.setdefault(trace, CountedState())
            one = processors.TraceProcessor(2000, day, 5)
            one.init(state)
            expected += one.handleInputRows(trace, iter([processors._Event(*row[3:]) for row in rows if row[:2] == trace]), None)
        for trace, state in alone.items():
            one.init(state)
            for at in [at for at in state.timers if at <= now]:
                state.timers.remove(at)
                expected += one.handleExpiredTimer(trace, None, ExpiredTimerInfo(at))
        got = []
        if rows:
            table = pd.DataFrame(rows, columns=["tenant_id", "trace_id", "part", *processors._EVENT_COLUMNS])
            table[["micros", "pos"]] = [[processors._NO_NUMBER if v is None else v for v in row[5:7]] for row in rows]
            got += list(of.handleInputRows((0,), iter([table[:7], table[7:]]), Watermark(now)))
        for at in [at for at in lane.timers if at <= now]:
            got += list(of.handleExpiredTimer((0,), Watermark(now), ExpiredTimerInfo(at)))
            lane.timers.remove(at)
        flat = [tuple(None if v != v else v for v in row) for table in got for row in table.itertuples(index=False)]
        assert Counter(flat) == Counter(map(tuple, expected))
        said += [(row.kind, row.reason) for row in expected]
        now = max([now] + [row[5] // 1000 for row in rows if row[5] is not None])
    assert {"late", "span_limit", schemas.RETAINED_ERROR, schemas.RETAINED_SAMPLE, schemas.DROPPED_SAMPLE} <= {reason for _, reason in said}


def test_a_lane_calls_the_state_store_a_few_times_whatever_the_traces():
    lane, of = LaneState(), processors.LaneProcessor(2000, 86_400_000, 60)
    of.init(lane)
    rows = [("t", f"x{n}", n % 16, f"e{n}", f"r{n}", 1_000_000 + n, 1, False, False, True, "v") for n in range(2000)]
    table = pd.DataFrame(rows, columns=["tenant_id", "trace_id", "part", *processors._EVENT_COLUMNS])
    assert list(of.handleInputRows((0,), iter([table]), Watermark(0))) == []
    assert lane.timers == {3000} and lane.calls <= 20
    out, = of.handleExpiredTimer((0,), Watermark(3000), ExpiredTimerInfo(3000))
    assert len(out) == 2000 and lane.calls <= 56  # the other traces are due a millisecond later
    assert min(lane.timers - {3000}) == 3001
    table["event_key"], lane.calls = "new", 0
    refused, = of.handleInputRows((0,), iter([table[3:40:16]]), Watermark(3000))
    assert list(refused["reason"]) == ["late"] * 3 and lane.calls == 2  # one part is read, none written


def test_trace_stream_keys_lanes_not_traces(spark, folder):
    feed(spark, folder, "a", [(f"r{n}", 0, "t", f"x{n}", "e") for n in range(90)] + [("tick", 9, "u", "y", "e")])
    out = run(processors.trace_stream(source(spark, folder), modulo=1, lanes=2), folder)
    assert decisions(out) == sorted((f"x{n}", "retained_healthy_sample", 1) for n in range(90))
    state = spark.read.format("statestore").option("stateVarName", "lane").load(f"{folder}/out-checkpoint")
    assert state.count() <= 2


def test_request_to_span_streams(spark, folder):
    def send(part, rows):
        requests(spark, rows).coalesce(1).write.parquet(f"{folder}/requests/{part}")

    def go():
        stream = (spark.readStream.schema(schemas.REQUESTS).option("recursiveFileLookup", True)
                  .parquet(f"{folder}/requests"))
        tail = batches.tail_stream(
            stream, keys(spark), policy.active_policies(policies(spark)),
            open_store(spark, f"{folder}/state"), f"{folder}/topic", f"{folder}/c1",
            TailConfig(modulo=1), available_now=True)
        assert tail.awaitTermination(300)
        tail.stop()
        persist = batches.persist_stream(
            topic.read_topic(spark, f"{folder}/topic", stream=True),
            open_ledger(spark, f"{folder}/ledger"), f"{folder}/spans", f"{folder}/c2",
            clock=lambda epoch: as_ts(F.lit(NOW)), available_now=True)
        assert persist.awaitTermination(300)
        persist.stop()
        return sorted(r.event_key for r in tables.read_spans(spark, f"{folder}/spans").collect())

    body = lambda t, s: trace_body(span(t, s))
    send("a", [("r1", "/v1/traces", body("t1", "a")), ("r2", "/v1/traces", body("t2", "a"), at(9))])
    assert go() == ["tenant-a:t1:a"]
    send("b", [("r1", "/v1/traces", body("t1", "a"), at(99))])  # sent again
    assert go() == ["tenant-a:t1:a", "tenant-a:t2:a"]


def test_requests_of_one_file_are_dealt_over_the_tasks(spark, monkeypatch):
    rows = requests(spark, [(f"r{n}", "/v1/traces", trace_body(span("t1", "a")), at(n)) for n in range(40)]).coalesce(1)
    parsed = []
    monkeypatch.setattr(batches, "_start", lambda stream, checkpoint, each, *_: each(stream, 0))
    monkeypatch.setattr(batches, "accept_requests", lambda batch, *_: parsed.append(batch) or batch)
    monkeypatch.setattr(batches, "inbox_rows", lambda judged: judged)
    monkeypatch.setattr(batches, "tail_cycle", lambda *_, **__: None)
    batches.tail_stream(rows, None, None, None, "", "")
    assert parsed[0].count() == 40
    assert "Rebalance" in parsed[0]._jdf.queryExecution().optimizedPlan().toString()


def test_malformed_message_stops_the_stream(spark, folder):
    spark.createDataFrame([("k", "{")], schemas.TOPIC).write.parquet(f"{folder}/topic")
    query = batches.persist_stream(
        topic.read_topic(spark, f"{folder}/topic", stream=True),
        open_ledger(spark, f"{folder}/ledger"), f"{folder}/spans", f"{folder}/c",
        available_now=True)
    with pytest.raises(Exception, match="envelope invalid"):
        query.awaitTermination(120)
    query.stop()
    assert open_ledger(spark, f"{folder}/ledger").epoch() == -1


def _rates(spark, tmp_path, *batches):
    """The rate stream over batches of minutes after midnight, one file each, in this order."""
    for n, minutes in enumerate(batches):
        path = tmp_path / f"in/{n}.parquet"
        path.parent.mkdir(exist_ok=True)
        frame = pd.DataFrame({"ts": pd.Timestamp("2026-01-01", tz="UTC") + pd.to_timedelta(minutes, unit="min"),
                              "service": "shop", "code": 200})
        frame.astype({"ts": "datetime64[us, UTC]"}).to_parquet(path)
        os.utime(path, (1_000 + n * 100, 1_000 + n * 100))
    source = (spark.readStream.schema("ts timestamp, service string, code bigint")
              .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    return stream_catalog._newest_updates(
        observe.request_rate(source, watermark="1 hour"), ["window_start", "service"], str(tmp_path / "out"))


def test_rate_stream_keeps_the_newest_update_of_open_windows(spark, tmp_path):
    rows = _rates(spark, tmp_path, [0, 30], [30, 50]).orderBy("window_start").collect()
    assert [r.requests for r in rows] == [1, 2, 1]


def test_rate_stream_fails_on_rows_behind_the_watermark(spark, tmp_path):
    with pytest.raises(RuntimeError, match="after the watermark"):
        _rates(spark, tmp_path, [0, 300], [400], [1])
