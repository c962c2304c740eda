"""Streams whose state lives in Spark's state store.

``trace_stream`` buffers a trace until it is quiet, then decides; traces are keyed in lanes of many.
``observe_stream`` is the in-memory sampler: it answers at the first error or slow event.  One
sampler instance serves one ``(tenant, shard)``, as one of several gateway processes would;
more shards spread a dominant tenant over tasks.
"""

from __future__ import annotations

import pickle
import zlib
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

from veilspan import schemas
from veilspan.functions.predicates import (HEALTHY_MODULO, MAX_OPEN_TRACES, MAX_TRACE_SPANS,
                                           SLOW_MS, is_error, is_slow)
from veilspan.functions.values import hash_sampled
from veilspan.session import ensure_conf
from veilspan.sources.topic import encode_envelope

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DECISION_OUTPUT = ("tenant_id string, trace_id string, kind string, event_key string, "
                   "request_id string, reason string, retained boolean, span_count int, "
                   "value string")
_DECIDED = Row(*[column.split()[0] for column in DECISION_OUTPUT.split(", ")])


def _prepared(events: DataFrame, modulo: int, slow_ms: float) -> DataFrame:
    """What a processor needs of an event; the rules are evaluated in the JVM."""
    ensure_conf(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    bag = F.col("envelope.event.attributes")
    return events.select(
        "tenant_id", "trace_id", "event_key", "request_id", "received_at", "pos",
        is_error(bag).alias("is_error"), is_slow(bag, slow_ms).alias("is_slow"),
        hash_sampled("trace_id", modulo).alias("sampled"),
        encode_envelope("envelope").alias("value"))


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["received_at", "request_id", "pos"])


def _output(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[
        "tenant_id", "trace_id", "kind", "event_key", "request_id", "reason", "retained",
        "span_count", "value"])


_TRACE_STATE = ("reason string, at bigint, err boolean, slow boolean, sampled boolean, "
                "event_keys array<string>, values array<string>")


class TraceProcessor(StatefulProcessor):
    """Buffer of one trace; at most ``span_cap`` events, then a closed mark.

    All that is known of a trace is one value: a call to the state store costs far more than the few
    rows of a trace, so a batch reads and writes it once.  ``reason`` is null until the decision.
    """

    def __init__(self, quiet_ms: int, keep_closed_ms: int, span_cap: int):
        self.quiet_ms, self.keep_closed_ms, self.span_cap = quiet_ms, keep_closed_ms, span_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState("trace", _TRACE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tenant, trace = key
        changed, newest = False, None
        state = self.trace.get() or (None, None, False, False, False, [], [])
        reason, at, error, slow, sampled, keys, values = state
        events = dict(zip(keys, values))
        for request, part in _by_request(rows).items():
            fresh = {}
            for row in part:
                if row.event_key not in events:
                    fresh.setdefault(row.event_key, row)
            if not fresh:
                continue
            refused = "late" if reason is not None else (
                "span_limit" if len(events) + len(fresh) > self.span_cap else None)
            if refused:
                yield _DECIDED(tenant, trace, "refused", None, request, refused, None, None, None)
                continue
            events.update((k, row.value) for k, row in fresh.items())
            taken = list(fresh.values())
            error = error or any(row.is_error for row in taken)
            slow = slow or any(row.is_slow for row in taken)
            sampled = bool(taken[0].sampled)
            newest = max((row.micros for row in taken if row.micros is not None), default=newest)
            changed = True
        if newest is not None:
            if at is not None:
                self.handle.deleteTimer(at)
            at = newest // 1000 + self.quiet_ms
            self.handle.registerTimer(at)
        if changed:
            self.trace.update((None, at, error, slow, sampled, list(events), list(events.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tenant, trace = key
        reason, _, error, slow, sampled, keys, values = self.trace.get()
        if reason is not None:  # kept long enough to refuse late events
            self.trace.clear()
            return
        reason = (schemas.RETAINED_ERROR if error else schemas.RETAINED_SLOW if slow
                  else schemas.RETAINED_SAMPLE if sampled else schemas.DROPPED_SAMPLE)
        kept = reason != schemas.DROPPED_SAMPLE
        yield _DECIDED(tenant, trace, "decision", None, None, reason, kept, len(keys), None)
        if kept:
            for event_key, value in sorted(zip(keys, values)):
                yield _DECIDED(tenant, trace, "retained", event_key, None, reason, True, None, value)
        # Keys stay until the closed mark goes, so that a repeated event is still no news.
        at = expiredTimerInfo.getExpiryTimeInMs() + self.keep_closed_ms
        self.handle.registerTimer(at)
        self.trace.update((reason, at, error, slow, sampled, keys, [""] * len(keys)))

    def close(self) -> None:
        pass


def _by_request(rows: Iterator[Row]) -> dict[str, list[Row]]:
    """Rows in order, by request; rows without a request are no one's, rows without a time come last."""
    ordered = sorted((row for row in rows if row.request_id is not None), key=lambda row: (
        row.micros is None, row.micros or 0, row.request_id, row.pos is None, row.pos or 0))
    requests: dict[str, list[Row]] = {}
    for row in ordered:
        requests.setdefault(row.request_id, []).append(row)
    return requests


class _Part:
    """The traces of one part of a lane: to a :class:`TraceProcessor` the state store of ``trace``.

    A trace's timer is ``at`` of its value, so it is found there.
    """

    def __init__(self, packed: bytes | None):
        self.traces = {} if packed is None else pickle.loads(zlib.decompress(packed))
        self.trace, self.changed = None, False

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps(self.traces, pickle.HIGHEST_PROTOCOL), 1)

    def due(self) -> int:
        return min((state[1] for state in self.traces.values() if state[1] is not None), default=_NEVER)

    def getValueState(self, name: str, schema: str) -> "_Part":
        return self

    def get(self) -> tuple | None:
        return self.traces.get(self.trace)

    def update(self, value: tuple) -> None:
        self.traces[self.trace], self.changed = value, True

    def clear(self) -> None:
        del self.traces[self.trace]
        self.changed = True

    def registerTimer(self, at: int) -> None:
        pass

    def deleteTimer(self, at: int) -> None:
        pass


_EVENT_COLUMNS = ("event_key", "request_id", "micros", "pos", "is_error", "is_slow", "sampled", "value")
_Event = namedtuple("_Event", _EVENT_COLUMNS)
_NO_NUMBER = -(1 << 63)  # a null number would turn its column into floats on the way
_NEVER = 1 << 62  # no trace of a part has a timer
_PARTS = 16
_TABLE_ROWS = 10_000


class LaneProcessor(StatefulProcessor):
    """The traces of one lane, each by a :class:`TraceProcessor`, under one timer: that of the trace due first.

    A key costs some calls to the state store and a table each way, whatever it holds; that is far more than
    the work of a trace.  The traces of a lane lie in parts, of which only those are read and written
    that a batch mentions or that have a trace due.
    """

    def __init__(self, quiet_ms: int, keep_closed_ms: int, span_cap: int):
        self.one = TraceProcessor(quiet_ms, keep_closed_ms, span_cap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # When a trace of each part is due; null for an empty part.
        self.lane = handle.getValueState("lane", "timer bigint, due array<bigint>")
        self.parts = handle.getMapState("parts", "part int", "traces binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, dict[tuple, list[_Event]]] = {}
        for table in rows:
            columns = [table[name].tolist() for name in ("part", "tenant_id", "trace_id", *_EVENT_COLUMNS)]
            for part, tenant, trace, *event in zip(*columns):
                arrived.setdefault(part, {}).setdefault((tenant, trace), []).append(_event(event))
        timer, due = self._lane()
        before, out = list(due), []
        for n, traces in arrived.items():
            part = self._part(n, due)
            for part.trace, events in traces.items():
                out += self.one.handleInputRows(part.trace, iter(events), timerValues)
            self._put(n, part, due)
        if due != before:
            self._keep(due, timer)
        if out:
            yield _output(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        _, due = self._lane()
        for n in [n for n, at in enumerate(due) if at is not None and at <= now]:
            part = self._part(n, due)
            for part.trace, state in list(part.traces.items()):
                if state[1] is not None and state[1] <= now:
                    out += self.one.handleExpiredTimer(part.trace, timerValues, ExpiredTimerInfo(state[1]))
            self._put(n, part, due)
            if len(out) >= _TABLE_ROWS:
                yield _output(out)
                out = []
        self._keep(due, None, after=expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield _output(out)

    def close(self) -> None:
        pass

    def _lane(self) -> tuple[int | None, list]:
        timer, due = self.lane.get() or (None, None)
        return timer, [None] * _PARTS if due is None else list(due)

    def _part(self, n: int, due: list) -> _Part:
        part = _Part(None if due[n] is None else self.parts.getValue((n,))[0])
        self.one.init(part)
        return part

    def _put(self, n: int, part: _Part, due: list) -> None:
        if not part.changed:
            return
        if part.traces:
            self.parts.updateValue((n,), (part.packed(),))
        else:
            self.parts.removeKey((n,))
        due[n] = part.due() if part.traces else None

    def _keep(self, due: list, timer: int | None, after: int | None = None) -> None:
        """Set the lane's timer in place of ``timer``; Spark itself deletes the one that expired, ``after``."""
        first = min((at for at in due if at is not None), default=_NEVER)
        first = None if first == _NEVER else first if after is None else max(first, after + 1)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if any(at is not None for at in due):
            self.lane.update((first, due))
        else:
            self.lane.clear()


def _event(values: list) -> _Event:
    values[2:4] = [None if number == _NO_NUMBER else number for number in values[2:4]]
    return _Event(*values)


def trace_stream(events: DataFrame, quiet_seconds: float = 2.0, watermark: str = "0 seconds",
                 keep_closed_days: int = 30, modulo: int = HEALTHY_MODULO,
                 slow_ms: float = SLOW_MS, span_cap: int = MAX_TRACE_SPANS, lanes: int = 4096) -> DataFrame:
    """Decisions, retained envelopes and refusals of an envelope stream.

    Keyed by a hash of tenant and trace, so tenants of any size spread over tasks; there is no per-tenant
    cap here (that is the job of the tail cycle).  A batch has at most ``lanes`` keys, however many traces it
    has; a checkpoint holds for one number of lanes.  State per trace: at most
    ``span_cap`` events, and after the decision their keys for ``keep_closed_days``.  Events behind the
    watermark are not dropped: one of a decided trace is refused with a ``late`` row, one of an unknown trace
    opens it, to be decided with the next batch.
    """
    rows = _prepared(events, modulo, slow_ms).withWatermark("received_at", watermark)
    # The watermark moves the timers; a computed column does not carry it, so no row is held against it.
    rows = rows.withColumn("micros", F.unix_micros("received_at")).drop("received_at")
    rows = rows.withColumns({
        **{name: F.coalesce(F.col(name).cast("bigint"), F.lit(_NO_NUMBER)) for name in ("micros", "pos")},
        **{name: F.coalesce(name, F.lit(False)) for name in ("is_error", "is_slow", "sampled")},
        "place": F.pmod(F.xxhash64("tenant_id", "trace_id"), F.lit(lanes * _PARTS))})
    rows = rows.withColumns({"lane": F.expr(f"place div {_PARTS}"), "part": F.expr(f"place % {_PARTS}")}).drop("place")
    return rows.groupBy("lane").transformWithStateInPandas(
        LaneProcessor(int(quiet_seconds * 1000), keep_closed_days * 86400000, span_cap),
        outputStructType=DECISION_OUTPUT, outputMode="append", timeMode="eventtime")


class ObserveProcessor(StatefulProcessor):
    """One sampler instance: at most ``max_traces`` open traces of ``max_spans`` events."""

    def __init__(self, max_traces: int, max_spans: int):
        self.max_traces, self.max_spans = max_traces, max_spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.traces = handle.getMapState(
            "traces", "trace_id string", "opened bigint, n int, sampled boolean")
        self.events = handle.getMapState(
            "events", "trace_id string, n int", "event_key string, value string")
        self.clock = handle.getValueState("clock", "next bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tenant = key[0]
        clock = self.clock.get()[0] if self.clock.exists() else 0
        # The open traces are held as a plain dict for the batch and written back once.
        traces = {k[0]: tuple(v) for k, v in self.traces.iterator()}
        out: list[tuple] = []

        def forget(trace: str, reason: str, kept: bool) -> None:
            _, n, _ = traces.pop(trace)
            self.traces.removeKey((trace,))
            count = n if kept else 0
            out.append((tenant, trace, "decision", None, None, reason, kept, count, None))
            for i in range(1, n + 1):
                if kept:
                    event_key, value = self.events.getValue((trace, i))
                    out.append((tenant, trace, "retained", event_key, None, reason, True, None,
                                value))
                self.events.removeKey((trace, i))

        for row in _in_order(rows).itertuples():
            trace = row.trace_id
            if row.value is None:  # an explicit completion
                if trace in traces:
                    kept = bool(traces[trace][2])
                    forget(trace, schemas.RETAINED_SAMPLE if kept else schemas.DROPPED_SAMPLE,
                           kept)
                continue
            if trace not in traces:
                if len(traces) >= self.max_traces:
                    oldest = min(traces, key=lambda t: traces[t][0])
                    forget(oldest, schemas.EVICTED_PRESSURE, False)
                clock += 1
                traces[trace] = (clock, 0, bool(row.sampled))
            opened, n, sampled = traces[trace]
            if n >= self.max_spans:
                forget(trace, schemas.EVICTED_SPAN_LIMIT, False)
                continue
            self.events.updateValue((trace, n + 1), (row.event_key, row.value))
            traces[trace] = (opened, n + 1, sampled)
            if row.is_error:
                forget(trace, schemas.RETAINED_ERROR, True)
            elif row.is_slow:
                forget(trace, schemas.RETAINED_SLOW, True)
        for trace, state in traces.items():
            self.traces.updateValue((trace,), state)
        self.clock.update((clock,))
        yield _output(out)

    def close(self) -> None:
        pass


def observe_stream(events: DataFrame, shards: int = 16, max_traces: int = MAX_OPEN_TRACES,
                   max_spans: int = MAX_TRACE_SPANS, modulo: int = HEALTHY_MODULO,
                   slow_ms: float = SLOW_MS, completions: DataFrame | None = None) -> DataFrame:
    """Online sampling of an envelope stream.

    A trace is answered and forgotten at its first error or slow event, with the events so
    far; a new trace beyond ``max_traces`` evicts the oldest of its instance; ``completions``
    (``tenant_id, trace_id, received_at``) ends a trace by the hash sample.
    """
    rows = _prepared(events, modulo, slow_ms)
    if completions is not None:
        ends = completions.select(
            "tenant_id", "trace_id", F.lit(None).cast("string").alias("event_key"),
            # Sorts after the events of the same moment.
            F.lit("\U0010ffff").alias("request_id"), "received_at",
            F.lit(0).alias("pos"), F.lit(False).alias("is_error"), F.lit(False).alias("is_slow"),
            F.lit(False).alias("sampled"), F.lit(None).cast("string").alias("value"))
        rows = rows.unionByName(ends)
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("trace_id"), F.lit(shards)))
    return keyed.groupBy("tenant_id", "shard").transformWithStateInPandas(
        ObserveProcessor(max_traces, max_spans),
        outputStructType=DECISION_OUTPUT, outputMode="append", timeMode="none")
