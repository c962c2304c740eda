"""Durable buffering of envelopes per trace, as set operations over one micro-batch.

Requests are taken in the order ``(received_at, request_id)`` and their events in request order.  A
request is accepted or refused as a whole.  ``stage`` takes a micro-batch as one moment;
``stage_in_time`` also closes traces at the moments between its requests, so that the answer does
not depend on how the input is cut into batches.  State tables:

``traces``      one row per trace (``TAIL_TRACES``)
``event_keys``  keys seen within retention (``TAIL_EVENT_KEYS``)
``buffers``     buffered envelopes of open traces (``TAIL_BUFFERS``)
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.predicates import MAX_OPEN_TRACES, MAX_TRACE_SPANS
from veilspan.functions.values import as_ts
from veilspan.operators import scan
from veilspan.operators.sampling import TRACE

KEY = ("tenant_id", "event_key")
_ORDER = ("received_at", "request_id", "pos")
_IDS = ("tenant_id", "trace_id", "event_key", *_ORDER)

# Why a request was refused at staging.
LATE, SPAN_LIMIT, UNSTAGED_COPY = "late", "span_limit", "unstaged_copy"


# Writes a named intermediate result and gives it back, or does nothing.
Cut = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class Staged:
    """Results of one staging step; every member is a lazy DataFrame."""

    events: DataFrame      # newly buffered rows: batch columns
    refused: DataFrame     # request_id, reason
    event_keys: DataFrame  # rows to append to the key table
    evictable: DataFrame   # traces after the step, before pressure is applied


def new_event_keys(batch: DataFrame, event_keys: DataFrame) -> DataFrame:
    """First row per unseen ``(tenant_id, event_key)``.

    The first row is chosen by a row limit that Spark also applies before the shuffle, so a
    key that is redelivered very often does not gather in one task.
    """
    unseen = batch.join(event_keys.select(*KEY), list(KEY), "left_anti")
    return _first_copies(unseen)


def _first_copies(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(*_ORDER)
    return (rows.withColumn("_copy", F.row_number().over(order))
            .filter(F.col("_copy") == 1).drop("_copy"))


def late_events(batch: DataFrame, traces: DataFrame, keep_days: int | None = None) -> DataFrame:
    """Rows whose trace is already decided; such a trace is not re-opened, or not for ``keep_days``."""
    closed = traces.filter(F.col("decided_at").isNotNull())
    if keep_days is None:
        return batch.join(closed.select(*TRACE), list(TRACE), "left_semi")
    ends = closed.groupBy(*TRACE).agg((F.max("decided_at") + F.make_dt_interval(days=F.lit(keep_days))).alias("_until"))
    return batch.join(ends, list(TRACE)).filter(F.col("received_at") <= F.col("_until")).drop("_until")


def enforce_span_limit(fresh: DataFrame, traces: DataFrame, cap: int = MAX_TRACE_SPANS
                       ) -> DataFrame:
    """``request_id`` of requests that would take a trace over ``cap`` events.

    Requests are admitted per trace in order; one that does not fit is skipped and takes no
    room.  Room only shrinks, so once a request of n new events is refused every later one of
    n or more is too.  Hence of all requests with n events only the first ``cap // n`` can fit:
    the fold below sees a few hundred rows per trace however hot the trace is, and the rest
    are refused without looking.
    """
    asked = fresh.groupBy(*TRACE, "request_id").agg(
        F.min("received_at").alias("received_at"), F.count(F.lit(1)).alias("n"))
    # A batch that cannot overflow any trace ends here: no trace below needs a fold.
    total = asked.groupBy(*TRACE).agg(F.sum("n").alias("total"))
    held = traces.select(*TRACE, F.col("span_count").alias("held"))
    tight = (total.join(held, list(TRACE), "left")
             .withColumn("held", F.coalesce(F.col("held"), F.lit(0)).cast("bigint"))
             .filter(F.col("held") + F.col("total") > cap).select(*TRACE, "held"))
    rows = asked.join(tight, list(TRACE))
    by_size = Window.partitionBy(*TRACE, "n").orderBy("received_at", "request_id")
    ranked = rows.withColumn("nth", F.row_number().over(by_size)).filter(F.col("nth") <= cap)
    possible = ranked.filter(F.col("nth") * F.col("n") <= cap)
    folded = possible.groupBy(*TRACE).agg(
        F.first("held").alias("held"),
        F.array_sort(F.collect_list(F.struct("received_at", "request_id", "n"))).alias("asked"))
    fits = folded.select(*TRACE, F.aggregate(
        "asked",
        F.struct(F.col("held").alias("used"), F.array().cast("array<string>").alias("ids")),
        lambda acc, r: F.when(
            acc["used"] + r["n"] <= cap,
            F.struct((acc["used"] + r["n"]).alias("used"),
                     F.concat(acc["ids"], F.array(r["request_id"])).alias("ids")))
        .otherwise(acc))["ids"].alias("ids"))
    admitted = fits.select(*TRACE, F.explode("ids").alias("request_id"))
    return (rows.join(admitted, [*TRACE, "request_id"], "left_anti")
            .select("request_id").distinct())


def stage(batch: DataFrame, traces: DataFrame, event_keys: DataFrame,
          closed: DataFrame | None = None, as_of=None, span_cap: int = MAX_TRACE_SPANS,
          cut: Cut = lambda name, rows: rows) -> Staged:
    """Stage one micro-batch of envelopes.

    ``batch`` has ``tenant_id, trace_id, event_key, envelope, request_id, received_at, pos``.
    ``closed`` holds decided traces that are kept apart from the open ones in ``traces``.
    Order: drop known keys, refuse requests with late events, keep the first copy of a key,
    refuse requests over the span bound, then buffer.  Known keys are accepted without effect.
    ``as_of`` overrides the arrival time as the time of the state rows.  ``cut`` may write an
    intermediate result and return it as read back, so that it is computed once.
    """
    # Everything is decided on the ids; the envelopes are shuffled once, at the end.
    ids = batch.select(*_IDS)
    unseen = ids.join(event_keys.select(*KEY), list(KEY), "left_anti")
    late = cut("late", late_events(unseen, traces if closed is None else closed).select(
        "request_id").distinct())
    on_time = unseen.join(late, "request_id", "left_anti")
    first = cut("candidates", _first_copies(on_time))
    over = cut("over_limit", enforce_span_limit(first, traces, span_cap))

    # A request may lean on an earlier copy of its event; if that copy's request was refused,
    # acknowledging it would lose the event, so it is refused too and the sender retries.
    lost = first.join(over, "request_id", "left_semi").select(*KEY)
    leaning = (on_time.join(over, "request_id", "left_anti")
               .join(lost, list(KEY), "left_semi").select("request_id").distinct())
    refused = (late.withColumn("reason", F.lit(LATE))
               .unionByName(over.withColumn("reason", F.lit(SPAN_LIMIT)))
               .unionByName(leaning.withColumn("reason", F.lit(UNSTAGED_COPY))))
    taken = cut("taken", first.join(over.unionByName(leaning), "request_id", "left_anti"))

    at = F.col("received_at") if as_of is None else as_ts(as_of)
    keys = taken.select("event_key", *TRACE, at.alias("created_at"))
    return Staged(_rows_of(batch, taken), refused, keys,
                  upsert_traces(traces, trace_state(taken, at)))


@dataclass(frozen=True)
class Timed:
    """Results of a staging step in time; every member is a lazy DataFrame."""

    events: DataFrame      # newly buffered rows: batch columns
    refused: DataFrame     # request_id, reason
    event_keys: DataFrame  # rows to append to the key table
    traces: DataFrame      # traces after the step, before any decision
    evicted: DataFrame     # tenant_id, trace_id, evicted_at


def stage_in_time(batch: DataFrame, traces: DataFrame, event_keys: DataFrame, closed: DataFrame,
                  quiet_seconds: float = 2.0, open_cap: int = MAX_OPEN_TRACES,
                  span_cap: int = MAX_TRACE_SPANS, keep_days: int | None = None,
                  cut: Cut = lambda name, rows: rows) -> Timed:
    """Stage a micro-batch in which traces close as time goes on.

    A trace closes when it has been quiet for ``quiet_seconds``, or when a trace opens while
    ``open_cap`` others of its tenant are open and it is the oldest of them.  What arrives for it
    after that, and up to ``keep_days`` later, is late.  ``event_keys`` may be those of the traces in
    ``traces`` and ``closed`` only.  Batches must follow each other in time: the rows of one moment
    belong in one batch.  A request refused for one of its traces still opens and prolongs the others
    in this reckoning, but leaves no row in them.
    """
    quiet = F.make_dt_interval(secs=F.lit(quiet_seconds))
    ids = batch.select(*_IDS)
    unseen = ids.join(event_keys.select(*KEY), list(KEY), "left_anti")
    decided = cut("late", late_events(unseen, closed, keep_days).select("request_id").distinct())
    on_time = unseen.join(decided, "request_id", "left_anti")
    first = cut("candidates", _first_copies(on_time))
    # Whether a request fits depends on earlier ones only, so what a trace admits up to its close is
    # the same whether or not later requests are known to be late.
    over = cut("over_limit", enforce_span_limit(first, traces, span_cap))
    admitted = first.join(over, "request_id", "left_anti")
    rows = cut("segments", segmented(admitted, traces, quiet))
    lives = cut("lives", lives_of(rows.filter(F.col("segment") == 0), traces, quiet))
    evicted = cut("evictions", pressure_evictions(lives, open_cap))

    ends = lives.join(evicted, list(TRACE), "left").select(
        *TRACE, F.least("evicted_at", F.col("closes_at")).alias("ends_at"), "evicted_at")
    placed = on_time.join(ends, list(TRACE))
    after = (F.col("received_at") > F.col("evicted_at")) | (F.col("received_at") >= F.col("ends_at")) & F.col("evicted_at").isNull()
    # Copies of what the trace took in before it closed are no news, whenever they arrive.
    held = rows.filter(F.col("segment") == 0).join(ends, list(TRACE)).filter(~F.coalesce(
        F.col("received_at") > F.col("evicted_at"), F.lit(False))).select(*KEY)
    late = cut("late_in_time", placed.filter(after).join(held, list(KEY), "left_anti").select("request_id").distinct())

    over = over.join(late, "request_id", "left_anti")
    gone = over.unionByName(late)
    lost = first.join(gone, "request_id", "left_semi").select(*KEY)
    leaning = (on_time.join(gone, "request_id", "left_anti")
               .join(lost, list(KEY), "left_semi").select("request_id").distinct())
    refused = (decided.unionByName(late).withColumn("reason", F.lit(LATE))
               .unionByName(over.withColumn("reason", F.lit(SPAN_LIMIT)))
               .unionByName(leaning.withColumn("reason", F.lit(UNSTAGED_COPY))))
    taken = cut("taken", first.join(gone.unionByName(leaning), "request_id", "left_anti"))
    after_step = upsert_traces(traces, trace_state(taken))
    keys = taken.select("event_key", *TRACE, F.col("received_at").alias("created_at"))
    return Timed(_rows_of(batch, taken), refused, keys, after_step,
                 evicted.join(after_step.select(*TRACE), list(TRACE), "left_semi"))


def segmented(admitted: DataFrame, traces: DataFrame, quiet: Column) -> DataFrame:
    """Rows with the number of gaps of at least ``quiet`` before them in their trace, ``segment``.

    A trace admits no more rows than its span bound, so its window is small.
    """
    known = traces.select(*TRACE, F.col("last_seen").alias("_last"))
    order = Window.partitionBy(*TRACE).orderBy(*_ORDER)
    before = F.coalesce(F.lag("received_at").over(order), F.col("_last"))
    gap = F.coalesce((F.col("received_at") >= before + quiet).cast("int"), F.lit(0))
    rows = admitted.join(known, list(TRACE), "left").withColumn("_gap", gap)
    return rows.withColumn("segment", F.sum("_gap").over(order).cast("int")).select(*admitted.columns, "segment")


def lives_of(rows: DataFrame, traces: DataFrame, quiet: Column) -> DataFrame:
    """When each trace opened and when it would close by itself: rows (tenant_id, trace_id, first_seen, closes_at)."""
    now = rows.groupBy(*TRACE).agg(F.min("received_at").alias("_first"), F.max("received_at").alias("_last"))
    both = traces.select(*TRACE, "first_seen", "last_seen").join(now, list(TRACE), "full_outer")
    return both.select(*TRACE, F.coalesce("first_seen", "_first").alias("first_seen"),
                       (F.greatest("last_seen", "_last") + quiet).alias("closes_at"))


#: Points of a tenant's sweep that one task goes through.
SWEEP_POINTS = 100_000
_EVICTED = "tenant_id string, trace_id string, evicted_at timestamp"


def pressure_evictions(lives: DataFrame, cap: int = MAX_OPEN_TRACES, points: int = SWEEP_POINTS) -> DataFrame:
    """Traces evicted by the opening of others: rows (tenant_id, trace_id, evicted_at).

    A trace is evicted at the first opening, while it is open itself, that leaves more than ``cap`` traces
    open among those opened no earlier than it; that depends on no other eviction.  A sweep line
    counts the open traces of a tenant, +1 at an opening and -1 at a close, over ranged rows.  Where
    the count passes the cap, stretches of at most ``points`` points are gone through one by one,
    each with the newest ``cap`` traces that are open at its start.
    """
    none = lives.limit(0).select(*TRACE, F.col("first_seen").alias("evicted_at"))
    many = lives.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("tenant_id")
    if many.isEmpty():  # no tenant has so many traces, open at once or not
        return none
    point = F.explode(F.array(
        F.struct(F.col("first_seen").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("closes_at").alias("at"), F.lit(-1).alias("step"))))
    line = lives.join(many, "tenant_id", "left_semi").select(*TRACE, "first_seen", point.alias("p")).select(
        *TRACE, "first_seen", "p.*")
    swept = scan.running(line, ["tenant_id"], [F.col("at"), F.col("step"), F.col("trace_id")],
                         {"n_open": (scan.SUM, F.col("step")), "n": (scan.SUM, F.lit(1).cast("long"))})
    swept = scan.written(swept.withColumn("stretch", F.floor((F.col("n") - 1) / points).cast("long")))
    crowded = swept.filter((F.col("step") > 0) & (F.col("n_open") > cap)).select("tenant_id", "stretch").distinct()
    if crowded.isEmpty():
        return none
    spans = swept.groupBy(*TRACE).agg(F.min("first_seen").alias("first_seen"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    carried = spans.filter("b > a").select(*TRACE, "first_seen", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("stretch"))
    newest = Window.partitionBy("tenant_id", "stretch").orderBy(F.desc("first_seen"), F.desc("trace_id"))
    carried = (carried.join(crowded, ["tenant_id", "stretch"], "left_semi").withColumn("_rank", F.row_number().over(newest))
               .filter(F.col("_rank") <= cap)
               .select("tenant_id", "stretch", "trace_id", F.col("first_seen").alias("at"), F.lit(1).alias("step"), (-F.col("_rank")).cast("long").alias("n")))
    lines = carried.unionByName(swept.join(crowded, ["tenant_id", "stretch"], "left_semi").select(*carried.columns))

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[str, None] = OrderedDict()
        out = []
        for row in rows.sort_values("n").itertuples():
            if row.step < 0:
                held.pop(row.trace_id, None)
                continue
            held[row.trace_id] = None
            if len(held) > cap:
                out.append((row.tenant_id, held.popitem(last=False)[0], row.at))
        return pd.DataFrame(out, columns=["tenant_id", "trace_id", "evicted_at"])

    found = lines.groupBy("tenant_id", "stretch").applyInPandas(sweep, _EVICTED)
    return found.groupBy(*TRACE).agg(F.min("evicted_at").alias("evicted_at"))


def _rows_of(batch: DataFrame, taken: DataFrame) -> DataFrame:
    """The batch rows of the taken ids; a row that a source repeated counts once."""
    row = [*KEY, "request_id", "pos"]
    order = Window.partitionBy(*row).orderBy("received_at")
    return (batch.join(taken.select(*row), row, "left_semi")
            .withColumn("_copy", F.row_number().over(order))
            .filter(F.col("_copy") == 1).drop("_copy"))


def trace_state(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Roll events up to traces; each request that added rows is one generation."""
    at = F.col("received_at") if at is None else at
    return rows.groupBy(*TRACE).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
        (F.count_distinct("request_id") + 1).alias("generation"),
        F.count(F.lit(1)).cast("int").alias("span_count"))


def upsert_traces(traces: DataFrame, added: DataFrame) -> DataFrame:
    """Add staged counts to the trace table; untouched and closed traces stay as they are."""
    new = added.select(*TRACE, *[F.col(c).alias(f"_{c}") for c in
                                 ("first_seen", "last_seen", "generation", "span_count")])
    both = traces.join(new, list(TRACE), "full_outer")
    known = F.col("generation").isNotNull()
    return both.select(
        *TRACE,
        F.coalesce("first_seen", "_first_seen").alias("first_seen"),
        F.greatest("last_seen", "_last_seen").alias("last_seen"),
        F.when(known, F.col("generation") + F.coalesce(F.col("_generation") - 1, F.lit(0)))
        .otherwise(F.col("_generation")).alias("generation"),
        (F.coalesce("span_count", F.lit(0)) + F.coalesce("_span_count", F.lit(0)))
        .cast("int").alias("span_count"),
        "decision", "decided_at")


def to_buffers(events: DataFrame) -> DataFrame:
    return events.select("event_key", *TRACE, "envelope", "received_at")


def open_trace_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy("tenant_id").agg(
        F.count_if(F.col("decided_at").isNull()).alias("open_traces"))


def buffer_counts(buffers: DataFrame) -> DataFrame:
    return buffers.groupBy(*TRACE).agg(F.count(F.lit(1)).alias("buffered"))


def evict_oldest(traces: DataFrame, cap: int = MAX_OPEN_TRACES) -> DataFrame:
    """Open traces beyond the newest ``cap`` of their tenant.

    Only the ``cap`` newest rows per tenant are ranked (the row limit also runs before the
    shuffle); the oldest of them is the threshold the other open traces are compared with, so
    a tenant with very many traces is never sorted in one task.
    """
    still_open = traces.filter(F.col("decided_at").isNull())
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("first_seen"), F.desc("trace_id"))
    edge = (still_open.select(*TRACE, "first_seen")
            .withColumn("_rank", F.row_number().over(newest))
            .filter(F.col("_rank") <= cap).filter(F.col("_rank") == cap)
            .select("tenant_id", F.struct("first_seen", "trace_id").alias("edge")))
    return (still_open.join(edge, "tenant_id")
            .filter(F.struct("first_seen", "trace_id") < F.col("edge")).drop("edge"))


def evict_pressure(traces: DataFrame, buffers: DataFrame, as_of,
                   cap: int = MAX_OPEN_TRACES) -> DataFrame:
    """Decision rows for traces evicted under pressure, with their buffered counts."""
    return (evict_oldest(traces, cap).select(*TRACE)
            .join(buffer_counts(buffers), list(TRACE), "left")
            .select(*TRACE, F.lit(schemas.EVICTED_PRESSURE).alias("reason"),
                    F.lit(False).alias("retained"),
                    F.coalesce("buffered", F.lit(0)).cast("int").alias("span_count"),
                    as_ts(as_of).alias("created_at")))


def evicted_decisions(evicted: DataFrame, buffers: DataFrame) -> DataFrame:
    """Decision rows for ``evicted`` traces (tenant_id, trace_id, evicted_at), with their buffered counts."""
    return (evicted.join(buffer_counts(buffers), list(TRACE), "left")
            .select(*TRACE, F.lit(schemas.EVICTED_PRESSURE).alias("reason"),
                    F.lit(False).alias("retained"),
                    F.coalesce("buffered", F.lit(0)).cast("int").alias("span_count"),
                    F.col("evicted_at").alias("created_at")))


def evict_span_limit(traces: DataFrame, as_of, cap: int = MAX_TRACE_SPANS) -> DataFrame:
    """Optional other treatment of over-long traces: close them as evicted."""
    return (traces.filter(F.col("decided_at").isNull() & (F.col("span_count") > cap))
            .select(*TRACE, F.lit(schemas.EVICTED_SPAN_LIMIT).alias("reason"),
                    F.lit(False).alias("retained"), "span_count",
                    as_ts(as_of).alias("created_at")))


def ready_traces(traces: DataFrame, as_of, quiet_seconds: float = 2.0,
                 limit: int | None = 32) -> DataFrame:
    """Open traces without a new event for ``quiet_seconds``, longest quiet first.

    ``limit=None`` takes all of them, which needs no ordering.
    """
    quiet = F.make_dt_interval(secs=F.lit(quiet_seconds if quiet_seconds > 0 else 2.0))
    ready = (traces.filter(F.col("decided_at").isNull()
                           & (F.col("last_seen") <= as_ts(as_of) - quiet))
             .select(*TRACE, "generation", "last_seen"))
    if limit is None:
        return ready
    return ready.orderBy("last_seen", *TRACE).limit(max(limit, 1))


def load_trace(buffers: DataFrame, ready: DataFrame) -> DataFrame:
    """Buffered rows of the chosen traces.  Order by ``received_at, event_key`` per trace where
    an order is needed; a decision does not depend on it."""
    return buffers.join(ready.select(*TRACE, "generation"), list(TRACE))


def valid_decisions(traces: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose trace is open and unchanged since it was read; others are no-ops."""
    return decisions.join(
        traces.filter(F.col("decided_at").isNull()).select(*TRACE, "generation"),
        [*TRACE, "generation"], "left_semi")


def apply_decisions(traces: DataFrame, decisions: DataFrame) -> DataFrame:
    """Close decided traces.  ``decisions`` needs ``reason, span_count, created_at``; one with
    a ``generation`` other than the trace's is ignored."""
    if "generation" in decisions.columns:
        decisions = valid_decisions(traces, decisions)
    verdicts = decisions.select(*TRACE, F.col("reason").alias("_reason"),
                                F.col("span_count").alias("_count"),
                                F.col("created_at").alias("_at"))
    closes = F.col("_reason").isNotNull() & F.col("decided_at").isNull()
    return traces.join(verdicts, list(TRACE), "left").select(
        *TRACE, "first_seen", "last_seen", "generation",
        F.when(closes, F.col("_count")).otherwise(F.col("span_count")).cast("int")
        .alias("span_count"),
        F.when(closes, F.col("_reason")).otherwise(F.col("decision")).alias("decision"),
        F.when(closes, F.col("_at")).otherwise(F.col("decided_at")).alias("decided_at"))


def purge_buffers(buffers: DataFrame, decisions: DataFrame) -> DataFrame:
    return buffers.join(decisions.select(*TRACE), list(TRACE), "left_anti")


def enqueue_retained(buffers: DataFrame, decisions: DataFrame, outbox: DataFrame,
                     as_of) -> DataFrame:
    """New outbox rows: buffers of retained traces that are not in the outbox yet."""
    kept = decisions.filter("retained").select(*TRACE)
    return (buffers.join(kept, list(TRACE), "left_semi")
            .join(outbox.select(*KEY), list(KEY), "left_anti")
            .select("event_key", "tenant_id", "envelope", F.lit(0).alias("attempts"),
                    F.lit(None).cast("timestamp").alias("published_at"),
                    as_ts(as_of).alias("created_at")))
