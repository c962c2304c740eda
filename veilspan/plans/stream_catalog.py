"""The streaming operators over the given tables: each runs its stream to the end of the input
and returns what the sink or the state tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions import values as V
from veilspan.operators import ingest, observe, policy
from veilspan.plans.catalog import AS_OF, MODULO, query
from veilspan.plans.persist import open_ledger
from veilspan.plans.tail import TailConfig, open_store, outcomes, tail_cycle
from veilspan.session import shared_dir
from veilspan.sources import tables, topic
from veilspan.sources import testdata as data
from veilspan.streaming import batches, processors

_LIMIT_SECONDS = 1800


def _finish(started) -> None:
    """Wait for the end of the input; a stream that does not end, or fails, is an error."""
    try:
        if not started.awaitTermination(_LIMIT_SECONDS):
            raise TimeoutError("stream did not reach the end of its input")
    finally:
        started.stop()


def _to_files(stream: DataFrame, root: str) -> DataFrame:
    path = f"{root}/out"
    _finish(stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _newest_updates(stream: DataFrame, keys: list[str], root: str) -> DataFrame:
    """The last update of every key, windows that are still open included.

    A batch writes its updates to a folder of its own, so a repeated batch replaces them.  Rows
    that the watermark refused in the newest batches that Spark reports on are an error.
    """
    path = f"{root}/updates"

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    started = (stream.writeStream.outputMode("update").foreachBatch(keep)
               .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    _finish(started)
    dropped = sum(state["numRowsDroppedByWatermark"] for report in started.recentProgress
                  for state in report["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} rows came after the watermark")
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("newest"))
    return newest.select(*keys, "newest.*")


@query
def observe_stream(spark, sf):
    out = _to_files(processors.observe_stream(
        data.staging_batch(spark, sf, stream=True), modulo=MODULO), shared_dir(spark, "observe"))
    return out.filter("kind = 'decision'").select("tenant_id", "trace_id", "reason", "retained",
                                                  "span_count")


@query
def trace_stream(spark, sf):
    out = _to_files(processors.trace_stream(
        data.staging_batch(spark, sf, stream=True), quiet_seconds=3600, modulo=MODULO),
        shared_dir(spark, "traces"))
    return out.filter("kind = 'decision'").select("tenant_id", "trace_id", "reason", "retained",
                                                  "span_count")


@query
def trace_stream_retained(spark, sf):
    """The envelopes of the traces that ``trace_stream`` keeps, and the requests that it refuses."""
    out = _to_files(processors.trace_stream(
        data.staging_batch(spark, sf, stream=True), quiet_seconds=3600, modulo=MODULO, span_cap=3),
        shared_dir(spark, "retained"))
    return out.filter("kind <> 'decision'").select("tenant_id", "trace_id", "kind", "event_key", "request_id", "reason")


@query
def request_rate_stream(spark, sf):
    rates = observe.request_rate(data.http_requests(spark, sf, stream=True),
                                 watermark="1 hour")
    out = _newest_updates(rates, ["window_start", "service"], shared_dir(spark, "rates"))
    return out.select(V.format_ts_millis("window_start").alias("window_start"), "service",
                      "requests", F.round("rate", 6).alias("rate"),
                      F.round("error_rate_5xx", 6).alias("error_rate_5xx"))


def _tail(spark, sf, config):
    root = shared_dir(spark, "tail")
    store = open_store(spark, f"{root}/state")
    _finish(batches.tail_stream(
        data.trace_requests(spark, sf, stream=True), data.api_keys(spark),
        policy.active_policies(data.policies(spark)), store, f"{root}/topic",
        f"{root}/checkpoint", config, "deploy-1", ["@example"], available_now=True))
    return store


_DECISION = ("tenant_id", "trace_id", "reason", "retained", "span_count")
# Traces are quiet after hours and few may be open, so that all kinds of decisions occur.
_PRESSED = TailConfig(modulo=MODULO, quiet_seconds=6 * 3600, open_cap=16)


@query
def tail_stream(spark, sf):
    return _tail(spark, sf, TailConfig(modulo=MODULO)).read("tail_decisions").select(*_DECISION)


@query
def tail_pressure(spark, sf):
    return _tail(spark, sf, _PRESSED).read("tail_decisions").select(*_DECISION)


@query
def tail_in_slices(spark, sf):
    """The input of ``tail_pressure`` in four batches, one after the other in time."""
    root, parts = shared_dir(spark, "slices"), 4
    store = open_store(spark, f"{root}/state")
    requests = data.trace_requests(spark, sf)
    at = F.unix_micros("received_at")
    first, last = requests.agg(F.min(at), F.max(at)).first()
    for n in range(parts if first is not None else 0):
        within = F.floor((at - first) * parts / (last - first + 1)) == n
        judged = ingest.accept_requests(ingest.spread(requests.filter(within)), data.api_keys(spark),
                                        policy.active_policies(data.policies(spark)), "deploy-1", ["@example"])
        tail_cycle(store, ingest.inbox_rows(judged), f"{root}/topic", _PRESSED, epoch=n)
    return store.read("tail_decisions").select(*_DECISION)


@query
def tail_stream_outcomes(spark, sf):
    return outcomes(_tail(spark, sf, TailConfig(modulo=MODULO)))


@query
def persist_stream(spark, sf):
    root = shared_dir(spark, "persist-stream")
    topic.write_topic(data.outbox(spark, sf), f"{root}/topic")
    _finish(batches.persist_stream(
        topic.read_topic(spark, f"{root}/topic", stream=True), open_ledger(spark, f"{root}/ledger"),
        f"{root}/spans", f"{root}/checkpoint", clock=lambda epoch: V.as_ts(AS_OF),
        available_now=True))
    return tables.read_spans(spark, f"{root}/spans").select(
        "tenant_id", "event_key", "signal_type", "name",
        V.format_ts_millis("ingested_at").alias("ingested_at"))
