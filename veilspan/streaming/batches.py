"""Streams whose state lives in versioned tables: tail sampling and persistence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators.ingest import accept_requests, inbox_rows, spread
from veilspan.operators.staging import KEY
from veilspan.plans.persist import persist_batch
from veilspan.plans.tail import TailConfig, tail_cycle
from veilspan.session import ensure_conf
from veilspan.sources.tables import StateStore, write_spans
from veilspan.sources.topic import decode_messages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, checkpoint: str, each, available_now: bool,
           trigger: str) -> StreamingQuery:
    ensure_conf(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=trigger))
    return writer.start()


def tail_stream(requests: DataFrame, api_keys: DataFrame, policies: DataFrame, store: StateStore,
                topic: str, checkpoint: str, config: TailConfig = TailConfig(),
                deploy_version: str = "", deploy_expressions: Sequence[str] = (),
                available_now: bool = False, trigger: str = "1 second") -> StreamingQuery:
    """Request rows in, topic messages out; one tail cycle per micro-batch."""
    def each(batch: DataFrame, epoch: int) -> None:
        judged = accept_requests(spread(batch), api_keys, policies, deploy_version, deploy_expressions)
        tail_cycle(store, inbox_rows(judged), topic, config, epoch=epoch)

    return _start(requests, checkpoint, each, available_now, trigger)


def persist_stream(messages: DataFrame, store: StateStore, spans_path: str, checkpoint: str,
                   clock: Callable[[int], Column] | None = None, sink=write_spans,
                   available_now: bool = False, trigger: str = "1 second",
                   keep: str = "30 days") -> StreamingQuery:
    """Topic messages in, span rows out; a malformed message stops the stream.

    A key is claimed in Spark's state store, which forgets it after ``keep``: a batch costs what it
    holds, whatever was persisted before.  The claim stands once the batch is done, so a batch whose
    write failed is claimed again.  The ledger is written as evidence; only its pending claims, for the
    count of attempts, are read.  ``clock(epoch)`` gives the arrival time of a batch; the default is
    the wall clock, taken once per batch.
    """
    ensure_conf(messages.sparkSession)
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    claimed = (decode_messages(messages).withColumn("claimed_at", F.current_timestamp())
               .withWatermark("claimed_at", keep).dropDuplicatesWithinWatermark(list(KEY)).drop("claimed_at"))

    def each(batch: DataFrame, epoch: int) -> None:
        if clock is None:
            micros = batch.sparkSession.range(1).select(
                F.unix_micros(F.current_timestamp())).first()[0]
            as_of = F.timestamp_micros(F.lit(micros))
        else:
            as_of = clock(epoch)
        # The state is updated as the batch is read, so it is read once.
        rows = store.scratch("batch", epoch, batch)
        persist_batch(store, rows, spans_path, as_of, sink, epoch, decoded=True, settled=False)

    return _start(claimed, checkpoint, each, available_now, trigger)
