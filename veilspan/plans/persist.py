"""Idempotent persistence of topic messages into the span table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilspan import schemas
from veilspan.operators import delivery
from veilspan.operators.staging import KEY
from veilspan.sources.tables import StateStore, write_spans
from veilspan.sources.topic import decode_messages


CLAIMS = T.StructType(schemas.LEDGER.fields + [T.StructField("claimed", T.BooleanType())])
LEDGER_TABLES = {"ledger_open": schemas.LEDGER, "ledger_settled": schemas.LEDGER,
                 "claims": CLAIMS}


def open_ledger(spark, root: str) -> StateStore:
    return StateStore(spark, root, LEDGER_TABLES)


def persist_batch(store: StateStore, messages: DataFrame, spans_path: str, as_of,
                  sink=write_spans, epoch: int | None = None, decoded: bool = False,
                  settled: bool = True) -> None:
    """Claim, write, mark persisted: one ledger version per batch.

    ``decoded`` says that ``messages`` are envelopes already, ``settled=False`` that they hold no key
    that was persisted before; then only the pending claims of the ledger are read.

    When the sink fails, a version with the claims still pending is published and the error is
    raised; the batch is not recorded as done, so its retry counts another attempt.  A crash
    between the span write and the publication repeats the rows, which reading by newest
    version hides.
    """
    if epoch is not None and epoch <= store.epoch():
        return
    version = store.begin()
    envelopes = messages if decoded else decode_messages(messages)
    waiting = store.read("ledger_open")
    ledger = waiting.unionByName(store.read("ledger_settled")) if settled else waiting
    store.write(version, "claims", delivery.claim_deliveries(envelopes, ledger, as_of), full=True)
    claims = store.pending("claims", version, full=True)
    held = waiting.join(claims.select(*KEY), list(KEY), "left_anti")
    mine = claims.filter("claimed")
    rows = delivery.to_span_rows(delivery.claimed_envelopes(envelopes, mine), as_of)
    try:
        sink(rows, spans_path)
    except Exception:
        store.write(version, "ledger_open", held.unionByName(mine.drop("claimed")), full=True)
        store.publish(version)
        raise
    store.write(version, "ledger_settled", delivery.mark_persisted(mine, as_of), full=False)
    store.write(version, "ledger_open", held, full=True)
    store.publish(version, epoch)
