"""Deterministic tail decisions per trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.predicates import HEALTHY_MODULO, SLOW_MS, is_error, is_slow
from veilspan.functions.values import ColumnLike, col, hash_sampled

TRACE = ("tenant_id", "trace_id")


def trace_flags(events: DataFrame, attributes: ColumnLike = "attributes",
                slow_ms: float = SLOW_MS) -> DataFrame:
    """Per trace: any error, any slow event, and the event count.

    The flags are computed per event before grouping, so map-side partial aggregation keeps
    one small row per trace and a hot trace costs no more than any other.
    """
    slow_ms = slow_ms if slow_ms > 0 else SLOW_MS
    return (events.select(*TRACE, is_error(attributes).alias("e"),
                          is_slow(attributes, slow_ms).alias("s"))
            .groupBy(*TRACE)
            .agg(F.bool_or("e").alias("has_error"), F.bool_or("s").alias("has_slow"),
                 F.count(F.lit(1)).alias("span_count")))


def verdict(has_error: ColumnLike, has_slow: ColumnLike, trace_id: ColumnLike,
            modulo: int = HEALTHY_MODULO) -> Column:
    """Error before slow before hash sample before drop."""
    return (F.when(col(has_error), schemas.RETAINED_ERROR)
            .when(col(has_slow), schemas.RETAINED_SLOW)
            .when(hash_sampled(trace_id, modulo if modulo >= 1 else HEALTHY_MODULO),
                  schemas.RETAINED_SAMPLE)
            .otherwise(schemas.DROPPED_SAMPLE))


def retained(reason: ColumnLike) -> Column:
    return col(reason).isin(schemas.RETAINED_ERROR, schemas.RETAINED_SLOW,
                            schemas.RETAINED_SAMPLE)


def decide_traces(events: DataFrame, attributes: ColumnLike = "attributes",
                  modulo: int = HEALTHY_MODULO, slow_ms: float = SLOW_MS) -> DataFrame:
    """``tenant_id, trace_id, reason, retained, span_count`` for whole traces."""
    return (trace_flags(events, attributes, slow_ms)
            .select(*TRACE, verdict("has_error", "has_slow", "trace_id", modulo).alias("reason"),
                    "span_count")
            .select(*TRACE, "reason", retained("reason").alias("retained"), "span_count"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason", "retained").agg(F.count(F.lit(1)).alias("decisions"))


def sample_traces(traces: DataFrame, modulo: int = 1, limit: int = 100) -> DataFrame:
    """The first ``limit`` hash-selected trace ids, for later lookups."""
    return (traces.select("trace_id").distinct()
            .filter(hash_sampled("trace_id", max(modulo, 1)))
            .orderBy("trace_id").limit(limit))
