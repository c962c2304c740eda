"""Leak scans, censuses and release gates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Release thresholds.  Fixed values.
MIN_RATE, RUN_SECONDS, RUN_MILLIS, MAX_LOOKUP_MILLIS = 5000, 600, 600000, 3000


def leak_scan(tables: Mapping[str, DataFrame], markers: Sequence[str]) -> DataFrame:
    """Rows per table and marker that hold the marker anywhere, keys and nested values too.

    One pass per table for all markers.  Reports counts and the marker's number, never
    content.  A table in which nothing was inspected fails.
    """
    if not markers or any(not m for m in markers):
        raise ValueError("non-empty markers are required")
    return reduce(DataFrame.unionByName,
                  [_scan(name, df, markers) for name, df in tables.items()])


def _scan(name: str, df: DataFrame, markers: Sequence[str]) -> DataFrame:
    def holds(text: Column, marker: str) -> Column:
        # Quotes, backslashes and control characters are escaped inside the JSON text.
        escaped = json.dumps(marker, ensure_ascii=False)[1:-1]
        return F.coalesce(text.contains(marker) | text.contains(escaped), F.lit(False))

    row = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    counts = row.agg(F.count(F.lit(1)).alias("inspected"), *[
        F.count_if(holds(F.col("row"), m)).alias(f"m{i}") for i, m in enumerate(markers, 1)])
    per_marker = F.explode(F.array(*[
        F.struct(F.lit(i).alias("marker_no"), F.col(f"m{i}").alias("matches"))
        for i in range(1, len(markers) + 1)]))
    return (counts.select("inspected", per_marker.alias("r"))
            .select(F.lit(name).alias("table_name"), "r.marker_no", "inspected", "r.matches",
                    ((F.col("inspected") > 0) & (F.col("r.matches") == 0)).alias("passed")))


def tail_row_census(tables: Mapping[str, DataFrame], tenant: str | None = None) -> DataFrame:
    """Rows per tail table and tenant."""
    return reduce(DataFrame.unionByName, [
        (df if tenant is None else df.filter(F.col("tenant_id") == tenant))
        .groupBy("tenant_id").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "tenant_id", "row_count")
        for name, df in tables.items()])


_RUN_NUMBERS = ("targetPerSecond", "durationSeconds", "elapsedMillis", "achievedPerSecond",
                "sent", "accepted", "failed", "p50Millis", "p95Millis", "p99Millis")
_LOOKUP_NUMBERS = ("p50Millis", "p95Millis", "p99Millis")


def bench_gates(runs: DataFrame, lookups: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run and release gate, in the order the gates apply.

    ``runs`` and ``lookups`` are report rows joined on ``key``; a missing lookup fails its
    gates.
    """
    look = lookups.select(key, F.struct(*[c for c in lookups.columns if c != key]).alias("l"))
    both = runs.join(look, key, "left")

    def finite(column: Column) -> Column:
        # NaN and infinity are no numbers in a report.
        return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))

    numbers = ([F.col(c).cast(T.DoubleType()) for c in _RUN_NUMBERS]
               + [F.col(f"l.{c}").cast(T.DoubleType()) for c in _LOOKUP_NUMBERS])
    gates = {
        "finite_numbers": reduce(lambda a, b: a & b, [finite(c) for c in numbers]),
        "target": F.col("targetPerSecond") >= MIN_RATE,
        "duration": F.col("durationSeconds") == RUN_SECONDS,
        "timestamps": F.col("startedAt").isNotNull() & F.col("finishedAt").isNotNull(),
        "trace_samples": F.size(F.coalesce("traceSamples", F.array().cast("array<string>"))) > 0,
        "no_failures": (F.col("accepted") == F.col("sent")) & (F.col("failed") == 0),
        "elapsed": F.col("elapsedMillis") >= RUN_MILLIS,
        "throughput": F.col("achievedPerSecond") >= MIN_RATE,
        "lookup_p95": F.col("l.lookupPass") & (F.col("l.p95Millis") <= MAX_LOOKUP_MILLIS),
    }
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("gate_no"), F.lit(name).alias("gate"),
                 F.coalesce(ok, F.lit(False)).alias("passed"))
        for i, (name, ok) in enumerate(gates.items(), 1)]))
    return both.select(key, rows.alias("g")).select(key, "g.gate_no", "g.gate", "g.passed")
