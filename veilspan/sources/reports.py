"""Benchmark report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspan import schemas


def read_bench_runs(spark: SparkSession, path: str) -> DataFrame:
    """Ingest reports, one JSON document per file."""
    return spark.read.schema(schemas.BENCH_RUN).option("multiLine", True).json(path)


def read_bench_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Lookup reports, one JSON document per file."""
    return spark.read.schema(schemas.BENCH_LOOKUP).option("multiLine", True).json(path)
