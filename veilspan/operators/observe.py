"""Request outcome counts, rates, latencies and run summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.predicates import route_bucket
from veilspan.operators import scan


def http_outcomes(requests: DataFrame) -> DataFrame:
    """Requests per service, bounded route label and code."""
    return (requests.select("service", route_bucket("path").alias("route"), "code")
            .groupBy("service", "route", "code").agg(F.count(F.lit(1)).alias("requests")))


def request_rate(requests: DataFrame, window: str = "1 minute", slide: str | None = None,
                 seconds: int = 60, watermark: str | None = None) -> DataFrame:
    """Requests and 5xx responses per second, per service and time window.

    Works on a stream as well; give a ``watermark`` there.
    """
    rows = requests.withWatermark("ts", watermark) if watermark else requests
    server_error = F.col("code").cast("string").rlike(r"\A5..\z")
    return (rows.groupBy(F.window("ts", window, slide or window), "service")
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(server_error).alias("errors"))
            .select(F.col("window.start").alias("window_start"), "service", "requests",
                    (F.col("requests") / seconds).alias("rate"),
                    (F.col("errors") / seconds).alias("error_rate_5xx")))


def latency_percentiles(df: DataFrame, by: Sequence[str], value: str,
                        percentiles: Sequence[int] = (50, 95, 99), accuracy: int = 10000,
                        labels_bounded: bool = False) -> DataFrame:
    """Exact order statistics: the value at index ``floor((n - 1) * p / 100)``.

    No group is sorted whole.  A bounded sketch first brackets each wanted rank; values below
    the bracket are only counted, map-side, and only distinct values inside it are put in
    order, over ranged partitions, so that a bracket of any size is spread over tasks.  Groups of up to ``accuracy`` rows are their own bracket.  Say ``labels_bounded``
    only where ``by`` holds metric labels, such as :func:`route_bucket`, whose number does not
    grow with the data: the brackets are then broadcast whatever the size estimate.
    """
    by = list(by)
    eps = 3.0 / accuracy
    sample = df.select(*by, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull())
    edges = [edge for p in percentiles
             for edge in (max(p / 100 - eps, 0.0), min(p / 100 + eps, 1.0))]
    sketch = sample.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.percentile_approx("_v", edges, accuracy).alias("q"))
    whole = F.col("n") <= accuracy
    brackets = sketch.select(*by, F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col("n"),
                 F.floor((F.col("n") - 1) * p / 100).cast("bigint").alias("rank"),
                 F.when(whole, F.col("low")).otherwise(F.col("q")[2 * i]).alias("lo"),
                 F.when(whole, F.col("high")).otherwise(F.col("q")[2 * i + 1]).alias("hi"))
        for i, p in enumerate(percentiles)])).alias("b"))
    brackets = brackets.select(*[F.col(c).alias(f"_of_{c}") for c in by], "b")
    brackets = F.broadcast(brackets) if labels_bounded else brackets
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by), F.lit(True))
    near = sample.join(brackets, same).filter(F.col("_v") <= F.col("b.hi")).select(
        *by, F.col("b.p").alias("p"), F.col("b.n").alias("n"), F.col("b.rank").alias("rank"),
        F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("v"))
    counted = near.groupBy(*by, "p", "n", "rank", "v").agg(F.count(F.lit(1)).alias("c"))
    running = scan.running(counted, [*by, "p"], [F.asc_nulls_first("v")], {"upto": (scan.SUM, F.col("c"))})
    return (running
            .filter((F.col("upto") > F.col("rank"))
                    & (F.col("upto") - F.col("c") <= F.col("rank")))
            .select(*by, F.col("p").alias("percentile"), F.col("n").alias("samples"),
                    F.col("v").alias("value")))


def run_summary(requests: DataFrame, by: Sequence[str], ts: str = "ts",
                accepted: str = "accepted") -> DataFrame:
    """Sent, accepted, failed, elapsed and accepted per second of a run."""
    elapsed = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1000.0)
    return (requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(F.col(accepted)).alias("accepted"),
        F.count_if(~F.col(accepted)).alias("failed"), elapsed.alias("elapsed_millis"))
        .withColumn("achieved_per_second", F.when(
            F.col("elapsed_millis") > 0, F.col("accepted") / (F.col("elapsed_millis") / 1000))
            .otherwise(F.lit(0.0))))
