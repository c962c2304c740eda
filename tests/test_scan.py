"""Running aggregates over ranged partitions against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from veilspan.operators import scan


def test_running_folds_across_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), n, rng.choice([None, 1, 5, -3])) for n in range(500)]
    df = spark.createDataFrame(rows, "k string, n long, v long").withColumn("part", F.lit("mine"))
    got = scan.running(df.repartition(5), ["k"], [F.col("n").desc()],
                       {"total": (scan.SUM, F.col("v")), "most": (scan.MAX, F.col("v")), "mixed": (scan.XOR, F.col("v")),
                        "no": (scan.SUM, F.lit(1))}, partitions=9)
    assert got.columns == ["k", "n", "v", "part", "total", "most", "mixed", "no"]
    so_far = defaultdict(list)
    want = {}
    for k, n, v in sorted(rows, key=lambda r: -r[1]):
        so_far[k].append(v)
        seen = [x for x in so_far[k] if x is not None]
        mixed = None
        for x in seen:
            mixed = x if mixed is None else mixed ^ x
        want[n] = (k, sum(seen) if seen else None, max(seen, default=None), mixed, len(so_far[k]))
    assert {r["n"]: (r["k"], r["total"], r["most"], r["mixed"], r["no"]) for r in got.collect()} == want


def test_ties_are_numbered_and_empty_tables_stay_empty(spark):
    df = spark.range(40).select(F.lit(1).alias("k"), F.lit(0).alias("t"))
    assert sorted(r["no"] for r in scan.numbered(df, ["k"], [F.col("t")], "no").collect()) == list(range(1, 41))
    assert scan.numbered(df.where("false"), ["k"], [F.col("t")], "no").collect() == []
