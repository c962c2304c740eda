"""Running aggregates within keys of any size.

A window over a key puts all rows of the key into one task.  Here rows are ranged over the key and the
order instead, so that a dominant key spans many partitions; each partition runs its own window, and what
the earlier partitions of the key hold is added.  A key that spans partitions is the first of all but one of
them, so there are fewer such additions than partitions, whatever the data: they are safe to broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import shared_dir

Fold = tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]

# How rows, and then partitions, are folded.
SUM: Fold = (F.sum, lambda a, b: a + b)
XOR: Fold = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
MAX: Fold = (F.max, F.greatest)


def written(df: DataFrame) -> DataFrame:
    """Write below the cluster's shared folder and read back, in place of a cached or recomputed input."""
    path = f"{shared_dir(df.sparkSession, 'scan')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], folds: dict[str, tuple[Fold, Column]],
            partitions: int | None = None) -> DataFrame:
    """``df`` with each column of ``folds`` folded over its row and all earlier ones of the same key.

    Rows that tie in ``order`` take some order among themselves, one after the other.  Nulls in ``by`` are
    one key.  The input is written once, ranged, so that both passes see the same partitions.
    """
    made = {name: f"_{name}_{uuid.uuid4().hex[:8]}" for name in (*folds, "part", "place")}
    part, place = made["part"], made["place"]
    keys = [F.col(f"`{c}`") for c in by]
    ranged = (df.repartitionByRange(partitions, *keys, *order) if partitions else df.repartitionByRange(*keys, *order))
    ranged = ranged.sortWithinPartitions(*keys, *order).withColumns(
        {part: F.spark_partition_id(), place: F.monotonically_increasing_id(),
         **{made[name]: value for name, (_, value) in folds.items()}})
    ranged = written(ranged)
    totals = ranged.groupBy(*keys, part).agg(*[fold[0](F.col(made[name])).alias(made[name]) for name, (fold, _) in folds.items()])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spanning = totals.select(*[k.alias(f"{part}_{n}") for n, k in enumerate(keys)], F.col(part).alias(f"{part}_part"),
                             *[fold[0](F.col(made[name])).over(earlier).alias(f"{made[name]}_before")
                               for name, (fold, _) in folds.items()],
                             F.row_number().over(Window.partitionBy(*keys).orderBy(part)).alias(f"{place}_part"))
    spanning = spanning.where(F.col(f"{place}_part") > 1).drop(f"{place}_part")  # fewer rows than partitions
    same = reduce(Column.__and__, [k.eqNullSafe(F.col(f"{part}_{n}")) for n, k in enumerate(keys)],
                  F.col(part) == F.col(f"{part}_part"))
    inside = Window.partitionBy(*keys, part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({made[name]: fold[0](F.col(made[name])).over(inside) for name, (fold, _) in folds.items()})
    out = out.join(F.broadcast(spanning), same, "left")
    folded = []
    for name, (fold, _) in folds.items():
        here, before = F.col(made[name]), F.col(f"{made[name]}_before")
        folded.append(F.when(before.isNull(), here).when(here.isNull(), before).otherwise(fold[1](before, here)).alias(name))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in folds], *folded)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a number from 1, without gaps, of each row within its key."""
    return running(df, by, order, {name: (SUM, F.lit(1).cast("long"))}, partitions)
