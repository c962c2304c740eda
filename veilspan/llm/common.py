"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import shared_dir

ASCII_SPACE = " \t\n\x0b\x0c\r"
_KEEP_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write once below the cluster's shared folder and read back: cuts the lineage, survives executors."""
    path = f"{shared_dir(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positional(df: DataFrame) -> DataFrame:
    """The columns under the names c0, c1, ..., so that no name of the user meets one of an operator."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The positional name of a column of ``df``, found as Spark finds it: in any letter case."""
    if name in df.columns:
        return f"c{df.columns.index(name)}"
    folded = [c.lower() for c in df.columns]
    if name.lower() not in folded:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return f"c{folded.index(name.lower())}"


def own_columns(df: DataFrame, made: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` out of their positional names, but for those called like one of ``made``, in any letter case."""
    taken = {m.lower() for m in made}
    return [F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns) if c.lower() not in taken]


def broadcast_value(df: DataFrame, value):
    """Ship a value whose size the caller has bounded."""
    return df.sparkSession.sparkContext.broadcast(value)


class _Known(dict):
    """Hashes by word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class WordHashes:
    """64-bit hashes of byte words, remembered for the frequent ones; the memory is bounded."""

    def __init__(self, keep: int = _KEEP_WORDS):
        self.keep, self.known = keep, _Known()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xFF51AFD7ED558CCD], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x ^ (x >> np.uint64(33))  # a new array, which is then changed in place
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort, which is faster than ``np.unique`` on short arrays."""
    x = np.sort(x)
    return x[starts_of_runs(x)]


def starts_of_runs(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` words; a shorter non-empty sequence is one run as a whole."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = scramble(out * _MIX[k % 5] + words[k:len(words) - size + 1 + k])
    return out
