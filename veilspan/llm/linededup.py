"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.  ``refs`` says which document
holds which key (128-bit digests of keys of at least ``min_chars``); ``counts`` says per key how many
documents hold it and the largest of them.  A key is frequent if at least ``min_docs`` documents hold it.
One cuckoo filter per shard of keys holds the frequent ones; only what passes a filter is looked up in
the exact counts, so filters decide nothing by themselves.  Inserting or deleting documents changes the
counts of the keys they hold and moves only keys that become or cease to be frequent in the filters, so
that deleting what was inserted restores the former answers.

Defined results: null and empty texts are one empty line; rows without an id hold no references and lose
no lines; repeated rows count as one document, and each loses the same lines; inserting a document again
changes nothing; an empty table gives no rows.  Columns of the input pass through, but in ``dedup`` those called
n_lines or n_dropped, in any letter case, give way to its counts; ``cleaned`` returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import ASCII_SPACE, own_columns, place, positional, stored
from veilspan.llm.cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_REFS = 100_000
_FILTERS = "shard int, filter binary"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For every line of a text, the digest of its key, or None if the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        line = line.strip(ASCII_SPACE)
        out.append(xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None)
    return out


def references(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, key), a document's keys once per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = set(line_keys(t, min_chars)) - {None}
                ids += [doc_id] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary())],
                                             names=["doc_id", "key"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(k)[8:16] for k in keys), "<u8")


@dataclass(frozen=True)
class LineIndex:
    """References, counts and filters; all are tables in the shared folder."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"),
                                               F.lit(self.shards)).cast("int"))

    def _changed(self, keys: DataFrame, refs: DataFrame) -> "LineIndex":
        """The index after the references of ``keys`` changed to those in ``refs``."""
        old = self.counts.join(keys, "key", "left_semi")
        new = stored(_counted(refs.join(keys, "key", "left_semi")), "counts")
        was = F.coalesce(F.col("o.n_docs") >= self.min_docs, F.lit(False))
        now = F.coalesce(F.col("n.n_docs") >= self.min_docs, F.lit(False))
        moved = old.alias("o").join(new.alias("n"), F.col("o.key") == F.col("n.key"), "full").select(
            F.coalesce("n.key", "o.key").alias("key"), was.alias("was"), now.alias("now")).where("was <> now")

        def update(filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            grown, gone = moves[moves["now"]], moves[moves["was"]]
            built = CuckooFilter.load(bytes(filters["filter"].iloc[0])) if len(filters) else CuckooFilter.for_size(len(grown))
            built.remove(_hashes(gone["key"]))
            built.add(_hashes(grown["key"]))
            shard = filters["shard"].iloc[0] if len(filters) else moves["shard"].iloc[0]
            return pd.DataFrame({"shard": [shard], "filter": [built.dump()]})

        filters = self.filters.groupBy("shard").cogroup(self._sharded(moved).groupBy("shard")).applyInPandas(update, _FILTERS)
        counts = self.counts.join(keys, "key", "left_anti").unionByName(new)
        return replace(self, refs=stored(refs, "refs"), counts=stored(counts, "counts"), filters=stored(filters, "filters"))

    def inserted(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> "LineIndex":
        """The index with these documents too."""
        fresh = references(docs, id_col, text, self.min_chars).distinct().join(self.refs, ["doc_id", "key"], "left_anti")
        return self._with(stored(fresh, "fresh"))

    def _with(self, fresh: DataFrame) -> "LineIndex":
        return self._changed(fresh.select("key").distinct(), self.refs.unionByName(fresh))

    def deleted(self, ids: DataFrame) -> "LineIndex":
        """The index without the documents whose ids are in ``ids.doc_id``."""
        ids = ids.select("doc_id").distinct()
        touched = self.refs.join(ids, "doc_id", "left_semi").select("key").distinct()
        return self._changed(stored(touched, "touched"), self.refs.join(ids, "doc_id", "left_anti"))

    def frequent(self, keys: DataFrame) -> DataFrame:
        """Rows (key, last_doc) of those of the given distinct keys that are frequent: filters first, then exact counts."""
        def screen(filters: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(asked):
                return asked[["key"]].iloc[:0]
            return asked[["key"]][CuckooFilter.load(bytes(filters["filter"].iloc[0])).contains(_hashes(asked["key"]))]

        passed = self.filters.groupBy("shard").cogroup(self._sharded(keys).groupBy("shard")).applyInPandas(screen, "key binary")
        return passed.join(self.counts.where(F.col("n_docs") >= self.min_docs), "key").select("key", "last_doc")


def empty_index(spark: SparkSession, shards: int, id_type: str = "long", min_docs: int = MIN_DOCS,
                min_chars: int = MIN_CHARS) -> LineIndex:
    make = lambda schema: spark.createDataFrame([], schema)
    return LineIndex(make(f"doc_id {id_type}, key binary"), make(f"key binary, n_docs long, last_doc {id_type}"),
                     make(_FILTERS), shards, min_docs, min_chars)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                min_chars: int = MIN_CHARS) -> LineIndex:
    """Index of a whole corpus, with shards of at most about ``SHARD_REFS`` keys whatever its size."""
    refs = stored(references(docs, id_col, text, min_chars).distinct(), "fresh")
    shards = 1 + refs.count() // SHARD_REFS
    return empty_index(docs.sparkSession, shards, docs.schema[id_col].dataType.simpleString(), min_docs, min_chars)._with(refs)


def _deduped(docs: DataFrame, index: LineIndex, id_col: str, text: str) -> DataFrame:
    """The columns of ``docs`` under positional names, the text rid of lines, and n_lines, n_dropped."""
    refs = references(docs, id_col, text, index.min_chars)
    frequent = index.frequent(refs.select("key").distinct())
    drops = refs.join(frequent, "key").where("doc_id < last_doc").groupBy(F.col("doc_id").alias("holder")).agg(
        F.collect_set("key").alias("dropped"))
    rows = positional(docs)
    names, body, min_chars = rows.columns, place(docs, text), index.min_chars
    rows = rows.join(drops.hint("merge"), F.col(place(docs, id_col)) == F.col("holder"), "left").select(*names, "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for t, drop in zip(batch.column(body).to_pylist(), batch.column("dropped").to_pylist()):
                lines = (t or "").split("\n")
                if drop:
                    drop = set(drop)
                    left = [x for x, key in zip(lines, line_keys(t, min_chars)) if key not in drop]
                else:
                    left = lines
                kept.append("\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = [pa.array(kept, pa.string()) if c == body else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             names=[*names, "n_lines", "n_dropped"])

    counts = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    return rows.mapInArrow(run, T.StructType([T.StructField(c, f.dataType) for c, f in zip(names, docs.schema)] + counts))


def dedup(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` rid of frequent lines that a larger id holds too, and n_lines, n_dropped."""
    made = ("n_lines", "n_dropped")
    return _deduped(docs, index, id_col, text).select(*own_columns(docs, made), *made)


def cleaned(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs``, ``text`` rid of frequent lines that a larger id holds too."""
    return _deduped(docs, index, id_col, text).select(*own_columns(docs))
