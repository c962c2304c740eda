"""Benchmark decontamination by SimHash of item-sized windows.

Items and texts are words (runs of ASCII letters and digits and of non-ASCII characters, lower-cased),
and their shingles are runs of five words, weighted by how often they occur.  A window can only be
similar to an item if it shares a shingle with some item; each shared shingle says where an item of its
size would start.  Those windows are fingerprinted with a 64-bit SimHash.  The index cuts the fingerprints
of the items into eight blocks of eight bits: two fingerprints within the radius differ by at most
``radius // 8`` bits in one of the blocks, so looking up every block value within that distance finds
all of them.  What is within the radius is verified by the exact weighted Jaccard similarity.

The benchmark is a stated query set: it is read in blocks of bounded size, each shipped to the tasks
and held against all documents in one narrow pass without a shuffle.

Defined results: null and empty texts have no words and match nothing, as documents and as items; an item
of fewer than five words is one shingle; repeated rows are judged one by one; an empty benchmark or table
finds nothing; the columns of documents pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import (
    WordHashes,
    broadcast_value,
    own_columns,
    place,
    positional,
    scramble,
    shingle_hashes,
)

WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LEAKS = "item_id {id}, start int, n_words int, similarity double"


def word_list(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode())


def simhash(shingles: np.ndarray) -> int:
    """Sign of the sum of the shingles' hash bits taken as -1 and 1; repeated shingles weigh more."""
    bits = np.unpackbits(scramble(shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    high = 2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)
    return int(np.packbits(high, bitorder="little").view("<u8")[0])


class HammingIndex:
    """All fingerprints within a radius, by multi-index hashing over eight blocks of eight bits."""

    def __init__(self, marks: list[int], radius: int = RADIUS):
        self.marks, self.radius = marks, radius
        near = [[v for v in range(256) if (v ^ w).bit_count() <= radius // 8] for w in range(256)]
        self.blocks: list[dict[int, list[int]]] = []
        for k in range(8):
            block = defaultdict(list)
            for number, mark in enumerate(marks):
                for value in near[mark >> 8 * k & 255]:
                    block[value].append(number)
            self.blocks.append(block)

    def within(self, mark: int) -> list[int]:
        found = set().union(*(self.blocks[k].get(mark >> 8 * k & 255, ()) for k in range(8)))
        return [n for n in sorted(found) if (self.marks[n] ^ mark).bit_count() <= self.radius]


class Detector:
    """Finds windows similar to the items of one block of the benchmark."""

    def __init__(self, items: list[tuple], words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.words, self.similarity, self.hashes = words, similarity, WordHashes()
        self.ids, self.sizes, self.weights, marks = [], [], [], []
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)  # shingle -> (item size, place in the item)
        self.least = words
        for item_id, text in items:
            found = self.hashes(word_list(text))
            if not len(found):
                continue
            shingles = shingle_hashes(found, words)
            self.least = min(self.least, len(found))
            self.ids.append(item_id)
            self.sizes.append(len(found))
            self.weights.append(Counter(shingles.tolist()))
            marks.append(simhash(shingles))
            for place, s in enumerate(shingles.tolist()):
                where[s].append((len(found), place))
        self.where = {s: sorted(set(x)) for s, x in where.items()}
        self.known = np.array(sorted(self.where), np.uint64)
        self.index = HammingIndex(marks, radius)

    def _windows(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(start, size) of the windows that a shared shingle points to."""
        out: set[tuple[int, int]] = set()
        for run in range(self.least, self.words + 1):  # shorter runs only for items as short
            if len(words) < run or not len(self.known):
                break
            shingles = shingle_hashes(words, run)
            at = np.searchsorted(self.known, shingles)
            for place in np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == shingles).tolist():
                for size, inside in self.where[int(shingles[place])]:
                    size = min(size, len(words))
                    out.add((max(0, min(place - inside, len(words) - size)), size))
        return out

    def leaks(self, text: str | None) -> list[dict]:
        """Per item the most similar window that is similar enough, the first of equals."""
        words = self.hashes(word_list(text))
        best: dict[int, tuple] = {}
        for start, size in sorted(self._windows(words)):
            shingles = shingle_hashes(words[start:start + size], self.words)
            weights = Counter(shingles.tolist())
            for number in self.index.within(simhash(shingles)):
                common = sum((weights & self.weights[number]).values())
                alike = common / (weights.total() + self.weights[number].total() - common)
                if alike >= self.similarity and alike > best.get(number, (0,))[0]:
                    best[number] = (alike, start, size)
        return [{"item_id": self.ids[n], "start": s, "n_words": w, "similarity": a} for n, (a, s, w) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one after the other."""
    block, size = [], 0
    for item_id, body in benchmark.select(id_col, text).toLocalIterator():
        if block and size + len(body or "") + 64 > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, body))
        size += len(body or "") + 64
    if block:
        yield block


def with_leaks(docs: DataFrame, items: list[tuple], item_type: str = "long", text: str = "text",
               words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The columns of ``docs`` under positional names, and ``leaks``: the block's items that each document holds,
    with the window's first word, size and similarity."""
    rows, body = positional(docs), place(docs, text)
    names = rows.columns
    shipped = broadcast_value(docs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shipped.value, words, similarity, radius)
        kind = pa.list_(pa.struct([("item_id", id_type), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            found = pa.array([detector.leaks(t) for t in batch.column(body).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, "leaks"])

    id_type = _arrow(item_type)
    leaks = T.StructField("leaks", T.ArrayType(T.StructType.fromDDL(_LEAKS.format(id=item_type))))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, leaks]))


def _arrow(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()


def _ids(benchmark: DataFrame, id_col: str) -> DataFrame:
    """The benchmark with ids as 64-bit integers, or as text if they are not integers."""
    integral = benchmark.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return benchmark.withColumn(id_col, F.col(id_col).cast("long" if integral else "string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start, n_words, similarity), one per document and item that it holds."""
    benchmark = _ids(benchmark, item_col)
    kind = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items in chain(benchmark_blocks(benchmark, item_col, item_text), [[]]):
        if items or out is None:
            found = with_leaks(rows, items, kind).select(F.col("c0").alias("doc_id"), F.explode_outer("leaks").alias("leak"))
            found = found.where("leak IS NOT NULL").select("doc_id", "leak.*")
            out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark."""
    benchmark = _ids(benchmark, item_col)
    kind = benchmark.schema[item_col].dataType.simpleString()
    rows, body = positional(docs), place(docs, text)
    for items in benchmark_blocks(benchmark, item_col, item_text):
        rows = with_leaks(rows, items, kind, body).where(F.size("leaks") == 0).drop("leaks")
    return rows.select(*own_columns(docs))
