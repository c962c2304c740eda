"""Best-fit packing of token pieces into sequences of a fixed capacity.

Documents are tokenized once per distinct word in a task (the tokenizer never merges across ASCII white
space), ended by a separator id, and cut only when they are longer than a sequence.  Pieces are dealt
by hash to lanes of a bounded number of documents.  Each lane packs online in one pass: a bounded
number of open bins, a bitset with one bit per free space, the bin that the piece fills best takes it,
and when a new bin is needed beyond the bound, the fullest open one closes.

Defined results: null text is an empty document, which is the separator alone; repeated rows are packed
one by one; an empty table gives no rows; a null id is kept; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 256
LANE_DOCS = 50_000
_KEEP_WORDS = 1 << 20
_SLICE = 256
# Letters that no normal form changes and that have no special lower case; no "<", which may begin a special token.
_PLAIN = re.compile(r"[\x21-\x3b\x3d-\x7e\u00c0-\u012f\u0131-\u024f]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class WordIds(dict):
    """Token ids of texts, by way of the ids of their ASCII-white-space words; memory is bounded.

    Words of plain Latin letters go straight to the tokenizer's model, cut by its own pattern; any other
    word takes the whole way through normalizer and pre-tokenizer.
    """

    def __init__(self, path: str, keep: int = _KEEP_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = self.tokenizer.model
        cutter = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(cutter).findall

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text):
            pieces = self.cut(text.lower())
            if len(pieces) > 1:
                self[word] = found = b"".join([self[p.encode()] for p in pieces])
                return found
            ids = [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def ids(self, text: str) -> np.ndarray:
        """Little-endian ids of a text."""
        if len(self) > self.keep:
            self.clear()
        data = text.encode()
        # Lower-casing ASCII first saves entries; it must not turn text into a special token.
        words = data.split() if b"<|" in data else data.lower().split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
             separator: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Rows (id, piece, start, ids): ``ids`` are little-endian unsigned 32-bit token ids, at most ``capacity``."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.array([separator], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                ids, number, start, body = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = np.concatenate([words.ids(text), end])
                    for k, s in enumerate(range(0, len(found), capacity)):
                        ids.append(doc_id)
                        number.append(k)
                        start.append(s)
                        body.append(found[s:s + capacity].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, part.schema.field(0).type), pa.array(number, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(body, pa.binary())],
                    names=["doc_id", "piece", "start", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, ids binary")


class OpenBins:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.bits, self.by_free, self.open, self.opened = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _pop(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._pop(free)
        else:
            if self.open >= self.bound:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, chosen = self.capacity, self.opened
            self.opened += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(chosen)
            self.bits |= 1 << rest
            self.open += 1
        return chosen, self.capacity - free


def pack(pieces: DataFrame, lanes: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with (doc_id, piece, start, length); other columns pass through.

    The order inside a lane is fixed by the rows, so a repeated task gives the same sequences.
    """
    mix = F.xxhash64("doc_id", "piece", "length")
    dealt = pieces.withColumn("_mix", mix).withColumn("_lane", F.pmod("_mix", F.lit(lanes)))
    # Random order: with a bounded number of open bins, sorting by length would close them half empty.
    dealt = dealt.repartition("_lane").sortWithinPartitions("_lane", "_mix", "doc_id", "piece", "start")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, bins = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sequence, offset = [], []
            for of, length in zip(table["_lane"].to_pylist(), table["length"].to_pylist()):
                if of != lane:
                    lane, bins = of, OpenBins(capacity, open_bins)
                number, place = bins.place(length)
                sequence.append((lane << 36) + number)
                offset.append(place)
            out = table.select(names).append_column("sequence_id", pa.array(sequence, pa.int64()))
            yield from out.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def lanes_for(docs: DataFrame, lane_docs: int = LANE_DOCS) -> int:
    return max(1, round(docs.count() / lane_docs))
