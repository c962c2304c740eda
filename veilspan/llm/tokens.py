"""Token counts of documents by way of distinct pre-tokens.

A bounded block of documents becomes a sparse table of frequencies (pre-token, document, times).  The
pieces of each distinct pre-token are counted once, by the library, and remembered by the task; the
counts are joined to the frequencies by pre-token and summed per document.  Ids are never kept.  Frequencies
and counts meet inside the task: shuffling them by pre-token moves several times the size of the texts.

White space followed by other characters is cut out of the text first, because the pre-tokenizer never
merges from a character into white space after it; the tokenizer's own pattern then cuts each distinct
one, and the library itself counts the pieces.  Special strings in a text are one token each, the
library's default.

Defined results: null text is empty and has no tokens; repeated rows give a row each; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_DOCS = 1000
BLOCK_BYTES = 8 << 20
LIMIT = 1024
_KEEP_TOKENS = 1 << 20
_CHUNK = re.compile(r"\s*\S+|\s+")
# Control characters that Python takes for white space and the tokenizer doesn't.
_ODD = re.compile(r"[\x1c-\x1f]")


class PreTokens:
    """Cuts texts as the tokenizer's pre-tokenizer does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.special = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def chunks(self, text: str) -> list[str]:
        """Parts of the text whose pre-tokens don't depend on their neighbours."""
        out: list[str] = []
        for k, part in enumerate(self.cut_special.split(text)):
            if k % 2:
                out.append(part)
            elif _ODD.search(part):
                out.append(part)
            else:
                out += _CHUNK.findall(part)
        return out

    def of_chunk(self, chunk: str) -> list[str]:
        return [chunk] if chunk in self.special else self.pattern.findall(chunk)


class PieceCounts:
    """Pieces of distinct pre-tokens, by the library; each is counted once while it is remembered."""

    def __init__(self, path: str, keep: int = _KEEP_TOKENS):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        new = [t for t in tokens if t not in known]
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            known.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, a bounded number of documents and bytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and (len(texts) >= BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


def frequencies(chunks: list[list[str]], cut: PreTokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block, and its sparse frequencies as (pre-token, document, times)."""
    chunk_no = {c: k for k, c in enumerate(dict.fromkeys(c for part in chunks for c in part))}
    token_no: dict[str, int] = {}
    inside = [[token_no.setdefault(p, len(token_no)) for p in cut.of_chunk(c)] for c in chunk_no]
    lengths = np.array([len(x) for x in inside], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.array([p for x in inside for p in x], np.int64)
    every = np.array([chunk_no[c] for part in chunks for c in part], np.int64)
    document = np.repeat(np.arange(len(chunks)), [len(part) for part in chunks])
    n = lengths[every]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    token = flat[np.repeat(starts[every], n) + step]
    pair, times = np.unique(token * len(chunks) + np.repeat(document, n), return_counts=True)
    return list(token_no), pair // len(chunks), pair % len(chunks), times


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one per row of ``docs``."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = PreTokens(path), PieceCounts(path)
        for ids, texts in _blocks(batches):
            token, which, document, times = frequencies([cut.chunks(t) for t in texts], cut)
            counts = pieces(token)
            total = np.bincount(document, counts[which] * times, len(texts)).astype(np.int64)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(total)],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
