"""Byte-level BPE encoding and decoding by merge ranks.

A text is cut by the tokenizer's pattern, and each match is encoded by itself.  A segment tree lies over the
byte positions of a match: the leaf of a live position holds the rank of the pair that begins there, with the
position below it, so the root is the leftmost pair of the least rank.  A merge changes three leaves (its
own, that of the part it takes in, that of the live neighbour to its left) and the nodes above them.

Short matches go through one array of trees, a merge of each at a time; long ones have a tree of their own,
so a match of n bytes takes n log n steps whatever its length.  Both give what merging the leftmost pair of
least rank again and again gives.  A match that is a token as a whole is that token.

Encoded chunks of text are remembered by the task up to a bound.  White space after other characters
always begins a match, so texts are cut there first.

Defined results: null text is empty and has no tokens; null ids decode to null; repeated rows give a row each;
an empty table gives no rows; special strings are ordinary text; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

LONGEST_IN_ARRAY = 64
BATCH = 4096
BLOCK_DOCS = 500
BLOCK_CHARS = 4 << 20
KEEP_CHUNKS = 1 << 19
KEEP_CHARS = 200
_NONE = np.int64(1) << 40  # above every rank
_CHUNK = re.compile(r"\s*\S+|\s+")
_ODD = re.compile(r"[\x1c-\x1f]")  # white space to Python's re, but not to the pattern


@lru_cache(maxsize=2)
def load_tokens(path: str) -> list[bytes | None]:
    """The tokens by rank."""
    with open(path, "rb") as lines:
        rank = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [rank.get(r) for r in range(max(rank) + 1)]


class Ranks:
    """Merge ranks, with the rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        self.rank = {text: r for r, text in enumerate(load_tokens(path)) if text is not None}
        self.pair = {(self.rank[t[:k]], self.rank[t[k:]]): r for t, r in self.rank.items() for k in range(1, len(t))
                     if t[:k] in self.rank and t[k:] in self.rank}
        pairs = np.array([(a << 32 | b, r) for (a, b), r in self.pair.items()], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self._keys, self._ranks = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], _NONE)
        self.of_byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.of_byte < 0).any() or max(self.rank.values()) * LONGEST_IN_ARRAY + LONGEST_IN_ARRAY > np.iinfo(np.int32).max:
            raise ValueError("ranks must hold every single byte and be below 2^25")

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``; negative tokens pair with nothing."""
        key = (a << 32) | b
        at = np.searchsorted(self._keys, key)
        return np.where((self._keys[at] == key) & (b >= 0) & (a >= 0), self._ranks[at], _NONE)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Tokens of one match, with a tree of its own."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    pair, none = ranks.pair, (int(_NONE) << 32)
    ids = [int(x) for x in ranks.of_byte[np.frombuffer(piece, np.uint8)]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    for k in range(n - 1):
        r = pair.get((ids[k], ids[k + 1]))
        if r is not None:
            tree[width + k] = r << 32 | k
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, a: int, b: int) -> None:
        r = pair.get((a, b)) if b >= 0 else None
        node, value = width + at, none if r is None else r << 32 | at
        tree[node] = value
        while node > 1:
            value = min(tree[node], tree[node ^ 1])
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] < none:
        token, at = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        gone = after[at]
        ids[at], ids[gone] = token, -1
        after[at] = after[gone]
        put(gone, -1, -1)
        put(at, token, ids[after[at]] if after[at] < n else -1)
        if after[at] < n:
            before[after[at]] = at
        if before[at] >= 0:
            put(before[at], ids[before[at]], token)
    return [t for t in ids if t >= 0]


def merge_batch(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of matches of at most ``LONGEST_IN_ARRAY`` bytes, as little-endian 32-bit numbers; one tree per row."""
    count, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << int(max(lengths.max() - 1, 1)).bit_length()
    place = np.arange(width)
    used = place < lengths[:, None]
    ids = np.full((count, width + 1), -1, np.int64)  # the last column is beyond the end
    ids[:, :width][used] = ranks.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after, before = np.tile(place + 1, (count, 1)), np.tile(place - 1, (count, 1))
    after[after >= lengths[:, None]] = width
    none = np.iinfo(np.int32).max
    tree = np.full((count, 2 * width), none, np.int32)
    row, at = np.nonzero(used[:, 1:])
    r = ranks.pairs(ids[row, at], ids[row, at + 1])
    some = r < _NONE
    tree[row[some], width + at[some]] = r[some] * width + at[some]
    node = width
    while node > 1:
        node >>= 1
        tree[:, node:2 * node] = np.minimum(tree[:, 2 * node:4 * node:2], tree[:, 2 * node + 1:4 * node:2])
    row = np.flatnonzero(tree[:, 1] < none)
    while len(row):
        best = tree[row, 1].astype(np.int64)
        token, at = best // width, best % width
        gone = after[row, at]
        follower = after[row, gone]
        ids[row, at], ids[row, gone] = token, -1
        after[row, at] = follower
        inner = follower < width
        before[row[inner], follower[inner]] = at[inner]
        left = before[row, at]
        first = left < 0
        left[first] = at[first]  # no neighbour: the path of the merge once more
        tree[row, width + gone] = none
        for position, a, b in ((left, ids[row, left], token), (at, token, ids[row, follower])):
            r = ranks.pairs(a, b)
            tree[row, width + position] = np.where(r < _NONE, r * width + position, none)
        for path in (gone, left, at):
            path = path + width
            while path[0] > 1:
                path >>= 1
                tree[row, path] = np.minimum(tree[row, 2 * path], tree[row, 2 * path + 1])
        row = row[tree[row, 1] < none]
    live = ids[:, :width] >= 0
    ends = np.cumsum(live.sum(1)) * 4
    flat = ids[:, :width][live].astype("<u4").tobytes()
    ends = ends.tolist()
    return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of each match, as little-endian 32-bit numbers."""
    out: list[bytes | None] = [None] * len(pieces)
    todo: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = ranks.rank.get(piece)
        if whole is not None:
            out[k] = whole.to_bytes(4, "little")
        elif len(piece) > LONGEST_IN_ARRAY:
            out[k] = np.array(merge_long(piece, ranks), "<u4").tobytes()
        elif piece:
            todo.setdefault((len(piece) - 1).bit_length(), []).append(k)
        else:
            out[k] = b""
    for places in todo.values():  # trees of one width together
        for at in range(0, len(places), BATCH):
            some = places[at:at + BATCH]
            for k, ids in zip(some, merge_batch([pieces[k] for k in some], ranks)):
                out[k] = ids
    return out


class Encoder:
    """Encodes texts; chunks are remembered up to a bound, by all tasks of a worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern, self.known = load_ranks(path), regex.compile(pattern), {}

    def _learn(self, chunks: set[str]) -> None:
        """Encodes chunks that are not known, each distinct match once."""
        cut = [(c, self.pattern.findall(c)) for c in chunks]
        pieces = list({p for _, parts in cut for p in parts})
        ids = dict(zip(pieces, encode_pieces([p.encode() for p in pieces], self.ranks)))
        for c, parts in cut:
            self.known[c] = ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts))

    def __call__(self, texts: list[str]) -> list[bytes]:
        chunks = [[t] if _ODD.search(t) else _CHUNK.findall(t) for t in texts]
        if len(self.known) > KEEP_CHUNKS:
            self.known.clear()
        new = {c for part in chunks for c in part if c not in self.known}
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, part)) for part in chunks]
        for c in new:
            if len(c) > KEEP_CHARS:
                del self.known[c]
        return out


@lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def decode_ids(ids: bytes, tokens: list[bytes | None]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and values, a bounded number of rows and characters at a time."""
    ids, values, size = [], [], 0
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(value or ())
            if values and (len(values) >= BLOCK_DOCS or size + n > BLOCK_CHARS):
                yield ids, values
                ids, values, size = [], [], 0
            ids.append(doc_id)
            values.append(value)
            size += n
    if values:
        yield ids, values


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, ids), one per row of ``docs``; ids are little-endian unsigned 32-bit numbers."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        for ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(encoder(texts), pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, bytes): the text of each row of ids, as bytes.  An id beyond the ranks is an error."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids).alias("ids"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(path)
        for doc_ids, values in _blocks(batches):
            texts = [None if v is None else decode_ids(v, tokens) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, id_type), pa.array(values, pa.binary()), pa.array(texts, pa.binary())],
                                             names=["doc_id", "ids", "bytes"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary, bytes binary")
