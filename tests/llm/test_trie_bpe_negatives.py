"""Prefix trie, byte-level BPE and hard negatives against plain Python and the library."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers_llm import documents, odd_texts, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.llm import bytebpe, hardneg, prefixtrie

# -- prefix trie -----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie(rows):
    """Every node by walking all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = {}
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = [n for n in below if len(n) == len(node) + 1]
        out[min(who), len(node)] = (min(members[node[:-1]]) if node else None, len(who), len(children), len(leaves), saved,
                                    hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest())
    return out


def built(spark, rows, **more):
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    for name in ("depth", "n", "k1", "node", "length", "saving", "rep", "leaf"):
        df = df.withColumn(name, F.lit("mine"))
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in prefixtrie.build(
        *prefixtrie.rebuilt(prefixtrie.turns_of(df), **more)).collect()}


def test_trie_against_all_prefixes(spark):
    rng = random.Random(7)
    said = ["hi", "yes", "né", "", None, "long " * 40]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(said))
            for c in range(-6, 60) for t in range(rng.choice([1, 2, 3, 11]))]
    rows += [(c, t, "user", "copy") for c in range(200, 240) for t in range(12)]  # copies, and shorter copies of them
    rows += [(c, t, "user", "copy") for c in range(240, 250) for t in range(10)]
    rows += [(400, 0, "system", "one")]  # turnless where h takes its only turn and there is no base
    rows += [(401, 0, "user", "x" * 300_000), (402, 5, "user", "tie"), (402, 5, "user", "tie"), (402, 5, "assistant", "a tie")]
    rows += [(None, 0, "user", "of no conversation"), (None, None, None, None)]
    assert built(spark, rows) == trie(rows)


def test_trie_of_one_and_of_none(spark):
    rows = [(1, 0, None, None)]
    assert built(spark, rows) == trie(rows)
    empty = spark.createDataFrame([], TURNS)
    assert prefixtrie.build(*prefixtrie.rebuilt(prefixtrie.turns_of(empty))).collect() == []


def test_long_lists_of_ends_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE_IDS", 7)
    rows = spark.createDataFrame([(3, 1, 1, c) for c in range(-30, 70)] + [(3, 1, 2, 500)], "length long, k1 long, k2 long, conv_id long")
    got = {r["rep"]: r["ends_sha256"] for r in prefixtrie.ends_digests(rows.repartition(6)).collect()}
    assert got == {-30: hashlib.sha256(",".join(map(str, range(-30, 70))).encode()).hexdigest(),
                   500: hashlib.sha256(b"500").hexdigest()}


# -- byte-level BPE --------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
_made: dict = {}


def library():
    if not _made:
        with open(PATH, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _made["encoding"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made["encoding"]


def test_bpe_equals_the_library_and_reads_back(spark):
    many = texts(60, seed=9) + odd_texts() + ["a" * 5000, "ab" * 700 + "é" * 333, " " * 3000 + "x", "!?" * 999, "word " * 20_000]
    rows = list(enumerate(many)) + [(2, many[2]), (None, "null id")]
    docs = documents(spark, rows, extra=True).withColumn("ids", F.lit("mine")).withColumn("bytes", F.lit(0))
    encoded = bytebpe.encode(docs)
    want = Counter((i, np.array(library().encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    got = bytebpe.decode(encoded).collect()
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["bytes"])) for r in got) == want
    assert bytebpe.decode(bytebpe.encode(docs.where("false"))).collect() == []
    none = bytebpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()
    assert tuple(none[0]) == (1, None, None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abdehilnorstu éß日😀'-", min_size=1, max_size=90), min_size=1, max_size=20))
def test_trees_merge_as_the_library_does(words):
    ranks = bytebpe.load_ranks(PATH)
    pieces = [w.encode() for w in words]
    want = [np.array(library().encode_single_token(p) if p in ranks.rank else library()._encode_single_piece(p), "<u4").tobytes()
            for p in pieces]
    assert bytebpe.encode_pieces(pieces, ranks) == want
    for p in pieces:
        if p not in ranks.rank:
            assert bytebpe.merge_long(p, ranks) == library()._encode_single_piece(p)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\x0b\x1c\x85\xa0　ab1'st!", "<|endoftext|>", "é", "re", "ll"]), max_size=30).map("".join))
def test_chunks_do_not_change_the_tokens(text):
    got = bytebpe.load_encoder(PATH, public_tokenizers.PATTERN)([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == library().encode_ordinary(text)


def test_remembered_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(bytebpe, "KEEP_CHUNKS", 50)
    encoder = bytebpe.Encoder(PATH, public_tokenizers.PATTERN)
    for t in texts(80, seed=12):
        assert np.frombuffer(encoder([t])[0], "<u4").tolist() == library().encode_ordinary(t)
        assert len(encoder.known) <= 50 + 300


# -- hard negatives --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows, every, width):
    """Every score of every anchor, by whole numbers."""
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [float(np.float32(x)) for x in v])
        best[i] = min(best.get(i, row), row)
    q = {i: (label, [math.floor(256 * x) for x in v] + [0] * (width - len(v))) for i, (label, v) in best.items()}
    out = []
    for a, (label, va) in q.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, vb)), b) for b, (_, vb) in q.items() if b != a)
        for p in [(s, b) for s, b in scored if q[b][0] == label][:5]:
            inside = [(s, b) for s, b in scored if q[b][0] != label and 50 * -p[0] <= 100 * -s <= 95 * -p[0]]
            out += [(a, p[1], n, b, -p[0], -s) for n, (s, b) in enumerate(inside[:3], 1)]
    return sorted(out)


def clustered(n, width, seed, spread):
    """Vectors near one of few step functions, so that summaries of segments say much."""
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(size=(6, 4)), width // 4, axis=1)
    return [[float(x) for x in centres[k % 6] + spread * rng.normal(size=width)] for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_against_all_scores(spark, spread):
    rng = random.Random(3)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(clustered(300, 16, 1, spread))]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]  # one vector again and again
    rows += [(2000, None, 1), (2010, [None] * 16, 1), (2020, [float("nan")] * 16, 1), (2030, [float("inf")] * 16, 0),
             (2040, rows[0][1], None), (None, rows[0][1], 1), (2050, [], 1), (2060, [0.5] * 9, 2), (2070, [0.0] * 16, 3)]
    rows += [rows[20], (30, rows[31][1], 9), (2080, [1e9] * 16, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("q", F.lit("mine")).withColumn("summary", F.lit(1)).withColumn("id", F.lit("x"))
    got = hardneg.mine(df, F.col("id") % 10 == 0, block_rows=70, block_anchors=9).collect()
    assert sorted(map(tuple, got)) == mined(rows, 10, 16)
    assert len(got) > 100


def test_no_anchors_no_rows_no_positives(spark):
    rows = [(10, [1.0, 2.0], 1), (11, [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    anchor = F.col("id") % 10 == 0
    assert hardneg.mine(df, anchor).collect() == []
    assert hardneg.mine(df, anchor & F.lit(False)).collect() == []
    assert hardneg.mine(df.where("false"), anchor).collect() == []


def _block(vectors, labels, levels):
    q = np.floor(256 * np.array(vectors))
    flat = np.hstack(hardneg.summaries(q, levels))
    return hardneg.Block(pa.table({"id": np.arange(len(q)), "label": labels, "q": pa.array([x.tobytes() for x in q], pa.binary()),
                                   "summary": pa.array([x.tobytes() for x in flat], pa.binary())}), levels, q.shape[1])


def test_summaries_bound_every_score_and_exclude_most_rows_of_other_clusters():
    levels = (4, 16)
    block = _block(clustered(600, 64, 5, 0.05), np.zeros(600, np.int64), levels)
    exact = block.q @ block.q.T
    for level in block.summary:
        middle, reach = hardneg.bounds(level, level)
        assert (middle - reach - 0.5 <= exact).all() and (exact <= middle + reach + 0.5).all()
    slab, everything = slice(0, 60), [[(-np.inf, np.inf)]] * 60
    left = hardneg.surviving(block, slab, block, np.ones((60, 600), bool), everything, 5)
    best = np.argsort(-exact[:60], axis=1, kind="stable")[:, :5]
    assert np.take_along_axis(left, best, 1).all()
    assert left.sum(1).mean() < 150  # a cluster has 100 rows
