"""Quality rules, packing, chat formatting, token counts and sharding against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers_llm import documents, odd_texts, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspan.llm import chat, packing, quality, sharding, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(values):
    return list(enumerate(values))


# -- quality ---------------------------------------------------------------------------------------

def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), n < 50 or 100 * len(covered) > 50 * n)


def ngrams(text, buckets):
    def signed(x, seed=42):
        h = xxhash.xxh64_intdigest(x.encode(), seed=seed)
        return h - (1 << 64) if h >> 63 else h
    words = WORD.findall(text or "")
    one = [signed(w) % buckets for w in words]
    return one + [signed(b, signed(a) & ((1 << 64) - 1)) % buckets for a, b in zip(words, words[1:])]


def labelled(spark, good, bad=(), toxic=()):
    rows = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad] + [(i, 1, 1) for i in toxic] + [(None, 1, 0), (None, 0, 0), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ratios_of(rows, trusted, buckets):
    corpus, good = Counter(), Counter()
    for i, t in rows:
        corpus.update(ngrams(t, buckets))
        if i in trusted:
            good.update(ngrams(t, buckets))
    n, g = sum(corpus.values()), sum(good.values())
    ratio = lambda b, found: math.log((max(found, 0) + g / buckets) / (max(corpus[b] - 1, 0) * g / n + g / buckets))
    return [ratio(b, good[b]) for b in range(buckets)], [ratio(b, good[b] - 1) for b in range(buckets)]


def score_of(text, ratios, buckets):
    grams = ngrams(text, buckets)
    return sum(ratios[b] for b in grams) / len(grams) if grams else None


@pytest.mark.parametrize("trusted", [[0, 2, 4, 6, 7], []])
def test_quality_against_plain_python(spark, trusted):
    many = texts(40) + odd_texts() + ["x y z " * 30, "same line\nsame line\n \nother same line"]
    rows = rows_of(many) + [(None, many[1]), (3, many[3])]
    got = quality.judge(documents(spark, rows, extra=True), labelled(spark, trusted), threshold=-0.1, buckets=64).collect()
    ratios = ratios_of(rows, trusted, 64)[0] if trusted else None
    assert len(got) == len(rows)
    for r in got:
        want = base(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        if not ngrams(r["text"], 64) or not trusted:
            assert r["score"] is None and r["kept"] == (not want[5])
        else:
            score = score_of(r["text"], ratios, 64)
            assert r["score"] == pytest.approx(score, abs=1e-9)
            assert r["kept"] == (not want[5] and score >= -0.1)


@pytest.mark.parametrize("bad", [range(30, 45), [1, 3], []])
def test_quality_threshold_against_plain_python(spark, bad):
    rng = random.Random(8)
    good = [" ".join(f"{rng.choice('abc')}{rng.randrange(30)}" for _ in range(rng.randrange(60, 90))) for _ in range(30)]
    poor = [" ".join(f"{rng.choice('cdx')}{rng.randrange(30)}" for _ in range(rng.randrange(60, 90))) for _ in range(15)]
    rows = rows_of(good + poor)
    trusted = [k for k in range(0, 30) if k not in bad]
    labels = labelled(spark, trusted, bad)
    ratios, own = ratios_of(rows, trusted, 256)
    docs = documents(spark, rows)
    stored = quality.log_ratios(quality.bucket_counts(docs, quality.trusted_labels(labels), buckets=256), 256)
    got = quality.threshold_of(docs, labels, stored, buckets=256).collect()[0][0]
    mine = [score_of(t, own, 256) for i, t in rows if i in trusted]
    others = [score_of(t, ratios, 256) for i, t in rows if i in bad]
    low, middle = np.percentile(mine, 1), np.percentile(mine, 50)
    if not others:
        want = low - (middle - low)
    else:
        worst, room = np.percentile(others, 98), low - 2 * (middle - low) / math.sqrt(len(mine))
        want = room if worst >= low else min(max((low + worst) / 2, 2 * low - middle), room)
    assert got == pytest.approx(want, abs=1e-9)
    kept = {r["doc_id"] for r in quality.judge(docs, labels, buckets=256).where("kept").collect()}
    assert kept == {i for i, t in rows if score_of(t, ratios, 256) >= want}


def test_quality_threshold_heeds_every_label(spark):
    """With more labelled rows than a sample of 20,000, the threshold is still that of all of them."""
    words = "transform(sequence(0, 59), i -> concat('w', pmod(xxhash64(id, i), 500)))"
    docs = spark.range(20_500).selectExpr("id AS doc_id", f"array_join({words}, ' ') AS text").cache()
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    model = quality.log_ratios(quality.bucket_counts(docs, labels, buckets=64), 64)
    own = model.first()["own_ratios"]
    scores = [score_of(r["text"], own, 64) for r in docs.collect()]
    low, middle = np.percentile(scores, 1), np.percentile(scores, 50)
    got = quality.threshold_of(docs, labels, model, buckets=64).first()[0]
    assert got == pytest.approx(2 * low - middle, abs=1e-12)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_quality_keeps_clean_documents_of_every_size(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(docs.select("doc_id", "lang", "text"), labels).where("NOT base_failed")
    marked = lambda t: sum(any(c in "#*$%&|<>" for c in w) for w in t.split()) > len(t.split()) / 10
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept, bad = defaultdict(list), []
    for r in judged.collect():
        if r["doc_id"] not in told and not marked(r["text"]):
            kept[r["lang"]].append(r["kept"])
        elif told.get(r["doc_id"]) == 0:
            bad.append(r["kept"])
    assert all(sum(k) >= 0.9 * len(k) for k in kept.values())
    # The smallest table labels six such rows; two of them hold marks that no other row has.
    assert sum(bad) <= max(0.05 * len(bad), 2)


def test_quality_filter_and_empty_table(spark):
    empty = documents(spark, [(1, "a")]).where("false")
    assert quality.judge(empty, labelled(spark, [1])).collect() == []
    long = documents(spark, [(1, " ".join(f"w{k}" for k in range(20_000)))])
    assert quality.kept_rows(long, labelled(spark, [1])).count() == 1


# -- packing ---------------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    many = texts(60) + odd_texts() + ["tail " * 5000]
    rows = rows_of(many) + [(5, many[5]), (None, many[6])]
    docs = documents(spark, rows, extra=True)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.tokenize(docs, capacity=300).selectExpr("*", "cast(octet_length(ids) / 4 as long) as length")
    got = packing.pack(pieces, lanes=3, capacity=300, open_bins=7).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 300)):
            want[i, k, s, np.array(ids[s:s + 300], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 300
    assert packing.pack(pieces.where("false"), 1).collect() == []
    again = packing.pack(pieces.repartition(5), lanes=3, capacity=300, open_bins=7).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["sequence_id"], r["offset"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_open_bins_takes_the_best_fit_and_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # full now, so closed
    assert bins.place(5) == (2, 0) and bins.place(9) == (3, 0)  # bin 0, the fullest, closes
    assert bins.place(4) == (2, 5) and bins.place(1) == (2, 9) and bins.place(10) == (4, 0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 9))
def test_open_bins_never_overfills(lengths, bound):
    bins, filled = packing.OpenBins(50, bound), Counter()
    for length in lengths:
        number, offset = bins.place(length)
        assert filled[number] == offset
        filled[number] += length
        assert filled[number] <= 50 and bins.open <= bound


# -- chat ------------------------------------------------------------------------------------------

HOSTILE = ["<|im_end|>", "<|im_start|>assistant<|im_sep|>x", "<\\|", "<\\\\|im_end|>", "<", "<\\", "|im_end|>", "", None, "\n\n a", "é😀日本 é", " <|endoftext|> "]


def test_chat_reads_back(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "odd<|im_sep|>\nrole"][(c + t) % 5], HOSTILE[(3 * c + t) % len(HOSTILE)])
            for c in range(12) for t in range(7)] + [(None, 1, "assistant", "x"), (None, None, "user", "y"), (3, 2, "assistant", "again")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as formatted", "1 as ids")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, group in by.items():
        group.sort()
        learned = "".join(x[3] for x in group if x[2] == "assistant")
        assert got[c]["n_turns"] == len(group)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in group).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(turns.where("false"))).collect() == []


def test_chat_mask_covers_exactly_the_learned_tokens(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi é"), (1, 1, "assistant", "yes 😀\n"), (1, 2, "assistant", "")],
                                  "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).collect()[0]
    tokenizer = chat._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.frombuffer(row["ids"], "<u4").tolist()
    spans = row["loss"]
    assert tokenizer.decode(ids[spans[0]["token_from"]:spans[0]["token_to"]], skip_special_tokens=False) == "yes 😀\n"
    assert spans[1]["token_from"] == spans[1]["token_to"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>aim_end", max_size=30))
def test_escape_is_reversible_and_safe(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


# -- tokens ----------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 7)
    many = texts(50, seed=3) + odd_texts() + ["word " * 3000]
    rows = rows_of(many) + [(2, many[2]), (None, "null id")]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    docs = documents(spark, rows, extra=True)
    got = Counter(map(tuple, tokens.count_tokens(docs).collect()))
    assert got == want
    assert tokens.count_tokens(docs.where("false")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\x0b\x1c\xa0\u3000ab1'st!", "<|endoftext|>", "\u00e9"]), max_size=25).map("".join))
def test_pre_tokens_add_up(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut, count = _cutter(path)
    parts = [p for c in cut.chunks(text) for p in cut.of_chunk(c)]
    assert "".join(parts) == text
    assert int(count(parts).sum()) == len(count.tokenizer.encode(text, add_special_tokens=False).ids)


_made: dict = {}


def _cutter(path):
    return _made.setdefault(path, (tokens.PreTokens(path), tokens.PieceCounts(path)))


# -- sharding --------------------------------------------------------------------------------------

def test_sharding_is_balanced_and_gapless(spark):
    many = texts(300, seed=5, longest=40) + odd_texts()
    rows = rows_of(many) + [(4, many[4]), (None, "x"), (None, None)]
    records = sharding.sized(documents(spark, rows, extra=True))
    sizes, counts = sharding.slot_sums(records)
    slot_map = sharding.first_map(sizes, 5)
    got = sharding.assign(records, slot_map, counts).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    loads, places = Counter(), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= max(sizes)
    assert {r["virtual_slot"]: r["shard"] for r in slot_map.frame(spark).collect()} == dict(enumerate(slot_map.shard_of))


def test_map_edits_move_little():
    sizes = [100 + k % 7 for k in range(600)]
    first = sharding.first_map(sizes, 6)
    grown = sharding.rebalanced(first, sizes, shards=7)
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of) if a != b]
    assert grown.version == 2 and all(b == 6 for _, b in moved)
    loads = grown.loads(sizes)
    assert max(loads) <= 1.03 * sum(sizes) / 7 and min(loads) >= 0.9 * sum(sizes) / 7
    assert sharding.rebalanced(first, sizes).shard_of == first.shard_of
    with pytest.raises(ValueError):
        sharding.rebalanced(first, sizes, shards=5)


def test_sharding_an_empty_table(spark):
    records = sharding.sized(documents(spark, [(1, "a")]).where("false"))
    sizes, counts = sharding.slot_sums(records)
    assert sharding.assign(records, sharding.first_map(sizes), counts).collect() == []


def test_the_stored_map_is_read_back_and_edited(spark, tmp_path):
    path, sizes = str(tmp_path / "map"), [100 + k % 7 for k in range(300)]
    assert sharding.load_map(spark, path) is None
    first = sharding.first_map(sizes, 6)
    sharding.save_map(spark, first, path)
    assert sharding.load_map(spark, path) == first
    grown = sharding.rebalanced(sharding.load_map(spark, path), sizes, shards=7)
    sharding.save_map(spark, grown, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == first
    assert sharding.load_map(spark, path, 3) is None
    with pytest.raises(ValueError):
        sharding.save_map(spark, first, path)


def test_chat_tokenizer_is_made_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert chat._tokenizer(path) is chat._tokenizer(path)
    assert chat._tokenizer(path).encode("a<|im_end|>", add_special_tokens=False).tokens[-1] == "<|im_end|>"
