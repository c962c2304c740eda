"""Prefix trie of conversations: the distinct runs of first turns, and what sharing them saves.

Every turn has a 128-bit digest of its place, role and text; the key of a prefix is the exclusive or of its turns'
digests, so prefixes are told apart by their keys and can be formed by a scan.  Identical conversations
collapse into one weighted sequence that carries the list of conversations ending there.  Sequences that are
proper prefixes of others are found among the others' prefixes; an anti-join leaves the leaves.  The prefixes of
the distinct sequences, with their weights, add up to the nodes.

No step needs a key's rows in one task: order within conversations and along sequences comes from scans
over ranged rows, node values reach the sequences by a broadcast of the few nodes that hold over a
thousandth of all prefixes each, and by a join of the rest, and end lists are joined to text in parallel
pieces, of which the hash of a sequence reads the digits in order.

Defined results: turns are ordered by number (null first), then role, then digest of the text; null roles and texts are
empty; repeated rows are turns of their own; rows without a conversation id belong to no conversation;
without conversations there is no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import stored
from veilspan.operators import scan

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
HEAVY_SHARE = 1000
PIECE_IDS = 4096


def _half(digest: Column, first: int) -> Column:
    """16 hexadecimal digits of an MD5 as a signed 64-bit number."""
    return F.conv(F.substring(digest, first, 16), 16, -10).cast("long")


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """Rows (conv_id, n, content, n_bytes): the n-th turn of each conversation, from 1, with the digest of role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"),
        # The length keeps (role, text) pairs apart whose joined strings are equal.
        F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary")).alias("content"),
        F.octet_length(text_).cast("long").alias("n_bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]
    return stored(scan.numbered(rows, ["conv_id"], order, "n").select("conv_id", "n", "content", "n_bytes"), "turns")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations as (conv_id, depth, content, n_bytes) and the list of all as (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % heads, and goes on
    with its own turns after its first h.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "base": F.col("conv_id") - F.col("conv_id") % group})
    lengths = stored(lengths, "lengths")
    # Only heads of base conversations are copied: fewer than ``heads`` turns to fewer than 2 * group conversations.
    head = turns.where((F.col("n") < heads) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "n", "content", "n_bytes")
    heads_of = lengths.join(head.hint("merge"), "base").where("n <= h").select("conv_id", F.col("n").alias("depth"), "content", "n_bytes")
    of_base = lengths.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    sized = lengths.join(of_base.hint("merge"), "base", "left").select(
        "conv_id", "h", "own", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"))
    sized = stored(sized.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "sized")
    tails = turns.join(sized.hint("merge"), "conv_id").where("n > h").select(
        "conv_id", (F.col("n") - F.col("h") + F.col("taken")).alias("depth"), "content", "n_bytes")
    return heads_of.unionByName(tails), sized.select("conv_id", "length")


def with_keys(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, n_bytes, k1, k2): the key of every prefix of at least one turn."""
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("content")).cast("binary"))
    rows = turns.select("conv_id", "depth", "n_bytes", digest.alias("d")).select(
        "conv_id", "depth", "n_bytes", _half(F.col("d"), 1).alias("d1"), _half(F.col("d"), 17).alias("d2"))
    return scan.running(rows, ["conv_id"], [F.col("depth")], {"k1": (scan.XOR, F.col("d1")), "k2": (scan.XOR, F.col("d2"))}
                        ).select("conv_id", "depth", "n_bytes", "k1", "k2")


def ends_digests(ends: DataFrame) -> DataFrame:
    """Rows (rep, ends_sha256) of rows (length, k1, k2, conv_id): of each sequence, the smallest id and the hash of all
    its ids, ascending and joined by commas.

    Ranged rows become pieces of text first, so the task that hashes a long list reads few rows, and holds
    a batch of them at a time.
    """
    key = ["length", "k1", "k2"]
    ranged = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            columns = [pa.array([k], pa.int64()) for k in (*key, ids[0])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, ids))])], names=["length", "k1", "k2", "first", "digits"])

        for batch in batches:
            for *k, c in zip(*(column.to_pylist() for column in batch.columns)):
                if ids and (k != key or len(ids) >= PIECE_IDS):
                    yield piece()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield piece()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rep, state = None, None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for *k, first, digits in zip(*(column.to_pylist() for column in batch.columns)):
                if k != key:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    key, rep, state = k, first, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(digits.encode())
            yield hashed(done)
        if state is not None:
            yield hashed([(rep, state.hexdigest())])

    def hashed(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())],
                                          names=["rep", "ends_sha256"])

    parts = ranged.mapInArrow(pieces, "length long, k1 long, k2 long, first long, digits string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(hashes, "rep long, ends_sha256 string")


def _with_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Joins nodes to paths by key; nodes with many paths are few, whatever the data, and are broadcast."""
    total = nodes.agg(F.sum("n_paths")).first()[0] or 0
    heavy = F.col("n_paths") * HEAVY_SHARE > total  # fewer than HEAVY_SHARE nodes
    few = nodes.where(heavy).drop("n_paths").withColumnsRenamed({c: f"few_{c}" for c in ("node", "n_convs", "n_leaves")})
    paths = paths.join(F.broadcast(few), ["depth", "k1", "k2"], "left")
    light = paths.where("few_node IS NULL").drop("few_node", "few_n_convs", "few_n_leaves")
    light = light.join(nodes.where(~heavy).drop("n_paths").hint("merge"), ["depth", "k1", "k2"])
    known = paths.where("few_node IS NOT NULL").withColumnsRenamed({f"few_{c}": c for c in ("node", "n_convs", "n_leaves")})
    return known.unionByName(light)


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth, content, n_bytes) of all ``conversations`` (conv_id, length)."""
    keys = stored(with_keys(turns), "keys")
    last = keys.select("conv_id", F.col("depth").alias("length"), "k1", "k2")
    whole = conversations.join(last.hint("merge"), ["conv_id", "length"], "left").fillna(0, ["k1", "k2"])
    whole = stored(whole, "whole")
    # Whole-sequence collapse: identical conversations are one sequence, named by its smallest member.
    sequences = stored(whole.groupBy("length", "k1", "k2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    kept = sequences.select(F.col("rep").alias("conv_id"), "length", "weight")
    root = sequences.select(F.col("rep").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"),
                            F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "length", "weight")
    paths = keys.join(kept.hint("merge"), "conv_id").select(*root.columns).unionByName(root)
    proper = paths.where("depth < length").select(F.col("depth").alias("length"), "k1", "k2").distinct()
    leaves = sequences.join(proper.hint("merge"), ["length", "k1", "k2"], "left_anti").select(
        F.col("rep").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    paths = stored(paths.join(leaves.hint("merge"), "conv_id", "left").fillna(0, ["leaf"]), "paths")
    nodes = stored(paths.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("node"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.count("*").alias("n_paths")), "nodes")
    paths = _with_nodes(paths.select("conv_id", "depth", "length", "n_bytes", "k1", "k2"), nodes)
    # A node's saving is counted on the path of its smallest member; that member's path goes on through nodes it names.
    own = F.col("node") == F.col("conv_id")
    paths = paths.drop("k1", "k2").withColumn("saving", F.when(own, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0))
    paths = stored(scan.running(paths, ["conv_id"], [F.col("depth").desc()], {"below": (scan.SUM, F.col("saving"))}), "places")
    saved = paths.groupBy("node", "depth").agg(F.sum("below").alias("saved_tokens"))
    parents = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    named = paths.where(F.col("node") == F.col("conv_id")).select("conv_id", "depth", "n_convs", "n_leaves")
    named = stored(named.join(parents.hint("merge"), ["conv_id", "depth"], "left"), "named")
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    ends = paths.where("depth = length").select("conv_id", "depth", "node").join(
        ends_digests(whole).withColumnRenamed("rep", "conv_id").hint("merge"), "conv_id").select("node", "depth", "ends_sha256")
    out = named.withColumnRenamed("conv_id", "node")
    for more in (children, saved, ends):
        out = out.join(more.hint("merge"), ["node", "depth"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
                      F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
