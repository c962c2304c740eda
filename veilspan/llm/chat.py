"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for every turn.  The whole
string is encoded once, with the character offsets of the tokens.  The spans of the turns to be learned
and the offsets are both sorted, so binary search finds the tokens of each span.

Control strings inside roles and texts are escaped: each ``<``, any backslashes, ``|`` gets one backslash
more, so no text can form a marker, and taking one backslash away restores it.

Defined results: null roles and texts are empty; turns are ordered by turn, role, text, null first;
repeated rows are turns of their own; all rows without a conversation id form one conversation; an empty
table gives no rows; other columns of the input are not read.  A conversation is one record: its rendered
text must fit in a task, as its single encoding demands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
_SLICE = 64
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)
_OUTPUT = ("conv_id {id}, formatted string, ids binary, starts binary, ends binary, "
           "loss array<struct<token_from: int, token_to: int, char_from: int, char_to: int>>")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character spans of the learned texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        parts += [head, body, END]
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def align(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Tokens that overlap each span; both are sorted."""
    a = np.searchsorted(ends, [s for s, _ in spans], "right")
    b = np.searchsorted(starts, [e for _, e in spans], "left")
    return [{"token_from": int(f), "token_to": int(max(f, t)), "char_from": s, "char_to": e}
            for (s, e), f, t in zip(spans, a, b)]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Made once by a worker: each one made anew leaves memory behind."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEPARATOR, END)])
    return tokenizer


def format_conversations(turns: DataFrame, learned: str = LEARNED, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: the formatted text, token ids and offsets, and the learned spans.

    ``ids``, ``starts`` and ``ends`` are little-endian unsigned 32-bit numbers.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def encoded(tokenizer, group: list, kind) -> pa.RecordBatch:
        rendered = [render(turns, learned) for _, turns in group]
        columns: list[list] = [[], [], [], []]
        for text, spans in rendered:
            e = tokenizer.encode(text, add_special_tokens=False)  # the cores are busy with other tasks
            offsets = np.array(e.offsets, "<u4").reshape(-1, 2)
            starts, ends = offsets[:, 0].copy(), offsets[:, 1].copy()
            for column, value in zip(columns, (np.array(e.ids, "<u4").tobytes(), starts.tobytes(), ends.tobytes(),
                                               align(spans, starts, ends))):
                column.append(value)
        whole = pa.struct([(k, pa.int32()) for k in ("token_from", "token_to", "char_from", "char_to")])
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in group], kind), pa.array([t for t, _ in rendered], pa.string()),
             *(pa.array(c, pa.binary()) for c in columns[:3]), pa.array(columns[3], pa.list_(whole))],
            names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, group, kind = _tokenizer(path), [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not group or group[-1][0] != conv_id:
                    if len(group) >= _SLICE:
                        yield encoded(tokenizer, group, kind)
                        group = []
                    group.append((conv_id, []))
                group[-1][1].append((role, text))
        if group:
            yield encoded(tokenizer, group, kind)

    return rows.mapInArrow(run, _OUTPUT.format(id=rows.schema["conv_id"].dataType.simpleString()))


def learned_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: list[dict]) -> str:
    """All text under the loss mask, read from the tokens' offsets and unescaped."""
    out, seen = [], 0
    for span in loss:
        part = []
        for k in range(span["token_from"], span["token_to"]):
            a, b = max(int(starts[k]), span["char_from"], seen), min(int(ends[k]), span["char_to"])
            if a < b:  # tokens that hold parts of one character have the same offsets
                part.append(formatted[a:b])
                seen = b
        out.append(unescape("".join(part)))
    return "".join(out)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, starts, ends, loss in zip(*(batch.column(k).to_pylist() for k in ("formatted", "starts", "ends", "loss"))):
                turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
                learned = learned_text(text, np.frombuffer(starts, "<u4"), np.frombuffer(ends, "<u4"), loss)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items())],
                names=["conv_id", *out])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
