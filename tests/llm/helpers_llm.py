"""Rows with awkward values, shared by the tests of the training-data operators."""

from __future__ import annotations

import random

WORDS = "the of and to Été groß über naïve cat's don't 12 3.5 *** ### <|endoftext|> a-b x,y 日本 مرحبا 😀 é".split()


def texts(n: int = 60, seed: int = 1, longest: int = 120) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, longest)):
            word = rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
            parts += [word, rng.choice([" ", " ", " ", " ", "\n", "  ", "\t", "\x0b", " \n "])]
        out.append("".join(parts))
    return out


def odd_texts() -> list:
    return [None, "", " ", "\n", "\n\n", "a", "a b", " a ", "a\x1cb \x1c c", "x\xa0 y　 z", "İstanbul ΟΔΟΣ ﬁ Å",
            "<|endoftext|>", "x <|endoftext|> y", "<|ENDOFTEXT|> <|startoftext|>", "a  \n  b", "'s 't I'll", "𝔘𝔫𝔦́"]


def documents(spark, rows, extra: bool = False):
    """Rows are (doc_id, text); with ``extra``, columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for name in ("kept", "score", "piece", "start", "length", "offset", "sequence_id", "n_words", "slot", "shard", "line",
                     "lang", "size", "component_id", "n_shingles", "_words", "key", "block", "pre_token", "item_id"):
            df = df.withColumn(name, F.lit("clash"))
    return df
