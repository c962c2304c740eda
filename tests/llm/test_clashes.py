"""Columns of the user stay theirs, whatever their names."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from veilspan.llm import decontam, linededup, quality, templates

NAMES = ["_lines", "_trimmed", "_sorted", "_verdict", "verdict", "Kept", "SCORE", "N_words", "_words", "_ratios", "_ngrams", "_doc", "holder",
         "dropped", "N_Lines", "_leaks", "leaks", "_page_host", "page_host", "host", "main_path", "c0", "c1", "we`ird", "dot.ted", "a b"]
LONG = "this line is long enough to be a key of the index, and shared"


def user_table(spark, id_name, columns, rows):
    """Rows with the given columns, one of each clashing name between them and after them."""
    fields = [T.StructField(NAMES[0], T.StringType()), *columns, *[T.StructField(n, T.StringType()) for n in NAMES[1:]]]
    data = [(f"{NAMES[0]}-{r[0]}", *r, *[f"{n}-{r[0]}" for n in NAMES[1:]]) for r in rows]
    return spark.createDataFrame(data, T.StructType(fields))


def unchanged(got, but=(), n=None):
    """Every row holds the user's values under the user's names, in the user's order."""
    names = [c for c in got.columns if c in NAMES]
    assert names == [n for n in NAMES if n.lower() not in but]
    rows = got.collect()
    assert len(rows) == n if n is not None else rows
    for r in rows:
        by = dict(zip(got.columns, r))
        key = by.get("doc_id", by.get("page_id"))
        assert all(by[name] == f"{name}-{key}" for name in names)


@pytest.fixture(scope="module")
def docs(spark):
    columns = [T.StructField("doc_id", T.LongType()), T.StructField("Text", T.StringType())]
    body = lambda k: f"{LONG}\n" + " ".join(f"w{k}-{i}" for i in range(60 + k))
    return user_table(spark, "doc_id", columns, [(k, body(k)) for k in range(8)] + [(8, None), (9, "")])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w3-{i}" for i in range(5, 45)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_quality(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge(docs, labels, text="text")
    unchanged(judged, but=("kept", "score", "n_words"), n=10)
    assert judged.columns[-8:] == list(quality.VERDICT) and {r["kept"] for r in judged.collect()} == {True, False}


def test_line_dedup(spark, docs, folder):
    unchanged(linededup.dedup(docs, linededup.build_index(docs, text="text"), text="text"), but=("n_lines",), n=10)


def test_html(spark):
    pages = user_table(spark, "page_id", [T.StructField(c, T.StringType() if c != "page_id" else T.LongType()) for c in ("page_id", "url", "html")],
                       [(k, f"http://h.example/{k}", f"<article><p>page {k}</p></article>") for k in range(3)] + [(3, None, None)])
    unchanged(templates.extract(pages), n=4)


def test_decontamination(spark, docs, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, benchmark).collect()] == [(3, 1)]
    unchanged(decontam.decontaminated(docs, benchmark), n=9)


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, docs, folder, stage):
    got = corpus_pipeline.STAGES[stage][1](spark, docs.withColumnRenamed("Text", "text"), folder)
    assert got.columns == [c if c != "Text" else "text" for c in docs.columns]
    unchanged(got, n=(8, 10, 10, 9)[stage])


def test_stages_of_nothing(spark, docs, folder):
    empty = docs.withColumnRenamed("Text", "text").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
