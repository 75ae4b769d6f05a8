"""The pipeline's stages, one after another, against what each has to drop or change."""

from pyspark.sql import functions as F

import corpus_pipeline
from sluicelog.llm import decontamination, secrets

from ..conftest import TABLES


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, TABLES), name)
        sizes.append(docs.count())
        if name != "encode":
            assert docs.columns == before.columns
    assert sizes[1] > 0.95 * sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4] == sizes[3]


def test_decisions_on_odd_rows(spark):
    clean = " ".join(f"clean{i}" for i in range(40))
    secret = 'token = "0123456789abcdef0123456789abcdef" ' + " ".join(f"more{i}" for i in range(40))
    rows = [(1, clean, "en", "s", 9), (2, clean + " x", "en", "s", 9), (3, "12345", "en", "s", 5), (4, None, None, None, None), (5, secret, "en", "s", 9), (None, "these words have no id", "en", "s", 9), (1, clean, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, TABLES), "odd")
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 5, None} and docs.count() == 3
    assert "[SECRET]" in got[5].text and got[5].n_chars == len(got[5].text) and got[1].n_chars == 9


def test_empty_input(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, TABLES), "empty")
    assert docs.count() == 0


def test_no_window_and_no_base_span_is_left(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = corpus_pipeline.decontaminate(spark, rows, TABLES)
    hits = decontamination.hits(kept, spark.read.parquet(f"{TABLES}/benchmark.parquet"))
    assert hits.where("contaminated").count() == 0
    safe = corpus_pipeline.remove_secrets(spark, rows, TABLES).select(secrets.scanned(F.col("text")).alias("s"))
    assert safe.where("s.spans <> ''").count() == 0


def test_texts_that_share_an_id_stay(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (5, text("b")), (2, text("b") + " x"), (9, text("a") + " y"), (7, text("c")), (7, None), (None, text("d"))]
    docs = spark.createDataFrame([(*r, "en", "s", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, TABLES)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(5, text("a")), (2, text("b") + " x"), (7, text("c")), (7, None), (None, text("d"))} and got.count() == 5
