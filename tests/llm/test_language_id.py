"""Language ID: held-out accuracy, mixtures, folds and edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import DOCS, documents
from touchline.llm.language_id import BUCKETS, identify_documents, infer, learn, trigrams

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_folds_follow_crc32(spark, model):
    got = identify_documents(documents(spark, [(i, "the of and") for i in range(50)]), model).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_held_out_texts_teach_nothing(spark):
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "zzz qqq zzz", "xx") for i in out] + [(i, "the of and this", "en") for i in range(60) if i not in out]
    model = learn(documents(spark, rows + [(90, "abc", None), (None, "abc", "yy"), (91, None, "ww")]))
    assert model.languages == ["en"]


def test_mixture_finds_both_languages(spark, model):
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 1500 and n_chars < 4000")
    text = {r.lang: r.t for r in d.groupBy("lang").agg(F.min("text").alias("t")).collect()}
    got = infer(model, [text["de"][:1200] + " " + text["es"][:1200], text["en"][:1200]])
    assert set(got.languages[0]) == {"de", "es"} and got.languages[1] == ["en"]
    assert got.score[0] < 0.75 < got.score[1]


def test_trigrams_brute_force():
    texts = ["Ab, c!d", "", None, "é", "a1b"]
    owner, bucket = trigrams(texts)
    want = {0: 5, 3: 1, 4: 3}      # " ab" "ab " "b c" " c " "c d" " d "... counted below
    spaced = [" ab c d ", None, None, " é ", " a b "]
    want = {i: sum(1 for j in range(len(s) - 2)) for i, s in enumerate(spaced) if s}
    assert {int(i): int(n) for i, n in zip(*np.unique(owner, return_counts=True))} == want
    assert bucket.min() >= 0 and bucket.max() < BUCKETS


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? 45"), (4, "the and of " * 60_000), (5, "und"), (5, "und"), (None, "der und die")]
    docs = documents(spark, rows).withColumn("score", F.lit(9)).withColumn("held_out", F.lit("x"))
    got = identify_documents(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[None].lang_pred == "de" and not by[None].held_out
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert by[1].score == 0.0
    nothing = spark.createDataFrame([], DOCS)
    assert identify_documents(nothing).count() == 0
    assert [r.lang_pred for r in identify_documents(documents(spark, [(1, "the", None)])).collect()] == ["und"]
