"""Rows that share an id, or have none, and texts too short for a shingle."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemark.llm import ngramjoin, quality

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("text", ["a", "a b", "a b c", ""])
def test_a_lone_short_document(spark, k, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in ngramjoin.ngram_components(docs, k).collect()] == [(1, 1 if text else 0, 1)]


def test_one_of_a_group_stays_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "other")
    rows = [(1, long), (1, "quite another text under the same id"), (2, near), (None, near + " x"), (None, "a text of its own without any id"), (3, long), (3, long), (4, ""), (4, ""), (None, None)]
    rows += [(None, "one text two times no id"), (None, "one text two times no id"), (5, "said twice under one id here"), (5, "said twice under one id here")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], KINDS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngramjoin.keep_one(docs, 4, 80).collect()), key=str)
    want = [(1, long), (1, "quite another text under the same id"), (None, "a text of its own without any id"), (4, ""), (4, ""), (None, None), (None, "one text two times no id"), (5, "said twice under one id here")]
    assert got == sorted(want, key=str)


def test_quality_stage_judges_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"), text_hash=True).collect()
    bad, good = (next(r.doc_id for r in scored if r.predicted == p) for p in (0, 1))
    text = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(bad, good)).collect()}
    more = spark.createDataFrame([(None, text[bad], None, "s", 0), (None, text[good], None, "s", 0), (good, text[bad], None, "s", 0)], KINDS)
    left = pipeline.quality_stage(spark, docs.select(*pipeline.COLUMNS).unionByName(more), SF)
    assert [r.text for r in left.where("doc_id is null").collect()] == [text[good]]
    assert [r.text for r in left.where(F.col("doc_id") == good).collect()] == [text[good]]


def test_mixing_pairs_rows_without_an_id_one_to_one(spark):
    docs = spark.createDataFrame([(None, f"a b c {i}", None, "s", 0) for i in range(50)] + [(1, "a b", None, None, 0)], KINDS)
    got = pipeline.mixing_stage(spark, docs, SF)
    assert max(r["count"] for r in got.groupBy("doc_id", "text").count().collect()) <= 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
