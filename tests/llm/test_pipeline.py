"""The pipeline against its stages done by hand on its own tables."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_llm import SF, components_by_pairs, lines_by_pairs, table

from tidemark.llm import mixing, pieces, quality


def test_stages_one_by_one(spark, tmp_path):
    docs = table(spark, "documents")
    kinds = docs.dtypes
    outs = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append(docs)
        if i < len(pipeline.STAGES) - 1:
            assert docs.dtypes == kinds
    first, lines, unique, mixed, encoded = ({r.doc_id: r for r in o.collect()} for o in outs)

    scores = {r.doc_id: r.predicted for r in quality.quality_scores(table(spark, "documents"), table(spark, "labels")).collect()}
    assert set(first) == {i for i, p in scores.items() if p}
    order = sorted(first)
    gone = set(lines_by_pairs([first[i].text for i in order]))
    texts = {d: "\n".join(x for p, x in enumerate(first[d].text.split("\n")) if (i, p) not in gone) for i, d in enumerate(order)}
    assert {i: r.text for i, r in lines.items()} == {i: t for i, t in texts.items() if t.split() or t == first[i].text}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    order = sorted(lines)
    assert set(unique) == {order[i] for i, n, c in components_by_pairs([lines[i].text for i in order], 5, 80) if i == c or not n}
    copies = {r.id: r.copies for r in mixing.mix(outs[2]).collect()}
    counted = {r.doc_id: r["count"] for r in outs[3].groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n}
    assert all(mixed[i].text == unique[i].text for i in mixed)
    assert outs[4].count() == outs[3].count() and set(encoded) == set(mixed)
    assert {r.doc_id: r.decoded for r in pieces.decode(outs[4]).collect()} == {i: r.text.replace("▁", " ") for i, r in mixed.items()}


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", None, 0), (3, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1))
    for data in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, data, SF).count() >= 0


def test_run_ends_as_the_last_stage(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_tokens", "tokens"] and got.count() > 0
