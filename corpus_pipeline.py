"""From documents to token sequences: quality, line dedup, near-duplicate documents, mixing, encoding.

Each stage reads all rows its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import linededup, mixing, ngramjoin, pieces, quality
from tidemark.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more. Labels of held-out ids are not learned from.

    A score is its row's text's: of rows that share an id, or have none, only those go whose own text is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = quality.quality_scores(docs, labels, text_hash=True).where("predicted = 0").select(F.col("doc_id").alias("_id"), "text_hash").distinct()
    same = F.xxhash64("text").eqNullSafe(F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return docs.select(*COLUMNS).join(rejected, same, "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier one stands for; documents of which nothing is left go, those empty before stay."""
    left = linededup.dedup_lines(docs.select(*COLUMNS))
    left = left.where("has_text or lines_dropped = 0").withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links at 0.8 of its five-word shingles."""
    return ngramjoin.keep_one(docs, k=5, percent=80).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times as rows of their own."""
    mixed = _numbered(mixing.mix(docs).withColumnRenamed("id", "doc_id"), "copies").where("copies > 0")
    mixed = mixed.select("key", "size", "nth", "copies")
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    both = _numbered(docs.select(*COLUMNS).withColumn("size", size), F.xxhash64("text")).join(mixed, ["key", "size", "nth"])
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _numbered(rows: DataFrame, order: str | Column) -> DataFrame:
    """Rows of one id and size are alike to the mix; their numbers, a key of the join, pair them one to one."""
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "size").orderBy(order)))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the tokens of the text."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"))
    return encoded.select("doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encode_stage),
]

# The classifier, the knapsack and the vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
