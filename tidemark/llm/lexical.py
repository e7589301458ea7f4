"""Ranked lexical search turned round: the items are the index, and the documents stream past it.

The terms of a block of items make an inverted index (term, items that say it and how often), which is broadcast: a block is
bounded in bytes and items, so the index is too. Each document's counts of those terms are looked up in it, its integer scores
are summed per item, and a task keeps every item's k best documents only. The tasks' short lists are merged in two rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytetext import LOWER_VALUE, Texts, owner, span_hash, texts_of

BLOCK_BYTES = 1 << 20  # item text of one index; a longer item is a block by itself
BLOCK_ITEMS = 4096
CELLS = 1 << 21  # scores, or postings, worked on at a time
MERGERS = 16  # lists of one item merged first, side by side

GAP = np.ones(256, bool)  # `[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`: ASCII but for digits and letters
GAP[0x80:] = False
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    GAP[ord(_low) : ord(_high) + 1] = False


def _terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every term, its text, and the number of terms of each text."""
    starts, ends, firsts = texts.spans(GAP)
    return span_hash(LOWER_VALUE[texts.data], starts, ends), owner(firsts), np.diff(firsts)


class Index:
    """Sorted term hashes; per term its items and how often each says it."""

    def __init__(self, texts: list[str | None]):
        hashes, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in texts_of(pa.array(texts, pa.large_string())):
            h, of, _ = _terms(part)
            hashes.append(h)
            items.append(of + part.lo)
        self.items = len(texts)
        self.vocabulary, term = np.unique(np.concatenate(hashes), return_inverse=True)
        pair, self.times = np.unique(term.astype(np.int64) * max(self.items, 1) + np.concatenate(items), return_counts=True)
        self.item = pair % max(self.items, 1)
        self.first = np.searchsorted(pair, np.arange(len(self.vocabulary) + 1) * max(self.items, 1))

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of every indexed term in every text, by document; and the terms of each text."""
        h, of, n = _terms(texts)
        v = len(self.vocabulary)
        if not v or not len(h):
            none = np.zeros(0, np.int64)
            return none, none, none, n
        at = np.minimum(np.searchsorted(self.vocabulary, h), v - 1)
        known = self.vocabulary[at] == h
        pair, tf = np.unique(of[known] * v + at[known], return_counts=True)
        return pair // v, pair % v, tf, n


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of `items` (id, text) in bounded blocks; the driver holds one block and the partition that it comes from."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len((row[1] or "").encode())
        if block and (held + size > BLOCK_BYTES or len(block) == BLOCK_ITEMS):
            yield block
            block, held = [], 0
        block.append(row)
        held += size
    if block:
        yield block


def _count(shared):
    """Rows (term, docs, said): documents that hold each indexed term; under term -1, documents with a term and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        df = np.zeros(len(index.vocabulary), np.int64)
        some = said = 0
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                _, term, _, n = index.hits(texts)
                df += np.bincount(term, minlength=len(df))
                some, said = some + int((n > 0).sum()), said + int(n.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(df[used], some)), pa.array(np.append(np.zeros(len(used), np.int64), said))], ["term", "docs", "said"]
        )

    return run


def _lengths(n: np.ndarray, documents: int, said: int) -> np.ndarray:
    """m of documents of n terms: exact also where 25 n N passes 64 bits."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // said for x in n], np.int64)
    return 75 + 25 * documents * n // max(said, 1)


def _best(held: pa.Table, k: int) -> pa.Table:
    """The k rows of each item that stand first by score descending, id ascending, nulls last."""
    held = held.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
    item = held["item"].to_numpy()
    return held.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def _score(shared, weights: np.ndarray, documents: int, said: int, k: int):
    """Rows (item, score, id): the k best documents of every item in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        least = np.ones(index.items, np.int64)  # what a document must score to enter an item's list
        held = None
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                doc, term, tf, n = index.hits(texts)
                m = _lengths(n, documents, said)
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                width = index.first[term + 1] - index.first[term]
                upto = np.concatenate([[0], np.cumsum(width)])
                begin = np.searchsorted(doc, np.arange(len(n) + 1))
                lo = 0
                while lo < len(n):
                    hi = min(len(n), lo + max(1, CELLS // max(index.items, 1)))
                    hi = max(lo + 1, min(hi, int(np.searchsorted(upto[begin], upto[begin[lo]] + CELLS, "right")) - 1))
                    a, b = begin[lo], begin[hi]
                    wide = width[a:b]
                    post = np.arange(upto[b] - upto[a]) + np.repeat(index.first[term[a:b]] - (upto[a:b] - upto[a]), wide)
                    scores = np.zeros((hi - lo) * index.items, np.int64)
                    np.add.at(scores, np.repeat((doc[a:b] - lo) * index.items, wide) + index.item[post], np.repeat(part[a:b], wide) * index.times[post])
                    at = np.flatnonzero(scores.reshape(hi - lo, -1) >= least)
                    if len(at):
                        ids = batch.column(0).take(pa.array(texts.lo + lo + at // index.items))
                        new = pa.table([pa.array(at % index.items), pa.array(scores[at]), ids], ["item", "score", "id"])
                        held = _best(new if held is None else pa.concat_tables([held, new]), k)
                        item, score = held["item"].to_numpy(), held["score"].to_numpy()
                        full = np.flatnonzero(np.bincount(item, minlength=index.items) == k)
                        least[full] = score[np.searchsorted(item, full, "right") - 1]
                    lo = hi
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def _merged(lists: DataFrame, k: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k best documents of every item with a score above 0; fewer, if there are fewer.

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. With N documents of at least one term,
    L terms in them, and df documents holding a term, its weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))). A document of n
    terms has m = 75 + 25 n N div L, and scores the sum of w * (10^9 tf div (1000 tf + 12 m)) over an item's terms, repeats
    included. Equal scores rank by id, nulls last.

    Null and empty texts have no terms: such documents and items have no rows. Repeated rows, and rows without an id, are documents
    and items of their own. Other columns are ignored. Empty tables give no rows. Each block of items costs two passes over the
    documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    type_of = {c: f[c].dataType.simpleString() for c, f in ((id_col, docs.schema), (item_col, items.schema))}
    out = None
    for block in _blocks(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))):
        shared = spark.sparkContext.broadcast(Index([r[1] for r in block]))
        counted = rows.select("text").mapInArrow(_count(shared), "term long, docs long, said long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("said").alias("said")).toArrow()
        term, docs_of = counted["term"].to_numpy(), counted["docs"].to_numpy()
        documents, said = int(docs_of[term < 0].sum()), int(counted["said"].to_numpy().sum())
        weights = np.zeros(len(shared.value.vocabulary), np.int64)
        for t, df in zip(term, docs_of):
            if t >= 0:
                weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1)))
        lists = rows.mapInArrow(_score(shared, weights, documents, said, k), f"item long, score long, id {type_of[id_col]}")
        # A list has k rows per item and task; few tasks meet in the first round, few rows in the second.
        lists = _merged(lists.withColumn("part", F.spark_partition_id() % MERGERS), k, "item", "part").drop("rank", "part")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"item long, item_id {type_of[item_col]}")
        ranked = _merged(lists, k, "item").join(F.broadcast(names), "item")
        ranked = ranked.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` {type_of[item_col]}, rank int, `{id_col}` {type_of[id_col]}, score long")
    return out
