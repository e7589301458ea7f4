"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are phrases of four words, the longest that count; their ends are nodes of three words that overlap in two. A slice of
texts adds up its own graph first: a path whose inner nodes have one way in, one way out and no piece that begins or ends there
carries one weight, so it is compacted and leaves the task as one row. Only edges are counted over all texts. A node's count is
the flow out of it plus the pieces that end in it; the counts of two words and of one follow from the nodes in the same way.

Before that, pieces are cut between two words that follow each other less than `least` times in all: no phrase that counts
stands across such a place, nor does one of its parts. The cut only spares rows; a full bit table cuts less and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bits import bit_table, may_have
from tidemark.llm.bytetext import BYTE_VALUE, LOWER_VALUE, Texts, mix, owner, span_hash, texts_of
from tidemark.session import settle

LONGEST = 4
TABLE_WORDS = 1 << 20  # 64-bit words at most of the bit table of pairs: 8 MB, right for some ten million pairs

BREAK = np.zeros(256, bool)  # `[.,;:!?\x0A-\x0D]`
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: Texts, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, hash (under its language) and text of every word, and whether the next word stands in the same piece."""
    starts, ends, firsts = texts.spans(GAP)
    of = owner(firsts)
    word = mix(span_hash(LOWER_VALUE[texts.data], starts, ends) * _STEP + langs[of])
    breaks = np.concatenate([[0], np.cumsum(BREAK[texts.data])])
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (of[1:] == of[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return starts, ends, word, of, follows


def _chain(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row, wherever they stand."""
    h = word[: max(len(word) - k + 1, 0)]
    for j in range(1, k):
        h = mix(h * _STEP + word[j : len(word) - k + 1 + j])
    return h


def _lang_hash(langs: pa.Array) -> np.ndarray:
    """Hash of each row's language, which sets equal words of two languages apart."""
    names = langs.dictionary_encode()
    flat = list(texts_of(names.dictionary, 1 << 62))
    hashes = span_hash(BYTE_VALUE[flat[0].data], flat[0].offsets[:-1], flat[0].offsets[1:]) if flat else np.zeros(0, np.uint64)
    return hashes[names.indices.to_numpy()]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and count of neighbouring words, added up per slice."""
    for batch in batches:
        langs = _lang_hash(batch.column(0))
        for texts in texts_of(batch.column(1)):
            _, _, word, _, follows = _words(texts, langs[texts.lo : texts.hi])
            pair, c = np.unique(_chain(word, 2)[follows[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(c)], ["pair", "c"])


def _phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Words lo to hi - 1 in lower case, joined by a space, for every lo and hi."""
    some = hi - lo
    upto = np.concatenate([[0], np.cumsum(some)])
    at = np.arange(upto[-1]) + np.repeat(lo - upto[:-1], some)
    size = ends[at] - starts[at] + 1
    size[upto[1:] - 1] -= 1  # each word with a space behind it, but for the last of a phrase
    cut = np.concatenate([[0], np.cumsum(size)])
    flat = LOWER[data[np.minimum(np.arange(cut[-1]) + np.repeat(starts[at] - cut[:-1], size), len(data) - 1)]]
    space = np.ones(len(at), bool)
    space[upto[1:] - 1] = False
    flat[cut[1:][space] - 1] = 0x20
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(cut[upto]), pa.py_buffer(flat)).cast(pa.string())


def graph_of(word: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact paths, and ends of pieces, of one slice: first and last + 1 word and weight of each.

    `joined` says whether the next word goes on in the same piece. An edge stands for all its occurrences by its first one; behind
    an inner node of a path the first occurrence of the next edge is one word on, so a path is read off the text.
    """
    n = len(word)
    last = np.flatnonzero(~joined)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - first + 1
    tail = np.minimum(size, LONGEST - 1)
    key = np.zeros(len(last), np.uint64)
    for j in range(LONGEST - 1):
        key = np.where(j < tail, mix(key * _STEP + word[np.maximum(last - j, 0)] + np.uint64(j)), key)
    _, at, ends_weight = np.unique(key, return_index=True, return_counts=True)
    end_lo, end_hi = last[at] + 1 - tail[at], last[at] + 1

    left = np.repeat(last, size) - np.arange(n)  # words that follow in the piece
    where = np.flatnonzero(left >= LONGEST - 1)
    edge, begin, weight = np.unique(_chain(word, LONGEST)[where], return_index=True, return_counts=True)
    begin = where[begin]
    by_place = np.argsort(begin)
    begin, weight = begin[by_place], weight[by_place]
    node = _chain(word, LONGEST - 1)
    held = np.flatnonzero(size >= LONGEST - 1)
    names, ids = np.unique(np.concatenate([node[begin], node[begin + 1], node[first[held]], node[last[held] - LONGEST + 2]]), return_inverse=True)
    out, into, opens, closes = np.split(ids, np.cumsum([len(begin), len(begin), len(held)]))
    count = lambda x: np.bincount(x, minlength=len(names))
    unary = (count(out) == 1) & (count(into) == 1) & (count(opens) == 0) & (count(closes) == 0)
    goes_on = np.zeros(len(begin), bool)
    goes_on[1:] = unary[out[1:]] & (begin[1:] == begin[:-1] + 1) & (into[:-1] == out[1:])
    head = np.flatnonzero(~goes_on)
    tail_edge = np.append(head[1:], len(begin)) - 1 if len(head) else head
    return begin[head], begin[tail_edge] + LONGEST, weight[head], end_lo, end_hi, ends_weight


def _graph(table: np.ndarray):
    """Rows (lang, ends, words, c) of every slice: compact paths, and under `ends` the last words of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _lang_hash(batch.column(0))
            for texts in texts_of(batch.column(1)):
                starts, ends, word, of, follows = _words(texts, langs[texts.lo : texts.hi])
                if not len(word):
                    continue
                follows[:-1] &= may_have(table, _chain(word, 2))
                a, b, c, x, y, z = graph_of(word, follows)
                lo, hi = np.concatenate([a, x]), np.concatenate([b, y])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of[lo] + texts.lo)), pa.array(np.arange(len(lo)) >= len(a)),
                        _phrases(texts.data, starts, ends, lo, hi), pa.array(np.concatenate([c, z])),
                    ],
                    ["lang", "ends", "words", "c"],
                )

    return run


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def phrase_counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts `lang, size, phrase, f` of phrases of one to four words with f >= least, and `lang, n`, all words of a language."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    often = settle(rows.mapInArrow(_pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("pair"))
    words = 1 << max(10, min(TABLE_WORDS.bit_length() - 1, (often.count() // 4).bit_length()))
    graph = settle(rows.mapInArrow(_graph(bit_table(often, words)), "lang string, ends boolean, words string, c long"))

    said = F.split("words", " ")
    places = F.sequence(F.lit(1), F.size(said) - (LONGEST - 1))
    edges = graph.where("not ends").select("lang", F.explode(F.transform(places, lambda i: F.array_join(F.slice(said, i, LONGEST), " "))).alias("phrase"), "c")
    level = settle(edges.groupBy("lang", "phrase").agg(F.sum("c").alias("f")))
    levels, ends = [level.where(F.col("f") >= least).select("lang", F.lit(LONGEST).alias("size"), "phrase", "f")], graph.where("ends")
    for size in range(LONGEST - 1, 0, -1):
        closing = ends.where(F.size(said) >= size).select("lang", F.substring_index("words", " ", -size).alias("phrase"), F.col("c").alias("f"))
        flow = level.select("lang", F.substring_index("phrase", " ", size).alias("phrase"), "f").unionByName(closing)
        level = settle(flow.groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
        levels.append(level.where(F.col("f") >= least).select("lang", F.lit(size).alias("size"), "phrase", "f"))
    counts = levels[0]
    for more in levels[1:]:
        counts = counts.unionByName(more)
    return counts, level.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, k: int = 2000, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: each language's first k phrases of two to four words said `least` times or more.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`; a null language is
    `und`. a counts a phrase's occurrences inside pieces, n all words of the language. A phrase cut after its first words has l and
    r occurrences of its two parts and scores floor(2000000 a / (l + r)); its lowest cut counts, the earliest of equal ones. A
    phrase goes if a longer one that is said `least` times holds its words in a row and 100 f(longer) >= 80 a. Order: score and a
    descending, phrase by its UTF-8 bytes.

    Null and empty texts say nothing; repeated rows count each time; a language without such a phrase has no rows, nor has an empty
    table. Other columns are ignored. Slices tell phrases apart by 64-bit hashes; all counts over slices are by the words themselves.
    """
    counts, totals = phrase_counts(docs, least, lang_col, text_col)
    counts = settle(counts)
    longer = counts.where("size > 2").withColumn("ws", F.split("phrase", " "))
    parts = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("ws", i, m), " ")))
    )
    held = longer.select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("f").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = counts.where("size > 1").join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (_exact("held") * 100 < _exact("f") * 80))
    cuts = kept.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("exact_a", _exact("a") * 2000000).withColumn("exact_parts", _exact("l") + _exact("r")).withColumn("score", F.expr("exact_a div exact_parts"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = lowest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
