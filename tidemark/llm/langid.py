"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to ORDER bytes holds how often each byte followed. A byte costs -log2 of its share
in the longest context that has it; every longer context that was seen without it adds the cost of an escape (method C: as
likely as the context has different bytes). The language with the least total code length for the whole text wins. Counts are
frozen after learning. A-Z are lower-cased; a text begins in the context of line feeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import Texts, texts_of
from tidemark.llm.quality import is_held_out

ORDER = 3
SAMPLE_BYTES = 8 << 20  # of text to learn each language from, about; chosen by a hash of the id
SLOTS = 22  # bits of the table that finds a seen four-byte string
SEED = 3
FOLD = np.arange(256, dtype=np.uint32)
FOLD[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER = re.compile(r"[^\W\d_]")


def grams(texts: Texts) -> np.ndarray:
    """For every byte of the slice, itself and the three before it in its text as one number."""
    b = FOLD[texts.data]
    size = np.diff(texts.offsets)
    place = np.arange(len(b)) - np.repeat(texts.offsets[:-1], size)
    out = b.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(b), 10, np.uint32)
        before[k:] = b[:-k] if len(b) > k else before[k:]
        out |= np.where(place >= k, before, np.uint32(10)) << np.uint32(8 * k)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0)
        for name in names.unique().to_pylist():
            for texts in texts_of(batch.column(1).filter(pa.compute.equal(names, name))):
                value, count = np.unique(grams(texts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.astype(np.int64)), pa.array(count)], ["lang", "gram", "c"])


class Trees:
    """Code lengths of every seen string of ORDER + 1 bytes and fewer, a column per language."""

    def __init__(self, languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.languages = languages
        width = len(languages)
        shorter = np.full((256, width), 8.0)  # without any context: each byte alike
        self.strings, self.costs, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):  # strings of order + 1 bytes
            tail = gram & ((1 << (8 * (order + 1))) - 1)
            strings, at = np.unique(tail, return_inverse=True)
            c = np.zeros((len(strings), width))
            np.add.at(c, (at, language), count)
            contexts, of = np.unique(strings >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, c)
            np.add.at(kinds, of, (c > 0).astype(float))
            seen = total > 0
            escape = np.where(seen, np.log2(np.where(seen, total + kinds, 1) / np.where(seen, kinds, 1)), 0.0)
            if order:
                back = shorter[np.searchsorted(self.strings[-1], strings & ((1 << (8 * order)) - 1))]
            else:
                back = shorter[strings]
            cost = np.where(c > 0, np.log2(np.where(c > 0, (total + kinds)[of], 1) / np.where(c > 0, c, 1)), escape[of] + back)
            shorter = cost
            self.strings.append(strings), self.costs.append(cost.astype(np.float32))
            self.contexts.append(contexts), self.escapes.append(escape.astype(np.float32))
        top = self.strings[-1]
        slot = self._slot(top.astype(np.uint32))
        self.table = np.full(1 << SLOTS, -1, np.int32)
        self.table[slot] = np.arange(len(top))
        self.shared = np.bincount(slot, minlength=1 << SLOTS) > 1

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)

    def _find(self, gram: np.ndarray) -> np.ndarray:
        """Row of each string of full length, -1 if no language has seen it."""
        top = self.strings[-1]
        if not len(top):
            return np.full(len(gram), -1)
        slot = self._slot(gram)
        row = self.table[slot].astype(np.int64)
        row[top[row] != gram] = -1
        unsure = np.flatnonzero((row < 0) & self.shared[slot])
        if len(unsure):
            at = np.minimum(np.searchsorted(top, gram[unsure]), len(top) - 1)
            row[unsure] = np.where(top[at] == gram[unsure], at, -1)
        return row

    def _cost(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Costs of strings of order + 1 bytes that the order above has not seen."""
        strings, contexts = self.strings[order], self.contexts[order]
        at = np.minimum(np.searchsorted(strings, gram), len(strings) - 1)
        seen = strings[at] == gram
        out = np.empty((len(gram), len(self.languages)), np.float32)
        out[seen] = self.costs[order][at[seen]]
        rest = gram[~seen]
        if len(rest):
            c = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
            escape = np.where((contexts[c] == rest >> 8)[:, None], self.escapes[order][c], np.float32(0))
            out[~seen] = escape + (self._cost(rest & ((1 << (8 * order)) - 1), order - 1) if order else np.float32(8))
        return out

    def lengths(self, texts: Texts) -> np.ndarray:
        """Code length in bits of every text in every language."""
        n = texts.hi - texts.lo
        gram = grams(texts)
        row = self._find(gram)
        of = np.repeat(np.arange(n), np.diff(texts.offsets))
        out = np.zeros((n, len(self.languages)))
        missed = np.flatnonzero(row < 0)
        unseen = self._cost(gram[missed].astype(np.int64), ORDER) if len(missed) else None
        row[missed] = 0
        for j in range(len(self.languages)):
            cost = self.costs[-1][row, j]
            if unseen is not None:
                cost[missed] = unseen[:, j]
            out[:, j] = np.bincount(of, weights=cost, minlength=n)
        return out


def learn(docs: DataFrame) -> Trees | None:
    """Trees from `id, text, lang` rows without nulls in text and lang; None without any. The sample bounds what reaches the driver."""
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(float(SAMPLE_BYTES)) / F.greatest("bytes", F.lit(1))
    taken = docs.join(F.broadcast(sizes), "lang").where(draw < share).select("lang", "text")
    rows = taken.mapInArrow(_counts, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).toArrow()
    if not rows.num_rows:
        return None
    languages = sorted(rows["lang"].unique().to_pylist())
    code = np.array(pa.compute.index_in(rows["lang"], pa.array(languages)).to_pylist(), np.int64)
    return Trees(languages, code, rows["gram"].to_numpy(), rows["c"].to_numpy())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`id, held_out, lang_pred, score` per row; score is the share of the winner's probability among all languages.

    Learns from rows with text and lang whose id is not held out (crc32 of the id as text, mod 4, is 2), from about SAMPLE_BYTES of
    each language. Texts that are null or have no letter, and all texts if no language was learned, are `und` with score 0. Equal
    code lengths go to the language first by name. Rows are independent; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    trees = learn(source.where(~is_held_out("id") & F.col("text").isNotNull() & F.col("lang").isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                n = texts.hi - texts.lo
                of = np.repeat(np.arange(n), np.diff(texts.offsets))
                lettered = np.bincount(of[LETTER[texts.data]], minlength=n) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = _LETTER.search(texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode()) is not None
                names, score = np.full(n, "und", object), np.zeros(n)
                if trees is not None:
                    bits = trees.lengths(texts)
                    best = bits.argmin(1)
                    names = np.where(lettered, np.array(trees.languages, object)[best], "und")
                    odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    score = np.where(lettered, 1 / odds, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.lo, n), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = source.select("id", "text").mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return told.select(F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "lang_pred", "score")
