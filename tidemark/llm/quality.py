"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics are computed once per text and settled; everything after works on that small table. Each partition sums its own
normal equations per fold, so training moves a fixed number of matrix rows whatever the number of labels. Scores for the
calibration come from the model that left the row's fold out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import BYTE_VALUE, Texts, span_hash, texts_of
from tidemark.session import settle

FOURIER = 160  # random features: cos and sin of half as many directions
FOLDS = 4
RIDGE = 0.3
SEED = 11
BINS = 2000  # steps of a raw score that the calibration tells apart

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!", "?", "|", "#$%&*+/<=>@\\^_`{}~", "'\"()[]-")
CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    CLASS[[ord(c) for c in _chars]] = _i
CLASS[0x80:] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2
NAMES = (
    "log_bytes", "log_words", *(f"share_{i}" for i in range(_KINDS)), "word_length", "word_spread", "upper_words", "capital_words",
    "symbol_words", "mark_ends", "repeats", "distinct", "pairs_distinct", "line_words", "log_lines", "line_repeats", "line_stops", "long_words",
)


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[fresh], minlength=n)


def statistics(texts: Texts) -> np.ndarray:
    """One row of NAMES per text; an empty text has only zeros."""
    n = texts.hi - texts.lo
    size = np.diff(texts.offsets)
    kind = CLASS[texts.data]
    shares = np.bincount(np.repeat(np.arange(n), size) * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS) / np.maximum(size, 1)[:, None]
    starts, ends, firsts = texts.words()
    of = np.repeat(np.arange(n), np.diff(firsts))
    words = np.bincount(of, minlength=n)
    many = np.maximum(words, 1)
    length = ends - starts

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=flags, minlength=n) / many

    def inside(k: int) -> np.ndarray:
        total = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        return total[ends] - total[starts]

    upper, lower, symbols, marks = inside(0), inside(1), inside(10), inside(7)
    h = span_hash(BYTE_VALUE[texts.data], starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    pair = h.copy()
    pair[1:] = np.where(of[1:] == of[:-1], h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1], h[1:])
    line_start, line_end, line_first = texts.lines()
    line_of = np.repeat(np.arange(n), np.diff(line_first))
    filled = line_end > line_start
    line_start, line_end, line_of = line_start[filled], line_end[filled], line_of[filled]
    lines = np.bincount(line_of, minlength=n)
    stops = np.isin(texts.data[line_end - 1], np.frombuffer(b".!?", np.uint8)) if len(line_end) else np.zeros(0, bool)
    mean = per_word(length)
    return np.column_stack([
        np.log1p(size), np.log1p(words), shares, mean, np.sqrt(np.maximum(per_word(length.astype(float) ** 2) - mean**2, 0)),
        per_word((upper > 1) & (lower == 0)), per_word((upper > 0) & (lower > 0)), per_word(symbols > 0), per_word(marks > 0), per_word(again),
        _distinct(h, of, n) / many, _distinct(pair, of, n) / many, words / np.maximum(lines, 1), np.log1p(lines),
        1 - _distinct(span_hash(BYTE_VALUE[texts.data], line_start, line_end), line_of, n) / np.maximum(lines, 1),
        np.bincount(line_of, weights=stops, minlength=n) / np.maximum(lines, 1), per_word(length > 20),
    ])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in texts_of(batch.column(1)):
            x = statistics(texts)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.lo, len(x)), lists, batch.column(2).slice(texts.lo, len(x))], ["id", "x", "text_hash"])


class Model:
    """Standardised statistics to Fourier features, ridge weights per left-out fold (the last: none left out), calibration."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.centre, self.scale = centre, np.where(scale > 1e-9, scale, 1.0)
        self.directions = rng.normal(size=(len(centre), FOURIER // 2)) / np.sqrt(2 * len(centre))
        self.weights = np.zeros((FOLDS + 1, FOURIER + 1))
        self.steps, self.values = np.array([0.0]), np.array([1.0])

    def features(self, lists: pa.Array) -> np.ndarray:
        x = lists.flatten().to_numpy().reshape(-1, len(self.centre))
        angle = np.clip((x - self.centre) / self.scale, -6, 6) @ self.directions
        return np.column_stack([np.cos(angle), np.sin(angle)]) * np.sqrt(2 / FOURIER) if len(x) else np.zeros((0, FOURIER))

    def raw(self, lists: pa.Array, fold: np.ndarray | int) -> np.ndarray:
        z = np.column_stack([self.features(lists), np.ones(len(lists))])
        return np.einsum("ij,ij->i", z, np.broadcast_to(self.weights[fold], z.shape))

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated, with a hundredth of the raw score so that level stretches keep their order."""
        return np.clip(0.99 * np.interp(raw, self.steps, self.values) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators over ascending x: mean x and value of each pool."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(table: DataFrame, labels: DataFrame) -> Model | None:
    """A model from `id, x` and `id, y` (y in 0..1). None if there is no labelled row."""
    n = len(NAMES)
    moments = table.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n))).first()
    if moments[0] is None:
        return None
    model = Model(np.array(moments[:n]), np.array(moments[n:]))
    train = settle(table.join(labels, "id").select("x", "y", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(FOLDS)).cast("int").alias("fold")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FOURIER + 2
        total = np.zeros((FOLDS, size, size))
        for batch in batches:
            fold, y = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            z = np.column_stack([model.features(batch.column(0)), np.ones(len(y)), y])
            for f in np.unique(fold):
                total[f] += z[fold == f].T @ z[fold == f]
        flat = pa.ListArray.from_arrays(np.arange(FOLDS * size + 1, dtype=np.int32) * size, pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(FOLDS), size)), pa.array(np.tile(np.arange(size), FOLDS)), flat], ["fold", "i", "row"])

    def added(rows: pa.Table) -> pa.Table:
        row = rows["row"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(0)
        return pa.table({"fold": rows["fold"][:1], "i": rows["i"][:1], "row": pa.array([row], pa.list_(pa.float64()))})

    kind = "fold long, i long, row array<double>"
    equations = np.zeros((FOLDS, FOURIER + 2, FOURIER + 2))
    for fold, i, row in train.mapInArrow(sums, kind).groupBy("fold", "i").applyInArrow(added, kind).collect():  # a fixed number of rows
        equations[fold, i] = row
    whole = equations.sum(0)
    if whole[-2, -2] == 0:
        return None
    for fold in range(FOLDS + 1):
        part = whole - (equations[fold] if fold < FOLDS else 0)
        model.weights[fold] = np.linalg.solve(part[:-1, :-1] + RIDGE * np.diag([*np.ones(FOURIER), 1e-6]), part[:-1, -1])

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(batch.column(0), batch.column(2).to_numpy()), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(raw * BINS / 2).astype(np.int64)), batch.column(1)], ["bin", "y"])

    bins = train.mapInArrow(left_out, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.steps, model.values = isotonic(np.array([b.bin for b in bins]) * 2 / BINS, np.array([b.y for b in bins]), np.array([b.n for b in bins], float))
    return model


def is_held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """`id, held_out, score, predicted` per row, and with `text_hash` its text's xxhash64; labels has `id_col, quality`.

    Labels of held-out ids (crc32 of the id as text, mod 4, is 2) are not read; several labels of one id count as their mean, null
    ones not at all. Null and empty texts are scored as texts without words. With no label to learn from every score is 1.
    Rows with a null id are scored and not held out. Repeated rows are scored each; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    table = settle(source.mapInArrow(_rows, f"id {kind}, x array<double>, text_hash long"))
    known = labels.where(~is_held_out(id_col) & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    model = fit(table, known)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.ones(batch.num_rows) if model is None else model.score(model.raw(batch.column(1), FOLDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), batch.column(2)], ["id", "score", "text_hash"])

    scored = table.mapInArrow(scores, f"id {kind}, score double, text_hash long")
    columns = [F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")]
    return scored.select(*columns, *(["text_hash"] if text_hash else []))
