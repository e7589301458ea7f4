"""Line dedup by deletion neighbourhoods: lines equal in words, or one word apart, keep their earliest.

A line and each of its one-word deletions are hashed keys. Lines that delete to the same words at the same place differ by a
substitution; a line that equals another's deletion differs by an insertion. So the smallest place of a key answers for all
lines under it: a partial aggregate, and no list of pairs, however many lines meet. What it finds is verified by edit distance.

An edit leaves the first or the second half of a line as it was, so only lines that share a half with another line emit
deletions, and only deletions that several lines have are kept: bit tables of shared keys spare the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bits import bit_table, may_have
from tidemark.llm.bytetext import BYTE_VALUE, Texts, mix, span_hash, span_hash_without, texts_of
from tidemark.session import settle

MIN_WORDS = 2  # shorter lines (marks, braces, one-word headings) are never dropped, but for
LONG_BYTES = 32  # lines of one word from here on: addresses, encoded data, sentences of scripts without spaces
BIT_WORDS = 1 << 20  # 64-bit words of a bit table: 8 MB
NEAR_WORDS = 10  # from here on one word of difference still counts as the same line
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(texts: Texts):
    """Lines' first words and word counts, words' hashes, lines' texts and places in them."""
    starts, ends, per_text = texts.lines()
    first, last, _ = texts.words()
    line = np.searchsorted(starts, first, "right") - 1
    count = np.bincount(line, minlength=len(starts))
    of = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
    place = np.arange(len(starts)) - per_text[:-1][of]
    return np.cumsum(count) - count, count, span_hash(BYTE_VALUE[texts.data], first, last), of, place, (first, last)


def _compared(first: np.ndarray, count: np.ndarray, span: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a line is held against others at all."""
    begin, end = span
    use = count >= MIN_WORDS
    one = np.flatnonzero(count == 1)
    use[one] |= end[first[one]] - begin[first[one]] >= LONG_BYTES
    return use


def _line_hash(word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return span_hash(mix(word + np.uint64(7)), lo, hi)


def _halves(word: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Four keys a line: first and last half as the longer or equally long line, and as the one a word shorter."""
    keys = []
    for longer in (count, count + 1):
        head = longer // 2
        for tag, lo, hi in ((1, first, first + head), (2, first + head - (longer - count), first + count)):
            keys.append(mix(_line_hash(word, lo, np.maximum(lo, hi)) + longer.astype(np.uint64) * np.uint64(4) + np.uint64(tag)))
    return np.stack(keys, 1) if len(first) else np.zeros((0, 4), np.uint64)


def _whole_key(line: np.ndarray) -> np.ndarray:
    return mix(line + np.uint64(9))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark): every line under a key of its words with a mark of where it stands, and long ones under their halves with a
    mark of their words. A key with two marks is shared: by repeated lines, or by different lines with one half."""
    for batch in batches:
        names = batch.column(0).cast(pa.string()).fill_null("")
        row = batch.column(2).to_numpy().view(np.uint64) ^ batch.column(0).is_null().to_numpy(False).astype(np.uint64)
        for texts in texts_of(batch.column(1)):
            name = next(texts_of(names.slice(texts.lo, texts.hi - texts.lo), 1 << 62))
            where = mix(span_hash(BYTE_VALUE[name.data], name.offsets[:-1], name.offsets[1:]) + row[texts.lo : texts.hi])
            first, count, word, of, place, span = _words(texts)
            use = _compared(first, count, span)
            first, count = first[use], count[use]
            line = _line_hash(word, first, first + count)
            near = np.flatnonzero(count >= NEAR_WORDS)
            _, one = np.unique(line[near], return_index=True)
            near = near[one]
            keys = np.concatenate([_whole_key(line), _halves(word, first[near], count[near]).ravel()])
            marks = np.concatenate([mix(where[of[use]] + place[use].astype(np.uint64)), np.repeat(line[near], 4)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(marks.view(np.int64))], ["key", "mark"])


def _neighbourhoods(shared: np.ndarray, met: np.ndarray | None = None):
    """For lines with a shared half: (words left, line) of all deletions. With `met`, the deletions and lines that matter:
    kind 0, (words left, place deleted or -1 for the line itself, id, row, place, line) of what is left in several lines;
    kind 1, (id, row, place, line) of lines that are repeated or have such a deletion, with the words of the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                start, length, word, of, place, (begin, end) = _words(texts)
                long = np.flatnonzero(length >= NEAR_WORDS)
                if len(long):
                    long = long[may_have(shared, _halves(word, start[long], length[long]).ravel()).reshape(-1, 4).any(1)]
                first, count = start[long], length[long]
                line = _line_hash(word, first, first + count)
                # A line has a row for each word it may lose, and one in which it loses none.
                rows = np.repeat(np.arange(len(long)), count + 1)
                lose = np.arange(len(rows)) - np.repeat(np.cumsum(count + 1) - (count + 1), count + 1)
                left = span_hash_without(mix(word + np.uint64(7)), first[rows], (first + count)[rows], first[rows] + lose)
                if met is None:
                    yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(line[rows].view(np.int64))], ["left", "line"])
                    continue
                keep = may_have(met, left)
                left, gone, rows = left[keep], np.where(lose == count[rows], -1, lose)[keep], rows[keep]
                whole = _line_hash(word, start, start + length)
                close = np.zeros(len(start), bool)
                close[long[rows]] = True
                seen = np.flatnonzero(_compared(start, length, (begin, end)) & (close | may_have(shared, _whole_key(whole))))
                data = texts.data.tobytes()
                words = [data[begin[start[i]] : end[start[i] + length[i] - 1]] if close[i] else None for i in seen]
                for kind, at, l, g, w in ((0, long[rows], left.view(np.int64), gone, None), (1, seen, None, None, words)):
                    docs = pa.array(of[at] + texts.lo)
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), kind, np.int32)), none if l is None else pa.array(l), none if g is None else pa.array(g),
                            batch.column(0).take(docs), batch.column(2).take(docs), pa.array(place[at]), pa.array(whole[at].view(np.int64)), pa.nulls(len(at), pa.binary()) if w is None else pa.array(w, pa.binary()),
                        ],
                        ["kind", "left", "gone", "id", "row", "place", "line", "words"],
                    )

    return run


def _within_one(a: list, b: list) -> bool:
    """Whether the word edit distance is one at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    rest_a, rest_b = a[same:], b[same:]
    return rest_a == rest_b or rest_a[1:] == rest_b[1:] or rest_a[1:] == rest_b or rest_a == rest_b[1:]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([_within_one(x.split(), y.split()) for x, y in zip(a, b, strict=True)], pa.bool_()))], ["line"])


def _repeats(words: list) -> bool:
    """As _compared, from the words of one line."""
    return len(words) >= MIN_WORDS or (len(words) == 1 and len(words[0].encode()) >= LONG_BYTES)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts less the places of dropped lines; the last columns are the text, those places, and whether all its lines stand in
    an earlier row of the same text."""
    for batch in batches:
        texts, kept, lines, dropped = [], [], [], []
        for text, out, copy in zip(*(batch.column(c).to_pylist() for c in ("_text", "_out", "_copy")), strict=True):
            parts = [] if text is None else text.split("\n")
            out = {i for i, x in enumerate(parts) if _repeats(WORD.findall(x))} if copy else set(out or ())
            left = [x for i, x in enumerate(parts) if i not in out]
            texts.append("\n".join(left) if out else text)
            lines.append(len(parts))
            dropped.append(len(parts) - len(left))
            kept.append(any(x.strip(" \t\r\x0b\x0c") for x in left))
        rest = batch.select(range(batch.num_columns - 3))
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.bool_())],
            [*rest.schema.names, "_text", "_lines", "_dropped", "_left"],
        )


def _first() -> Column:
    """Where a line stands: ids in order, null last, texts of one id by their hash, then the place in the text."""
    return F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "place")


def _document(name: str, row: str | Column) -> Column:
    """What tells documents apart, as one value that equals itself when the id is null."""
    return F.struct(F.col(name).isNull().alias("nameless"), F.col(name).alias("id"), (F.col(row) if isinstance(row, str) else row).alias("row"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """`id, row, place` of every line that an earlier one stands for; docs has `id, text, row`. Lines of one id and row are told
    apart by their places alone."""
    def shared_of(rows: DataFrame, key: str, mark: str) -> np.ndarray:
        return bit_table(rows.groupBy(key).agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select(key), BIT_WORDS)

    kind = docs.schema["id"].dataType.simpleString()
    shared = shared_of(docs.mapInArrow(_keys, "key long, mark long"), "key", "mark")
    met = shared_of(docs.mapInArrow(_neighbourhoods(shared), "left long, line long"), "left", "line")
    both = settle(docs.mapInArrow(_neighbourhoods(shared, met), f"kind int, left long, gone long, id {kind}, row long, place long, line long, words binary"))
    lines = both.where("kind = 1").select("id", "row", "place", "line", "words")
    firsts = lines.groupBy("line").agg(F.min(_first()).alias("first"), F.count("*").alias("rows"))

    rows = both.where("kind = 0").groupBy("left", "gone", "line").agg(F.min(_first()).alias("first"))
    by_place = rows.where("gone >= 0").groupBy("left", "gone").agg(F.min(F.struct("first", "line")).alias("swapped"))
    by_words = rows.groupBy("left").agg(
        F.min(F.when(F.col("gone") < 0, F.struct("first", "line"))).alias("whole"),
        F.min(F.when(F.col("gone") >= 0, F.struct("first", "line"))).alias("longer"),
        F.min("line").alias("lo"), F.max("line").alias("hi"),
    ).where("lo <> hi").drop("lo", "hi")
    meet = rows.join(by_words, "left").join(by_place, ["left", "gone"], "left")
    meet = meet.withColumn("other", F.when(F.col("gone") < 0, F.col("longer")).otherwise(F.least("swapped", "whole")))
    pairs = meet.where("other.first < first and other.line <> line").groupBy("line").agg(F.min("other").alias("other"))
    pairs = pairs.select("line", F.col("other.line").alias("other"))

    words = lines.where("words is not null").groupBy("line").agg(F.max("words").alias("words"))
    near = (
        pairs.join(words.withColumnRenamed("words", "a"), "line")
        .join(words.select(F.col("line").alias("other"), F.col("words").alias("b")), "other")
        .select("line", "a", "b").mapInArrow(_near, "line long").withColumn("near", F.lit(True))
    )
    stood_for = firsts.join(near, "line", "left").where("rows > 1 or near")
    return lines.join(stood_for, "line").where((F.col("near").isNotNull()) | (F.col("first") != _first())).select("id", "row", "place")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its repeated lines taken out of the text, and `lines, lines_dropped, has_text` added.

    A line goes if an earlier one (smaller id, null ids last, texts of one id by their hash, then smaller place) has the same
    words, or differs by one word put in, left out or changed while both have NEAR_WORDS words at least. Lines of one
    word of less than LONG_BYTES bytes and blank lines stay. has_text says whether a line with words is left. A null text stays null, with 0 lines. Rows of
    one id and one text are one document, and all keep what it keeps; rows without an id are documents of their own, so of
    those with one text the first alone keeps it. Other columns are kept as they are, whatever their names.
    """
    kept = [c for c in docs.columns if c != text_col]
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = repeated_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")))
    out = out.distinct().groupBy(_document("id", "row").alias("_key")).agg(F.collect_list("place").alias("_out"))
    # Of equal texts without an id the smallest in the other columns is the first; a map has no order and no hash.
    order = [f"c{i}" for i, c in enumerate(kept) if "map<" not in docs.schema[c].dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*order) if order else F.lit(0)))
    named = named.withColumn("_key", _document("_id", F.xxhash64("_text"))).withColumn("_copy", F.col("_id").isNull() & (nth > 1))
    joined = named.join(out, "_key", "left").select(*(f"c{i}" for i in range(len(kept))), "_text", "_out", "_copy")
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    done = joined.mapInArrow(_without, f"{schema}, _text string, _lines long, _dropped long, _left boolean")
    back = {c: F.col(f"c{i}") for i, c in enumerate(kept)} | {text_col: F.col("_text")}
    added = {"lines": "_lines", "lines_dropped": "_dropped", "has_text": "_left"}
    return done.select(*(back[c].alias(c) for c in docs.columns), *(F.col(v).alias(k) for k, v in added.items() if k not in docs.columns))
