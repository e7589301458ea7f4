"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph piece is a run of up to PIECE_WORDS words of one line; its key is a 64-bit hash of the words and of how often the
text had the piece before, so a text is a set of keys. A sketch hashes every key to three cells, each with a count and the xors
of keys and of their checks. Two sketches of one size subtract cell by cell; a cell that then holds one key gives it up, which
frees others, until all keys that only one text has are recovered. If peeling stops early the sketches are made anew four times
larger. With d keys recovered and set sizes a and b, the likeness is (a + b - d) / (a + b + d), the Jaccard likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytetext import BYTE_VALUE, mix, span_hash, texts_of

PIECE_WORDS = 4
CELLS = 24  # of the stored fingerprint; a multiple of 3
PART_BYTES = 8 << 20  # of text that an ordered part is meant to hold
ROWS = 1000  # texts of a batch held as Python strings at a time
MOST_PARTS = 100_000  # beyond, parts hold more; they are read as a stream


def piece_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts one after the other, and the first key of each text (one more than texts)."""
    keys, sizes = [], []
    for part in texts_of(texts):
        starts, ends, firsts = part.words()
        line_starts, _, _ = part.lines()
        line = np.searchsorted(line_starts, starts, "right") - 1
        word = mix(span_hash(BYTE_VALUE[part.data], starts, ends))
        n = part.hi - part.lo
        if not len(word):
            sizes.append(np.zeros(n, np.int64))
            continue
        fresh = np.ones(len(line), bool)
        fresh[1:] = line[1:] != line[:-1]
        begin = np.flatnonzero(fresh)
        place = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line))))
        heads = np.flatnonzero(place % PIECE_WORDS == 0)
        piece = span_hash(word, heads, np.append(heads[1:], len(word)))
        of = np.searchsorted(firsts, heads, "right") - 1
        order = np.lexsort((piece, of))
        same = np.zeros(len(piece), bool)
        same[1:] = (piece[order][1:] == piece[order][:-1]) & (of[order][1:] == of[order][:-1])
        run = np.flatnonzero(~same)
        nth = np.arange(len(piece)) - np.repeat(run, np.diff(np.append(run, len(piece))))
        keys.append(mix(piece[order] + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        sizes.append(np.bincount(of, minlength=n))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


def sketches(keys: np.ndarray, of: np.ndarray, sign: np.ndarray | int, n: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n sketches side by side, sketch i with cells[i] cells: counts, key xors, check xors, and the first cell of each.

    Keys with sign -1 are subtracted: of a pair of texts this is at once the difference of their two sketches.
    """
    first = np.concatenate([[0], np.cumsum(cells)])
    count, key_xor, check_xor = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.uint64)
    if len(keys):
        third = (cells // 3)[of]
        check = _check(keys)
        for salt in range(3):
            at = first[of] + salt * third + (mix(keys + np.uint64(salt)) % third.astype(np.uint64)).astype(np.int64)
            np.add.at(count, at, sign)
            np.bitwise_xor.at(key_xor, at, keys)
            np.bitwise_xor.at(check_xor, at, check)
    return count, key_xor, check_xor, first


def peel(count: np.ndarray, key_xor: np.ndarray, check_xor: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recovered keys, the sketch of each, and whether each sketch came out empty. All sketches are peeled together."""
    n, cells = len(first) - 1, np.diff(first)
    of_cell = np.repeat(np.arange(n), cells)
    found, owners = [], []
    look = np.arange(len(count))
    while len(look):
        pure = look[np.abs(count[look]) == 1]
        pure = pure[check_xor[pure] == _check(key_xor[pure])]
        if not len(pure):
            break
        # A key shows in up to three cells at once: take it from one.
        owner, key = of_cell[pure], key_xor[pure]
        order = np.lexsort((key, owner))
        pure, owner, key = pure[order], owner[order], key[order]
        one = np.ones(len(key), bool)
        one[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        pure, owner, key = pure[one], owner[one], key[one]
        sign, third, check, touched = count[pure], (cells // 3)[owner], _check(key), []
        for salt in range(3):
            at = first[owner] + salt * third + (mix(key + np.uint64(salt)) % third.astype(np.uint64)).astype(np.int64)
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(key_xor, at, key)
            np.bitwise_xor.at(check_xor, at, check)
            touched.append(at)
        found.append(key)
        owners.append(owner)
        look = np.unique(np.concatenate(touched))
    open_cells = (count != 0) | (key_xor != 0) | (check_xor != 0)
    failed = np.bincount(of_cell[open_cells], minlength=n) > 0 if n else np.zeros(0, bool)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64), ~failed


def _gather(firsts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys of some texts, in the order of `rows`, and which of `rows` each belongs to."""
    size = firsts[rows + 1] - firsts[rows]
    of = np.repeat(np.arange(len(rows)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(firsts[rows], size), of


def likeness(keys_a: np.ndarray, firsts_a: np.ndarray, keys_b: np.ndarray, firsts_b: np.ndarray) -> np.ndarray:
    """Jaccard likeness of text i of a and text i of b, from what peeling the difference of their sketches recovers."""
    n = len(firsts_a) - 1
    size_a, size_b = np.diff(firsts_a), np.diff(firsts_b)
    differ = np.full(n, -1, np.int64)
    open_rows, cells = np.arange(n), CELLS
    while len(open_rows):
        at_a, of_a = _gather(firsts_a, open_rows)
        at_b, of_b = _gather(firsts_b, open_rows)
        sign = np.concatenate([np.ones(len(at_a), np.int64), np.full(len(at_b), -1, np.int64)])
        parts = sketches(np.concatenate([keys_a[at_a], keys_b[at_b]]), np.concatenate([of_a, of_b]), sign, len(open_rows), np.full(len(open_rows), cells))
        _, owners, done = peel(*parts)
        differ[open_rows[done]] = np.bincount(owners, minlength=len(open_rows))[done]
        open_rows, cells = open_rows[~done], cells * 4
    total = size_a + size_b
    return np.where(total > 0, (total - differ) / np.maximum(total + differ, 1), 1.0)


def fingerprints(keys: np.ndarray, firsts: np.ndarray) -> list[str]:
    """The stored sketch of CELLS cells as hex: per cell the count, the check and the key; equal texts have equal ones."""
    n = len(firsts) - 1
    count, key_xor, check_xor, _ = sketches(keys, np.repeat(np.arange(n), np.diff(firsts)), 1, n, np.full(n, CELLS))
    cell = np.empty(len(count), np.dtype([("count", "<u2"), ("check", "<u2"), ("key", "<u8")]))
    cell["count"], cell["check"], cell["key"] = count, check_xor, key_xor
    raw, width = cell.tobytes(), CELLS * cell.itemsize
    return [raw[i * width : (i + 1) * width].hex() for i in range(n)]


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order: part, guest, id, text. A guest only ends its part: the text after the part's last row."""
    held: tuple | None = None
    for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
        pairs: list[tuple] = []
        for part, guest, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0] == part:
                pairs.append((held[1], held[2], text or ""))
            held = None if guest else (part, id_, text or "")
        yield from _printed(pairs, batch.schema.field("id").type)


def _printed(pairs: list[tuple], kind: pa.DataType, rows: int = 512, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    cuts, many = [0], 0
    for i, (_, text, following) in enumerate(pairs):
        if many and (many + len(text) + len(following) > characters or i - cuts[-1] >= rows):
            cuts.append(i)
            many = 0
        many += len(text) + len(following)
    for lo, hi in pairwise([*cuts, len(pairs)]):
        if lo == hi:
            continue
        ids, texts, following = zip(*pairs[lo:hi], strict=True)
        changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        own, other, after = (piece_keys(pa.array(x, pa.large_string())) for x in (texts, changed, following))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, kind), pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array(fingerprints(*own)), pa.array(fingerprints(*other)),
                pa.array(likeness(*own, *other)), pa.array(likeness(*own, *after)),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint and its likeness to the next document and to itself edited with that one.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is the one
    with the next smaller id (null ids after all others, repeated ids by a hash of the text); after the last comes the first, so a
    single row is followed by itself. Ids are numbers. A null text is empty. Texts without words have the empty sketch and are alike. Other columns
    are ignored; an empty table gives an empty one.

    Ids are cut into ordered parts, so that one shuffle brings each text next to its neighbour; the first text of every part is
    also sent to the end of the part before it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, -(-total // PART_BYTES))
    shares = [i / parts for i in range(1, parts)]
    cuts = np.unique(source.agg(F.percentile_approx("id", shares, 10 * parts)).first()[0] or []) if shares else np.zeros(0)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        """0 for ids above the last cut, counting down from there; null ids after all."""
        part = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, part).astype(np.int32))

    ordered = source.withColumn("part", part_of("id")).withColumn("h", F.xxhash64("text"))
    # One row per part: its first text, and the part before it (before the first: the last).
    lead = ordered.groupBy("part").agg(F.max(F.struct("id", "h")).alias("lead"))
    lead = lead.withColumn("to", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())))
    own, guest = F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("to").alias("part"), F.lit(True).alias("guest"))
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("h") == F.col("lead.h"))
    # At most MOST_PARTS rows are broadcast.
    placed = ordered.join(F.broadcast(lead), "part").select("id", "text", "h", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    placed = placed.select("at.part", "at.guest", "id", "text", "h").repartition("part").sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), F.desc("h"))
    out = "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select("part", "guest", "id", "text").mapInArrow(_print, f"id {kind}, n_chars long, {out}").withColumnRenamed("id", id_col)
