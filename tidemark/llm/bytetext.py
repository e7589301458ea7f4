"""Words, lines and their hashes for a whole Arrow batch at once, from its UTF-8 bytes and offsets.

A word is `[^\\x20\\x09-\\x0D]+`; these bytes never occur inside a longer UTF-8 character, so splitting bytes splits text.
Hashes are 64 bits: a polynomial over a random value per byte, then a finaliser that also takes the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # bytes of text worked on at a time; a longer text is worked on by itself

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
_RANDOM = np.random.default_rng(20240607)
BYTE_VALUE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]
BASE = 0x9E3779B97F4A7C15 | 3
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hash_without(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Hash of each span without its value at `gone`: what span_hash gives for the rest joined. gone = end takes nothing away."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 2)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[gone] - total[starts]) * down[starts] + (total[ends] - total[np.minimum(gone + 1, ends)]) * down[starts + 1]
    return mix(h + (ends - starts - (gone < ends)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Rows lo..hi of a batch: their bytes, and offsets of each text in them. A null text is empty."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def spans(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs without a `gap` byte: starts, ends, and the first run of each text (one more than texts)."""
        solid = ~gap[self.data]
        n = len(solid)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = solid
        after = np.zeros(n + 1, bool)
        after[:-1] = solid
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(WHITE)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces between line feeds; empty ones count too, so joining a text's lines by a line feed gives the text."""
        breaks = np.flatnonzero(NEWLINE[self.data])
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([breaks, self.offsets[1:]]))
        per_text = np.searchsorted(breaks, self.offsets[1:]) - np.searchsorted(breaks, self.offsets[:-1]) + 1
        return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def texts_of(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column, each of about `limit` bytes at most unless one text alone is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def owner(firsts: np.ndarray) -> np.ndarray:
    """Which text each span belongs to, from the first span of each text."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def shingles(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of lower-cased (A-Z) texts, in order, and the text of each; fewer words: one shingle of all."""
    starts, ends, firsts = texts.words()
    word = span_hash(LOWER_VALUE[texts.data], starts, ends)
    counts = np.diff(firsts)
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = np.array([pow(BASE, 3 * j + 1, 1 << 64) for j in range(k)], np.uint64)
    h = np.zeros(n, np.uint64)
    for j, factor in enumerate(factors[:n]):
        h[: n - j] += word[j:] * factor
    of = owner(firsts)
    place = np.arange(n) - firsts[:-1][of]
    keep = place + k <= counts[of]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        at = firsts[i]
        keep[at] = True
        h[at : at + 1] = (word[at : at + counts[i]] * factors[: counts[i]]).sum() + np.full(1, k - counts[i], np.uint64)
    return mix(h[keep]), of[keep]
