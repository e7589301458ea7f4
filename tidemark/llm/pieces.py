"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut into units no piece reaches across (before a run of spaces, and around bytes that no piece holds); each
distinct unit is encoded once. The new units of a batch are concatenated and their suffixes sorted; every piece of the vocabulary is
binary-searched for its range of occurrences. Occurrences are edges from their first to their last byte; sorted by end, they are
relaxed from left to right over all units at once.

The model is byte-pair encoding, whose result is not a cheapest path: it merges the best pair until none is left. So an edge is
taken not for a lower cost but if the piece that ends where it begins may stand before it, that is if merging just these two
pieces' characters gives the two back. Merges on one side of a boundary do not depend on what is beyond it while nothing merges
across, so a segmentation is the model's own exactly if all its neighbours are such pairs, and every prefix has one last piece.
Characters that are no piece become their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import BYTE_VALUE, Texts, span_hash, texts_of

KNOWN_UNITS = 600_000  # units a worker keeps; then it starts anew
KNOWN_PAIRS = 1_000_000
LIST_IDS = 1 << 18  # ids decoded at a time
TEXT_BYTES = 1 << 20  # of text worked on at a time
UNIT_BYTES = 1 << 17  # of units that are indexed at a time, unless one alone is longer
SPACE = 0x20
_models: dict[str, Vocabulary] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> Vocabulary:
    if path not in _models:
        _models[path] = Vocabulary(path)
    return _models[path]


class Memo:
    """Numbers by 64-bit key: sorted arrays, and a small dictionary of what is new."""

    def __init__(self):
        self.keys, self.values, self.fresh = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}

    def __len__(self) -> int:
        return len(self.keys) + len(self.fresh)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.values[at], -1).astype(np.int64)
        if self.fresh:
            rest = np.flatnonzero(out < 0)
            get = self.fresh.get
            out[rest] = [get(k, -1) for k in keys[rest].tolist()]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.fresh.update(zip(keys.tolist(), values.tolist(), strict=True))
        if len(self.fresh) > 1 << 16:
            keys = np.concatenate([self.keys, np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))])
            values = np.concatenate([self.values, np.fromiter(self.fresh.values(), np.int32, len(self.fresh))])
            order = np.argsort(keys)
            self.keys, self.values, self.fresh = keys[order], values[order], {}


class Vocabulary:
    """Pieces and scores of a byte-pair model with byte fallback, and what its worker has already worked out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.byte_ids = np.zeros(256, np.int32)
        self.surface: list[bytes] = [b""] * n
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif model.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not (model.is_control(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.surface[i], self.rank[text], self.id_of[text] = text.encode(), model.get_score(i), i
        if any(" " in p.lstrip(" ") for p in self.rank):
            raise ValueError("a piece of this model reaches over a word's end")
        used = {b for p in self.rank for b in p.encode()}
        self.hard = np.array([b < 0x80 and b not in used for b in range(256)])
        self.text_of = {i: p for p, i in self.id_of.items()}
        order = sorted(self.rank, key=lambda p: p.encode())
        raw = [p.encode() for p in order]
        self.ids = np.array([self.id_of[p] for p in order], np.int64)
        self.lengths = np.array([len(p) for p in raw])
        self.width = int(self.lengths.max())
        self.short = self.lengths <= 8
        pad = [int.from_bytes(p[:8].ljust(8, b"\0"), "big") for p in raw]
        self.low = np.array(pad, np.uint64)
        self.high = np.array([v | ((1 << (8 * max(0, 8 - len(p)))) - 1) for v, p in zip(pad, raw, strict=True)], np.uint64)
        self.long_pieces = np.array([p for p in raw if len(p) > 8] or [b""], f"S{self.width + 1}")
        self.long_ends = np.array([p.ljust(self.width + 1, b"\xff") for p in raw if len(p) > 8] or [b""], f"S{self.width + 1}")
        self.bytes_flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.bytes_len = np.array([len(p) for p in self.surface])
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.pairs = Memo()
        self.forget()

    def forget(self) -> None:
        self.known = Memo()
        self.flat: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short string: the best pair first, the leftmost of equal ones."""
        parts, rank = list(text), self.rank
        scores = [rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at > 0:
                scores[at - 1] = rank.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = rank.get(parts[at] + parts[at + 1])

    def may_follow(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays two when merged; pieces from `size` on are characters that merge with nothing."""
        key = before * (1 << 20) + after
        unique, inverse = np.unique(key, return_inverse=True)
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs = Memo()
        keys = unique.astype(np.uint64)
        found = self.pairs.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            for j, k in zip(new.tolist(), unique[new].tolist(), strict=True):
                a, b = k >> 20, k & ((1 << 20) - 1)
                if a >= self.size or b >= self.size:
                    found[j] = 1
                else:
                    left, right = self.text_of[a], self.text_of[b]
                    found[j] = self.merged(left + right) == [left, right]
            self.pairs.add(keys[new], found[new])
        return (found > 0)[inverse]

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and piece of every occurrence of a piece in text whose units are parted by zero bytes."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(self.width + 9, np.uint8)])
        head = np.zeros(n, np.uint64)
        for j in range(8):
            head |= padded[j : n + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        suffixes = np.argsort(head)
        ordered = head[suffixes]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        lo, hi, pieces, lengths = lo[self.short], hi[self.short], self.ids[self.short], self.lengths[self.short]
        begins, which, size = self._ranges(suffixes, lo, hi, pieces, lengths)
        # Pieces of more than eight bytes: only suffixes that begin like one are sorted further.
        again = suffixes[np.isin(ordered, self.low[~self.short])]
        if len(again):
            window = np.lib.stride_tricks.sliding_window_view(padded, self.width + 1)[again]
            tails = np.ascontiguousarray(window).view(f"S{self.width + 1}").ravel()
            by = np.argsort(tails, kind="stable")
            tails, again = tails[by], again[by]
            lo, hi = np.searchsorted(tails, self.long_pieces, "left"), np.searchsorted(tails, self.long_ends, "right")
            more = self._ranges(again, lo, hi, self.ids[~self.short], self.lengths[~self.short])
            begins, which, size = (np.concatenate(x) for x in zip((begins, which, size), more, strict=True))
        return begins, size, which

    @staticmethod
    def _ranges(suffixes, lo, hi, pieces, lengths):
        many = np.maximum(hi - lo, 0)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        return suffixes[at], np.repeat(pieces, many), np.repeat(lengths, many)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has."""
        data = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
        size = np.array([len(u) for u in units])
        first = np.cumsum(size + 1) - (size + 1)
        unit_start = np.repeat(first, size + 1)
        begin, length, piece = self._edges(data)
        # A character without a piece of its own is an edge that keeps to itself: its id stands for its place.
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        lead[first + size] = False
        alone = lead.copy()
        alone[begin[length == width[begin]]] = False
        alone = np.flatnonzero(alone)
        begin, length, piece = np.concatenate([begin, alone]), np.concatenate([length, width[alone]]), np.concatenate([piece, np.full(len(alone), self.size)])
        end = begin + length
        place = end - unit_start[begin]
        order = np.argsort(place, kind="stable")
        begin, end, piece, place = begin[order], end[order], piece[order], place[order]
        last = np.full(len(data) + 1, -1, np.int64)
        back = np.full(len(data) + 1, -1, np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(place)]]), strict=True):
            b, e, p = begin[lo:hi], end[lo:hi], piece[lo:hi]
            opening = b == unit_start[b]
            inner = np.flatnonzero(~opening & (last[b] >= 0))
            good = opening & self._stays(p, opening)
            if len(inner):
                good[inner] = self.may_follow(last[b[inner]], p[inner])
            last[e[good]], back[e[good]] = p[good], b[good]
        stops, pieces, ends, owner = first + size, [], [], np.arange(len(units))
        at = stops.copy()
        while len(at):  # from the ends back, one piece of every unit at a time
            pieces.append(last[at])
            ends.append(at)
            at = back[at]
            go = at > first[owner]
            if len(pieces) == 1:
                owners = [owner]
            else:
                owners.append(owner)
            at, owner = at[go], owner[go]
        pieces, ends, owners = np.concatenate(pieces), np.concatenate(ends), np.concatenate(owners)
        order = np.lexsort((ends, owners))
        pieces, ends, owners = pieces[order], ends[order], owners[order]
        other = pieces >= self.size
        if other.any():
            begins = back[ends]
            many = np.where(other, ends - begins, 1)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            raw = np.repeat(other, many)
            ids = np.repeat(pieces, many)
            ids[raw] = self.byte_ids[data[(np.repeat(begins, many) + at)[raw]]]
            return ids.astype(np.int32), np.bincount(np.repeat(owners, many), minlength=len(units))
        return pieces.astype(np.int32), np.bincount(owners, minlength=len(units))

    def _stays(self, pieces: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """Whether a piece is what its own characters merge to; a first piece must be."""
        out = np.zeros(len(pieces), bool)
        at = np.flatnonzero(ask)
        unique, inverse = np.unique(pieces[at], return_inverse=True)
        out[at] = np.array([p >= self.size or self.merged(self.text_of[p]) == [self.text_of[p]] for p in unique.tolist()], bool)[inverse] if len(at) else False
        return out

    def encode(self, texts: Texts) -> pa.ListArray:
        """Token ids of every text. Texts already have spaces for their U+2581 and the leading space of the model."""
        data, n = texts.data, len(texts.data)
        counts = np.zeros(len(texts.offsets) - 1, np.int64)
        if not n:
            return pa.ListArray.from_arrays(np.zeros(len(counts) + 1, np.int32), pa.array([], pa.int32()))
        blank, hard = data == SPACE, self.hard[data]
        cut = np.zeros(n + 1, bool)
        cut[texts.offsets] = True
        cut[1:n] |= (blank[1:] & ~blank[:-1]) | hard[1:] | hard[:-1]
        edge = np.flatnonzero(cut)
        starts, ends = edge[:-1], edge[1:]
        h, one, inverse = np.unique(span_hash(BYTE_VALUE[data], starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > KNOWN_UNITS:
            self.forget()
        at = self.known.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            size = (ends - starts)[one[new]]
            for part in np.split(new, np.flatnonzero(np.diff(np.cumsum(size) // UNIT_BYTES)) + 1):
                ids, many = self._encode_units([raw[starts[i] : ends[i]] for i in one[part].tolist()])
                at[part] = len(self.known) + np.arange(len(part))
                self.known.add(h[part], at[part])
                self.flat.append(ids)
                self.counts.append(many)
        flat, many = np.concatenate(self.flat), np.concatenate(self.counts)
        self.flat, self.counts = [flat], [many]
        at = at[inverse]
        first, size = (np.cumsum(many) - many)[at], many[at]
        out = flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
        tokens = np.concatenate([[0], np.cumsum(size)])
        return pa.ListArray.from_arrays(tokens[np.searchsorted(starts, texts.offsets)].astype(np.int32), pa.array(out))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of lists of ids, without the model's leading space; ids outside the vocabulary give nothing."""
        known = (ids >= 0) & (ids < self.size)
        size = np.where(known, self.bytes_len[np.where(known, ids, 0)], 0)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bytes_at[np.where(known, ids, 0)], size)
        raw = self.bytes_flat[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        out = [raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [x[1:] if x[:1] == " " else x for x in out]


def _prepared(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(column.fill_null("") if column.null_count else column, "▁", " ")
    return pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """docs with `out_col`, the token ids of the whole text, as the model's own library gives them. Null and empty texts: no ids.

    All columns are kept; one of the name `out_col` is replaced. Rows are independent of each other.
    """
    path = path or model_path()
    kept = [c for c in docs.columns if c != out_col or c == text_col]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            for rows in texts_of(batch.column(at), TEXT_BYTES):
                part = batch.slice(rows.lo, rows.hi - rows.lo)
                for texts in texts_of(_prepared(part.column(at)), 1 << 62):
                    yield pa.RecordBatch.from_arrays([*part.columns, model.encode(texts)], [*part.schema.names, "_tokens"])

    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    schema = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    done = named.mapInArrow(run, f"{schema}_tokens array<int>")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if c != out_col), F.col("_tokens").alias(out_col))


def decode(tokens: DataFrame, path: str | None = None, tokens_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """tokens with `out_col`, the text of its ids: U+2581 has become a space, all else is as it was. Null lists give a null text."""
    path = path or model_path()
    kept = [c for c in tokens.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy())
            for rows in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // LIST_IDS)) + 1):
                part = batch.slice(rows[0], len(rows)) if len(rows) else batch
                ids = part.column("_tokens")
                lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
                texts = model.decode(ids.flatten().fill_null(-1).to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]))
                rest = part.select(range(part.num_columns - 1))
                text = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*rest.columns, text], [*rest.schema.names, "_text"])

    named = tokens.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(tokens_col).alias("_tokens"))
    schema = "".join(f"c{i} {tokens.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    done = named.mapInArrow(run, f"{schema}_text string")
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("_text").alias(out_col))
