"""Token counts by a public tokenizer, whole texts, huge ones in overlapping chunks that are spliced where both agree.

The tokenizer drops white space and lets no token reach across it (its normaliser and its pattern are both local to a run
without white space), so a white-space character that no token covers is a stable boundary: what is left of it does not change
with what is right of it. Texts up to a chunk are counted by their words between such boundaries, each distinct word encoded
once per worker. Longer ones are encoded in overlapping chunks with offsets; neighbours are spliced at a boundary in the overlap
that both have, and the overlap is widened until there is one or the text ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import BYTE_VALUE, Texts, span_hash, texts_of

CHUNK = 32_768  # code points
OVERLAP = 256
KNOWN_WORDS = 1_500_000  # words whose counts a worker keeps; then it starts anew
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_loaded: dict[str, object] = {}
_known: dict[str, dict[int, int]] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def _spans(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the tokens of a piece of text."""
    offsets = np.array(tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    return offsets[:, 0], offsets[:, 1]


def _boundary(text: str, lo: int, hi: int, *sides: tuple[np.ndarray, np.ndarray]) -> int | None:
    """The first white-space position in [lo, hi) that no token of either side covers. Sides have offsets in the whole text."""
    for at in range(lo, hi):
        if text[at] in _SPACES and not any(((start <= at) & (end > at)).any() for start, end in sides):
            return at
    return None


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text from overlapping chunks; the same number as encoding it whole."""
    total, lo = 0, 0
    hi = min(len(text), chunk)
    start, end = _spans(tokenizer, text[:hi])
    while hi < len(text):
        width = min(overlap, hi - lo)
        while True:
            begin = hi - width
            stop = min(len(text), begin + max(chunk, 2 * width))
            s, e = _spans(tokenizer, text[begin:stop])
            s, e = s + begin, e + begin
            at = _boundary(text, begin, hi, (start, end), (s, e))
            if at is not None or width >= hi - lo:
                break
            width = min(2 * width, hi - lo)
        if at is None:  # no stable boundary in the whole chunk: take the text from its begin in one longer chunk
            hi = min(len(text), lo + 2 * (hi - lo))
            start, end = _spans(tokenizer, text[lo:hi])
            start, end = start + lo, end + lo
            continue
        total += int((end <= at).sum())
        keep = s > at
        start, end, lo, hi = s[keep], e[keep], at + 1, stop
    return total + len(start)


def _word_counts(tokenizer, texts: Texts, known: dict[int, int]) -> np.ndarray:
    """Tokens per text, as the sum over its words."""
    starts, ends, firsts = texts.words()
    h, one, inverse = np.unique(span_hash(BYTE_VALUE[texts.data], starts, ends), return_index=True, return_inverse=True)
    hashes = h.tolist()
    new = [i for i, x in enumerate(hashes) if x not in known]
    if new:
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = list(range(len(hashes)))
        data = texts.data.tobytes()
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            encoded = tokenizer.encode_batch_fast([data[starts[one[i]] : ends[one[i]]].decode() for i in part], add_special_tokens=False)
            known.update(zip((hashes[i] for i in part), map(len, encoded), strict=True))
    counts = np.fromiter((known[x] for x in hashes), np.int64, len(hashes))[inverse]
    summed = np.concatenate([[0], np.cumsum(counts)])
    return summed[firsts[1:]] - summed[firsts[:-1]]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_bytes, n_tokens, over_limit` per row: UTF-8 bytes and tokens without begin, end or added special tokens.

    A null text is empty: 0 and 0. Special strings inside a text count as the library's default takes them. Rows are independent,
    so repeated ones repeat and a null id stays; other columns are ignored. `path` names a file for the tokenizers library whose
    pattern, like that of the default, lets no token cover white space.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), _known.setdefault(path, {})
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                size = np.diff(texts.offsets)
                counts = np.zeros(len(size), np.int64)
                huge = np.flatnonzero(size > CHUNK)
                for i in huge:
                    counts[i] = count_spliced(tokenizer, texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode())
                keep = np.repeat(size <= CHUNK, size)
                rest = Texts(texts.lo, texts.hi, texts.data[keep], np.concatenate([[0], np.cumsum(np.where(size <= CHUNK, size, 0))])) if len(huge) else texts
                counts += _word_counts(tokenizer, rest, known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.lo, len(size)), pa.array(size), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
