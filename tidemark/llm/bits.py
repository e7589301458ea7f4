"""A fixed-size bit table of 64-bit keys: a filter that spares shuffles. Its false hits cost rows, never results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import mix


def _place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    slot = mix(keys.view(np.uint64)) % np.uint64(64 * words)
    return (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)


def bit_table(keys: DataFrame, words: int = 1 << 17) -> np.ndarray:
    """Bits of a one-column table of longs (nulls are passed over). At most `words` rows, 1 MB by default, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(words, np.uint64)
        for batch in batches:
            word, bit = _place(batch.column(0).drop_null().to_numpy(), words)
            np.bitwise_or.at(table, word, np.uint64(1) << bit)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].view(np.int64))], ["word", "bits"])

    table = np.zeros(words, np.int64)
    used = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[used["word"].to_numpy()] = used["bits"].to_numpy()
    return table.view(np.uint64)


def may_have(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bit = _place(keys, len(table))
    return ((table[word] >> bit) & np.uint64(1)).astype(bool)
