"""Approximate nearest neighbours by collision counting.

Vectors are dealt into blocks. In a block every random projection keeps its values in one sorted array. A query opens a window
around its own projection in each of them and widens all windows together by a factor (virtual rehashing); a vector that falls
into enough of the windows collides, and is verified by its true distance. The widening ends when the windows' radius has
passed the k-th verified distance: a vector nearer than that would very likely have collided by now. Nothing is capped: every
vector over the threshold is verified, so copies at one distance come in together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 96
WIDEN = 1.25
WIDTH = 3.0  # window width at radius 1: a vector at the radius is inside with probability erf(WIDTH / 2 / sqrt(2)), 0.87
BEHIND = 2.0  # standard deviations by which the threshold stays under the collisions expected at the radius
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
SEED = 5


def threshold() -> int:
    from math import erf, sqrt

    p = erf(WIDTH / 2 / sqrt(2))
    return max(1, int(PROJECTIONS * p - BEHIND * sqrt(PROJECTIONS * p * (1 - p))))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.directions = np.random.default_rng(SEED).normal(size=(vectors.shape[1], PROJECTIONS))
        projected = vectors @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.ravel()
        # The sorted arrays stand one after the other, each moved up beyond the one before, so one search serves all.
        self.low, reach = projected.min(0), float(np.ptp(projected, 0).max()) + 1
        self.shift = np.arange(PROJECTIONS) * 2 * reach - self.low
        self.sorted = np.sort(projected + self.shift, axis=0).T.ravel()
        self.first = np.arange(PROJECTIONS) * len(ids)
        self.reach = reach

    def _window(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        at, room = centre + self.shift, self.first + len(self.ids)
        lo = np.searchsorted(self.sorted, at - half, "left")
        hi = np.searchsorted(self.sorted, at + half, "right")
        return np.clip(lo, self.first, room), np.clip(hi, self.first, room)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first, ties to the smaller id; never the query's own id."""
        centre = query @ self.directions
        n, needed = len(self.ids), threshold()
        hits = np.zeros(n, np.int64)
        checked = self.ids == own
        left, right = self._window(centre, 0.0)
        right = left.copy()
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        # The first radius is an eighth of the usual distance on a line; closer vectors are simply found in the first windows.
        middle = self.sorted[self.first + n // 2] - self.shift
        radius = max(float(np.median(np.abs(middle - centre))) / 8, self.reach / 1024)
        while True:
            lo, hi = self._window(centre, radius * WIDTH / 2)
            lo, hi = np.minimum(lo, left), np.maximum(hi, right)
            begins, sizes = np.concatenate([lo, right]), np.concatenate([left - lo, hi - right])
            left, right = lo, hi
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
            if len(at):
                hits += np.bincount(self.order[at], minlength=n)
                fresh = np.flatnonzero((hits >= needed) & ~checked)
                if len(fresh):
                    checked[fresh] = True
                    apart = self.vectors[fresh] - query
                    found_at, found = np.concatenate([found_at, fresh]), np.concatenate([found, np.sqrt(np.einsum("ij,ij->i", apart, apart))])
            everything = (left == self.first).all() and (right == self.first + n).all()
            if everything or (len(found) >= k and np.partition(found, k - 1)[k - 1] <= radius):
                break
            radius *= WIDEN
        best = np.lexsort((self.ids[found_at], found))[:k]
        return self.ids[found_at[best]], found[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest found of each query among all vectors but its own id, by Euclidean distance.

    Both tables have `id_col` and `vector_col`; vectors that are null, zero, or hold a null or non-finite component take no part, nor
    do null ids. Only vectors of the query's length are compared. Distances are in double precision; ties go to the smaller id. With
    fewer than k candidates all are returned. Repeated rows of an id are candidates once each. Other columns are ignored.

    Every query meets every block of vectors, in groups of at most BLOCK_ROWS vectors and QUERY_ROWS queries on average, and leaves
    k rows per block.
    """

    def usable(table: DataFrame) -> DataFrame:
        v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("d", F.size("v"))

    rows, asked = usable(vectors), usable(queries)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(blocks))
    group = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(groups))
    stored = rows.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asking = asked.withColumn("part", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = "query_id long, vec_id long, score double"

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            held = Block(np.array(left["v"].tolist(), np.float64), left["id"].to_numpy())
            for own, query in zip(right["id"].to_numpy(), right["v"], strict=True):
                ids, score = held.search(np.asarray(query, np.float64), own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["d", F.col("block").cast("long").alias("block"), F.col("part").cast("long").alias("part")]
    met = stored.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(match, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
