"""Mixing sources to target weights: whole passes over a source, then documents of chosen lengths that fill what is left.

Documents are counted by exact size. The rest of a source's target is first shared over its sizes in proportion, then a
bounded-knapsack over the documents still free finds the counts by size whose sum comes nearest to the target. Which documents
of a size are taken is a seeded hash order, cut by counts of hash ranges, so a size that many documents share is never sorted
in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # a source, and a document, is used at most so many times its size
RANGE_ROWS = 4096  # documents that a hash range is meant to hold
KNAPSACK = 1 << 14  # words of budget that the knapsack settles; longer documents have brought it down to that


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """`source, source_size, target` from `source, source_size`, one row per source.

    Sources by code point, null last, take the weights in turn and share the total; none gets over MOST times its own size.
    The excess is shared again by weight. That ends at target = min(cap, level * weight) for one level, found from the sources
    ordered by cap / weight: with the first i at their caps, level = what is left / weights left, and the first level that
    the next source's cap allows is it.
    """
    everywhere = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    rank = F.row_number().over(everywhere) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = weighed.withColumn("level", level)
    # At exactly full caps every level is below its ratio at the last source; coalesce stands for no source at all.
    found = levelled.withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap").cast("double")))
    return found.select("source", "source_size", target.alias("target"))


def fill(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size (ascending, distinct, positive) to take so that their words come nearest to the budget."""
    total = int(sizes @ counts)
    take = np.zeros(len(sizes), np.int64)
    if total <= 0 or budget <= 0:
        return take
    take = np.minimum(counts, np.floor(counts * (budget / total)).astype(np.int64))
    rest = budget - int(sizes @ take)
    free = counts - take
    for i in range(len(sizes) - 1, -1, -1):  # the longest first, while there is more to fill than the knapsack settles
        if rest <= KNAPSACK:
            break
        more = min(int(free[i]), int((rest - KNAPSACK / 2) // sizes[i]))
        if more > 0:
            take[i] += more
            free[i] -= more
            rest -= more * int(sizes[i])
    if rest <= 0:
        return take
    # Every sum up to twice the rest (beyond, nothing at all is nearer), as bits; `came` keeps them after each item, largest first.
    limit = 2 * int(rest) + 1
    mask, reach, items, came = (1 << (limit + 1)) - 1, 1, [], [1]
    for i in range(len(sizes) - 1, -1, -1):
        size, left, many = int(sizes[i]), int(min(free[i], limit // sizes[i])), 1
        while left > 0:  # counts by powers of two make the bounded item a few plain ones
            part = min(many, left)
            reach |= (reach << (size * part)) & mask
            items.append((i, part, size * part))
            came.append(reach)
            left -= part
            many *= 2
        if (reach >> int(rest)) & 1:
            break
    low = int(rest)
    under = (reach & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = reach >> (low + 1)
    over = low + 1 + (above & -above).bit_length() - 1 if above else None
    goal = over if over is not None and over - rest < rest - under else under
    for j in range(len(items) - 1, -1, -1):
        i, part, size = items[j]
        if not (came[j] >> goal) & 1:
            take[i] += part
            goal -= size
    return take


def _counts(histogram: pd.DataFrame) -> pd.DataFrame:
    """One source: how often all its documents are taken, and of how many documents of each size there is one more."""
    histogram = histogram.sort_values("size")
    size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    passes = min(MOST, int(target // size)) if size else 0
    sizes, counts = histogram["size"].to_numpy(np.int64), histogram["docs"].to_numpy(np.int64)
    used = sizes > 0
    more = np.zeros(len(sizes), np.int64)
    if passes < MOST:
        more[used] = fill(sizes[used], counts[used], target - passes * size)
    return pd.DataFrame({"key": histogram["key"], "size": sizes, "docs": counts, "passes": passes, "more": more})


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`id, source, size, source_size, target, copies, taken` per row: how often the mix takes it, and so how many words.

    Size is the number of words (null text: 0). A source's taken words come as near to its target as its documents allow, up to
    the proportional first share. Every run takes the same rows: among equal sizes a seeded hash of the id decides, then the id,
    and rows with the same id and size are alike. A row without words is never taken. An empty table gives an empty one.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source has a key that no other has
    sized = settle(sized.withColumn("key", key).withColumn("draw", F.xxhash64(F.lit(seed), "id")))
    histogram = settle(sized.groupBy("key", "source", "size").agg(F.count("*").alias("docs")))
    per_source = histogram.groupBy("key", "source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    goals = targets(per_source.select("source", "source_size"), weights).withColumn("key", key)
    goals = settle(goals.drop("source"))
    counted = histogram.drop("source").join(goals, "key").groupBy("key").applyInPandas(_counts, "key string, size long, docs long, passes long, more long")
    plan = settle(counted)

    # The draw is cut into ranges of bounded size; counts of earlier ranges say how many rows each has still to give.
    spread = F.ceil(F.col("docs") / RANGE_ROWS)
    at = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    ranged = sized.where("size > 0").join(plan, ["key", "size"]).withColumn("range", F.floor(at * spread))
    per_range = ranged.groupBy("key", "size", "range").agg(F.count("*").alias("rows"), F.any_value("more").alias("more"))
    before = Window.partitionBy("key", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opens = per_range.withColumn("open", F.col("more") - F.coalesce(F.sum("rows").over(before), F.lit(0))).select("key", "size", "range", "open")
    nth = F.row_number().over(Window.partitionBy("key", "size", "range").orderBy("draw", "id"))
    taken = ranged.join(opens, ["key", "size", "range"]).withColumn("copies", F.col("passes") + (nth <= F.col("open")).cast("long"))
    columns = ["id", "source", "size", "key", "copies"]
    rows = taken.select(*columns).unionByName(sized.where("size = 0").withColumn("copies", F.lit(0).cast("long")).select(*columns))
    return rows.join(goals, "key").select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
