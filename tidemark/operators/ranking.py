"""Ranks within a group that may hold most of the table.

A plain window puts a whole group into one task. Here rows (or distinct values with their counts) are dealt
into ordered ranges of equal depth by `repartitionByRange`, which samples the data, so heavy tails and
crowded values spread as evenly as any others. Each range is ordered on its own, and only the totals of the
ranges (one row per group and range) are accumulated per group. The dealt rows feed both steps, so they are
settled in the checkpoint folder; that also fixes which range is which.

Where no group passes `WINDOW_ROWS` rows, average-tie ranks come from one plain window instead: a bounded sort per task, and one
shuffle for all ranks of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

WINDOW_ROWS = 1_000_000  # rows of a group that one task may order


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` settled in ranges of equal depth over (by, order); `_part` numbers them in that order."""
    return settle(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def before_part(dealt: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """Per (by, _part): the sums over all earlier ranges of the group; zero in the first."""
    totals = dealt.groupBy(*by, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def counts_before(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per (by, value): its row count `_n` and the rows sorting before it, `_before`."""
    placed = ranged(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), by, [value])
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    offsets = before_part(placed, by, _offset=F.sum("_n"))
    local = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return placed.withColumn("_local", local).join(offsets, [*by, "_part"]).select(*by, value, "_n", (F.col("_local") + F.col("_offset")).alias("_before"))


def rank_average(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average-tie rank of `value` (ascending) within `by`; rows with NULL value get NULL."""
    return rank_averages(df, by, {value: name})


def rank_averages(df: DataFrame, by: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Average-tie ranks of several columns (column: name of its rank) within `by`; NULL has none, nor has a row without its group."""
    if (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= WINDOW_ROWS:
        grouped = F.lit(True)
        for c in by:
            grouped = grouped & F.col(c).isNotNull()
        for value, name in names.items():
            w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))
            # The frame ends at the last equal value, so the count is the greatest place of a tie and the rank the least.
            df = df.withColumn(name, F.when(grouped & F.col(value).isNotNull(), (F.rank().over(w) + F.count(value).over(w)) / 2))
        return df
    for value, name in names.items():
        ranks = counts_before(df.where(F.col(value).isNotNull()), by, value).select(
            *by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name)
        )
        df = df.join(ranks, [*by, value], "left")
    return df


def position(
    df: DataFrame, by: Sequence[str], value: str, tiebreak: str, name: str = "position", descending: bool = False
) -> DataFrame:
    """1-based place of every row ordered by (value, tiebreak); `tiebreak` is unique within `by`.

    The whole tie-break takes part in the ranges, so a value shared by most rows is split like any other.
    """
    ordered = df.where(F.col(value).isNotNull()).withColumn("_key", -F.col(value) if descending else F.col(value))
    dealt = ranged(ordered, by, ["_key", tiebreak])
    inside = Window.partitionBy(*by, "_part").orderBy("_key", tiebreak)
    offsets = before_part(dealt, by, _offset=F.count(F.lit(1)))
    placed = dealt.withColumn("_local", F.row_number().over(inside)).join(offsets, [*by, "_part"])
    return placed.withColumn(name, F.col("_local") + F.col("_offset")).drop("_key", "_part", "_local", "_offset")


def with_group_stats(df: DataFrame, by: Sequence[str], **stats: Column) -> DataFrame:
    """Attach aggregates of each group to its rows: partial aggregate plus an equi-join back."""
    agg = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(agg, list(by), "left")


def top_k(df: DataFrame, by: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """First k rows per group; Spark cuts each partition to k per group before the shuffle while k is within
    `spark.sql.optimizer.windowGroupLimitThreshold` (1,000 by default)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
