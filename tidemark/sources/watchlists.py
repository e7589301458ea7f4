"""Stored watchlist snapshots: one per list and date, not overwritten unless forced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import snapshots
from tidemark.sources.readers import upsert_by_key

KEYS = ["watchlist_name", "snapshot_date"]


def write_watchlist(spark: SparkSession, root: str, rows: DataFrame, force: bool = False) -> int | None:
    """Store the snapshots in `rows` (watchlist_name, snapshot_date, ...) as one version of the table.

    A list that has a snapshot of that date already is an error, and nothing is written; with `force` the stored snapshot is
    replaced as a whole, also the rows of symbols that left the list. A null name or date is an error of the partition or matches
    nothing stored.
    """
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        if not force:
            taken = old.select(*KEYS).distinct().join(new.select(*KEYS).distinct(), KEYS, "left_semi").limit(5).collect()
            if taken:
                raise ValueError("already stored: " + ", ".join(f"{r.watchlist_name} of {r.snapshot_date}" for r in taken))
        return upsert_by_key(old, new, KEYS)

    return snapshots.merge(spark, root, rows, "snapshot_date", combine)
