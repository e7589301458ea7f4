"""Incremental ingestion: micro-batches upserted by key, resampling bounded by a watermark, late rows and restated periods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.joins import latest_by
from tidemark.sources import snapshots


def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", max_files: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(folder)
    )


def stream_upsert(
    rows: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], partition: str
) -> StreamingQuery:
    """Upsert every micro-batch into a table of `snapshots`, one version each. Inside a batch the greatest `order` of a key wins.

    The checkpoint names the writer: a batch replayed after a failure is passed over if its version is there.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        newest = latest_by(batch, keys, order).select(*batch.columns)
        snapshots.upsert(batch.sparkSession, table, newest, keys, partition, checkpoint, epoch)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resample_stream(ticks: DataFrame, period: str, lateness: str) -> DataFrame:
    """Ticks (ts, symbol, seq, price, shares) to bars per period; rows later than `lateness` are dropped."""
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", lateness).groupBy(F.window("ts", period).alias("_w"), "symbol").agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("shares").alias("volume"),
        )
        .select(F.to_date("_w.start").alias("date"), "symbol", "open", "high", "low", "close", "volume")
    )


def stream_resample(bars: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep a bar table of `snapshots` current: updated periods replace their earlier version."""
    def apply(batch: DataFrame, epoch: int) -> None:
        monthly = batch.withColumn("month", F.date_format("date", "yyyy-MM"))
        snapshots.upsert(batch.sparkSession, table, monthly, ["date", "symbol"], "month", checkpoint, epoch)

    return bars.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- late rows and restatements ---------------------------------------------------------------

PART_KEYS = ["month", "date", "symbol", "known_as_of"]


def _fold(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of bars to one per key: first and last by (time, seq), so parts may come in any order."""
    return parts.groupBy(*keys).agg(
        F.min_by("open", "first_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_at").alias("close"),
        F.sum("volume").alias("volume"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )


def bar_parts(ticks: DataFrame) -> DataFrame:
    """Ticks (ts, symbol, seq, price, shares, known_as_of) to one part per day, symbol and date at which its ticks were known.

    A tick without `known_as_of` was known on its day.
    """
    day = F.to_date("ts")
    at = F.struct("ts", "seq")
    single = ticks.select(
        F.date_format(day, "yyyy-MM").alias("month"), day.alias("date"), "symbol", F.coalesce("known_as_of", day).alias("known_as_of"),
        *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("shares").alias("volume"), at.alias("first_at"), at.alias("last_at"),
    )
    return _fold(single, PART_KEYS)


def bars_known(parts: DataFrame, asof: date | Column | None = None) -> DataFrame:
    """Bars (date, symbol, open, high, low, close, volume) from the ticks known at `asof`; from all of them without it."""
    known = parts if asof is None else parts.where(F.col("known_as_of") <= asof)
    return _fold(known, ["date", "symbol"]).drop("first_at", "last_at")


def stream_parts(ticks: DataFrame, table: str, late: str, checkpoint: str, lateness: timedelta) -> StreamingQuery:
    """Resample ticks into `table` (read by `bars_known`) and keep in `late` the rows that came too late.

    The watermark is the newest time of all earlier batches less `lateness`; it is stored with the version of `table` that it
    belongs to. A row behind it, or without a time, goes to `late`, with the watermark it missed (microseconds; null: no time).
    A row behind it that carries `known_as_of` is a restatement: it re-opens its day as a part of its own, so the bars known
    before that date stay as they were. Late rows are written before the parts: whatever fails, a replayed batch repeats what is
    missing and nothing else.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = snapshots.current(spark, table)
        if before and epoch <= before.epochs.get(checkpoint, -1):
            return
        mark = before.notes.get("watermark") if before else None
        batch = batch.persist()
        try:
            newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
            behind = F.lit(False) if mark is None else (F.unix_micros("ts") < mark) & F.col("known_as_of").isNull()
            missed = F.col("ts").isNull() | behind
            month = F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("none"))
            rows = batch.where(missed).select("*", F.when(F.col("ts").isNotNull(), F.lit(mark)).cast("long").alias("watermark"), month.alias("month"))
            snapshots.merge(spark, late, rows, "month", None, checkpoint, epoch)
            ahead = [x for x in (mark, None if newest is None else newest - int(lateness.total_seconds() * 1_000_000)) if x is not None]
            snapshots.merge(
                spark, table, bar_parts(batch.where(~missed)), "month", lambda old, new: _fold(old.unionByName(new), PART_KEYS),
                checkpoint, epoch, {"watermark": max(ahead)} if ahead else None,
            )
        finally:
            batch.unpersist()

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(late: DataFrame) -> DataFrame:
    """(date, symbol, n_late); rows without a time are counted under a null date."""
    return late.groupBy(F.to_date("ts").alias("date"), "symbol").agg(F.count("*").alias("n_late"))
