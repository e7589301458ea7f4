"""Streaming queries: the files of a table are read as a stream and run to completion."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.session import checkpoint_dir
from tidemark.sources import snapshots
from tidemark.streaming import incremental as inc


def _paths(spark, name):
    root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/state"


def _stream(spark, sf, name):
    return inc.read_files(spark, sf, v.table(spark, sf, name).schema, f"{name}.parquet")


@query("stream_upsert", f"SELECT {v._sql_symbol('o_custkey')} AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2")
def stream_upsert(spark, sf):
    table, state = _paths(spark, "upsert")
    rows = _stream(spark, sf, "orders").select(
        v.symbol_of(F.col("o_custkey")).alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), "o_orderkey", F.year("o_orderdate").alias("year"))
    inc.stream_upsert(rows, table, state, ["symbol", "date"], [F.col("o_orderkey")], "year").awaitTermination()
    return snapshots.read(spark, table).select("symbol", "date", "close")


@query("stream_resample", "SELECT date, symbol, open, high, low, close, volume FROM v_px")
def stream_resample(spark, sf):
    table, state = _paths(spark, "resample")
    ticks = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), v.symbol_of(F.col("user_id")).alias("symbol"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).alias("shares"))
    inc.stream_resample(inc.resample_stream(ticks, "1 day", "2 days"), table, state).awaitTermination()
    return snapshots.read(spark, table).drop("month")


# Every tenth event arrives in a second delivery; every other one of these is a restatement, known forty days after its day.
SQL_LATE = f"""mark AS (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 2 DAY AS mark FROM events WHERE event_id % 10 <> 0),
    dealt AS (SELECT CAST(ts AS DATE) AS date, {v._sql_symbol('user_id')} AS symbol, ts, event_id, value,
        event_id % 10 = 0 AND event_id % 20 <> 0 AND CAST(ts AS TIMESTAMP) < mark AS late, event_id % 20 = 0 AS restated FROM events, mark)"""
SQL_KNOWN = """SELECT {version} AS version, date, symbol, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM dealt WHERE NOT late AND {known} GROUP BY 2, 3"""


def _deliveries(spark, sf):
    """Both deliveries through the stream, the second after a restart from the checkpoint; the tables of parts and of late rows."""
    table, state = _paths(spark, "late")
    inbox, late = table.replace("/table", "/inbox"), table.replace("/table", "/late")
    known = F.when(F.col("event_id") % 20 == 0, F.date_add(F.to_date("ts"), 40))
    ticks = v.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), v.symbol_of(F.col("user_id")).alias("symbol"), F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.lit(1).alias("shares"), known.alias("known_as_of"))
    for some in (F.col("seq") % 10 != 0, F.col("seq") % 10 == 0):
        ticks.where(some).write.mode("append").parquet(inbox)
        stream = inc.read_files(spark, inbox, ticks.schema, max_files=1 << 30)
        inc.stream_parts(stream, table, late, state, timedelta(days=2)).awaitTermination()
    return snapshots.read(spark, table), snapshots.read(spark, late)


@query("stream_restated_bars", f"WITH {SQL_LATE} {SQL_KNOWN.format(version=chr(39) + 'first' + chr(39), known='NOT restated')} UNION ALL {SQL_KNOWN.format(version=chr(39) + 'last' + chr(39), known='true')}")
def stream_restated_bars(spark, sf):
    parts, _ = _deliveries(spark, sf)
    first, last = inc.bars_known(parts, F.col("date")), inc.bars_known(parts)
    return first.select(F.lit("first").alias("version"), "*").unionByName(last.select(F.lit("last").alias("version"), "*"))


@query("stream_late_rows", f"WITH {SQL_LATE} SELECT date, symbol, count(*) AS n_late FROM dealt WHERE late GROUP BY 1, 2")
def stream_late_rows(spark, sf):
    return inc.late_counts(_deliveries(spark, sf)[1])
