"""Queries on contracts, symbols, costs and lot arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import symbols as sy
from tidemark.operators import accounting as ac
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.sources import contracts as ct


@query("parse_symbol", """SELECT symbol, split_part(symbol, '.', 1) AS code, split_part(symbol, '.', 2) AS exchange,
    CASE split_part(symbol, '.', 2) WHEN 'HK' THEN 'HKD' ELSE 'CNY' END AS currency, regexp_matches(symbol, '^[0-9]{4,6}[.](SH|SZ|HK)$') AS strict FROM v_sector""")
def parse_symbol(spark, sf):
    out = sy.parse_symbol(v.v_sector(spark, sf).select("symbol"))
    return out.select("symbol", "code", "exchange", "currency", sy.is_strict_symbol(F.col("symbol")).alias("strict"))


@query("enforce_contract", """WITH t AS (SELECT exec_date AS date, CASE WHEN shares = 7 THEN 'bad' ELSE symbol END AS symbol,
      CASE WHEN side = 'sell' AND shares = 3 THEN NULL ELSE price END AS weight FROM v_trade),
    d AS (SELECT count(*) AS n FROM t GROUP BY date, symbol HAVING count(*) > 1)
    SELECT * FROM (SELECT 'null:weight' AS rule, count(*) FILTER (weight IS NULL) AS n FROM t UNION ALL
      SELECT 'pattern:symbol', count(*) FILTER (NOT regexp_matches(symbol, '^[0-9]{4,6}[.](SH|SZ|HK)$')) FROM t UNION ALL SELECT 'duplicate:key', coalesce(sum(n), 0)::BIGINT FROM d) WHERE n > 0""")
def enforce_contract(spark, sf):
    t = v.v_trade(spark, sf).select(
        F.col("exec_date").alias("date"), F.when(F.col("shares") == 7, F.lit("bad")).otherwise(F.col("symbol")).alias("symbol"),
        F.when(~((F.col("side") == "sell") & (F.col("shares") == 3)), F.col("price")).alias("weight"))
    return ct.violations(ct.coerce(t, ct.WEIGHTS), ct.WEIGHTS)


@query("cost_breakdown", """SELECT symbol, exec_date, side, shares, notional,
    greatest(notional * CASE WHEN symbol LIKE '%.HK' THEN 0.002 ELSE 0.00025 END, CASE WHEN symbol LIKE '%.HK' THEN 50 ELSE 5 END) AS commission,
    notional * CASE WHEN symbol LIKE '%.HK' THEN 0.001 WHEN side = 'sell' THEN 0.0005 ELSE 0 END AS stamp_duty,
    notional * CASE WHEN symbol LIKE '%.HK' THEN 0.000265 ELSE 0.00001 END AS transfer_fee,
    notional * CASE WHEN symbol LIKE '%.HK' THEN 0.0000565 ELSE 0.0000341 END AS exchange_fee FROM v_trade""")
def cost_breakdown(spark, sf):
    out = ac.cost_breakdown(v.v_trade(spark, sf))
    return out.select("symbol", "exec_date", "side", "shares", "notional",
                      "commission", "stamp_duty", "transfer_fee", "exchange_fee")


@query("slippage_price", "SELECT symbol, exec_date, side, shares, price * (1 + CASE side WHEN 'buy' THEN 1 ELSE -1 END * CASE WHEN symbol LIKE '%.HK' THEN 10 ELSE 5 END / 10000) AS fill_price FROM v_trade")
def slippage_price(spark, sf):
    out = v.v_trade(spark, sf).withColumn("fill_price", ac.slippage_price(F.col("price"), F.col("side"), ac.slippage_bps(F.col("symbol"))))
    return out.select("symbol", "exec_date", "side", "shares", "fill_price")


@query("base_fill_price", "SELECT symbol, date, open, CASE WHEN volume > 0 THEN amount / volume ELSE open END AS vwap, close FROM v_bar")
def base_fill_price(spark, sf):
    return v.v_bar(spark, sf).select("symbol", "date", ac.base_fill_price("open").alias("open"),
                                     ac.base_fill_price("vwap").alias("vwap"), ac.base_fill_price("close").alias("close"))


@query("round_to_lot", "SELECT symbol, exec_date, notional, floor(notional / 13 / 100)::BIGINT * 100 AS buy_shares, ceil(notional / 13 / 100)::BIGINT * 100 AS sell_shares FROM v_trade")
def round_to_lot(spark, sf):
    raw = F.col("notional") / 13
    return v.v_trade(spark, sf).select("symbol", "exec_date", "notional", ac.round_to_lot(raw, F.lit(True), F.lit(100)).alias("buy_shares"),
                                       ac.round_to_lot(raw, F.lit(False), F.lit(100)).alias("sell_shares"))


@query("truncate_text", """SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || '[truncated]' ELSE text END AS text, length(text) > 1000 AS truncated FROM documents""")
def truncate_text(spark, sf):
    from tidemark.operators.documents import truncate_text as cut
    return cut(v.table(spark, sf, "documents").select("doc_id", "text"), 1000)


@query("affordable_lots", """SELECT symbol, exec_date, notional, price, greatest(floor(least(notional / (price * (1 + CASE WHEN symbol LIKE '%.HK' THEN 0.0013215 ELSE 0.0000441 END + CASE WHEN symbol LIKE '%.HK' THEN 0.002 ELSE 0.00025 END)),
    (notional - CASE WHEN symbol LIKE '%.HK' THEN 50 ELSE 5 END) / (price * (1 + CASE WHEN symbol LIKE '%.HK' THEN 0.0013215 ELSE 0.0000441 END))) / 10), 0)::BIGINT * 10 AS shares FROM v_trade""")
def affordable_lots(spark, sf):
    t = v.v_trade(spark, sf).withColumn("side", F.lit("buy"))
    return t.select("symbol", "exec_date", "notional", "price", ac.affordable_shares(F.col("notional"), F.col("price"), F.col("symbol"), F.col("side"), F.lit(10)).alias("shares"))
