"""Queries of portfolio accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded, settled_round
from tidemark.operators import accounting as ac
from tidemark.plans import views as v
from tidemark.plans.registry import query

# Targets: traded symbols at unit weights of a million; holdings: sold lines. Both from the trade view.
SQL_REB = """t AS (SELECT run_id, exec_date AS date, symbol, (arg_max(shares, (notional, shares)) - 10) / 1000.0 AS weight, 1000000.0 AS nav, arg_max(price, (notional, shares)) AS price, CASE WHEN symbol LIKE '%.HK' THEN 0.9 ELSE 1.0 END AS fx FROM v_trade WHERE side = 'buy' GROUP BY 1, 2, 3),
    h AS (SELECT run_id, exec_date AS date, symbol, sum(CASE WHEN shares % 5 = 0 THEN -shares ELSE shares END)::BIGINT AS held FROM v_trade WHERE shares > 20 GROUP BY 1, 2, 3)"""


def _rebalance(spark, sf):
    t = v.v_trade(spark, sf)
    best = F.struct("notional", "shares")
    targets = t.where("side = 'buy'").groupBy("run_id", F.col("exec_date").alias("date"), "symbol").agg(
        ((F.max_by("shares", best) - 10) / 1000.0).alias("weight"), F.max_by("price", best).alias("price"))
    targets = targets.withColumn("nav", F.lit(1000000.0)).withColumn("fx", ac.fx_of(F.col("symbol"), F.lit(0.9)))
    held = t.where("shares > 20").groupBy("run_id", F.col("exec_date").alias("date"), "symbol").agg(
        F.sum(F.when(F.col("shares") % 5 == 0, -F.col("shares")).otherwise(F.col("shares"))).alias("shares"))
    return targets, held


@query("rebalance_diff", f"WITH {SQL_REB} SELECT run_id, date, symbol, round(weight, 6) AS weight, held FROM t FULL JOIN h USING (run_id, date, symbol)")
def rebalance_diff(spark, sf):
    t, h = _rebalance(spark, sf)
    out = t.join(h.withColumnRenamed("shares", "held"), ["run_id", "date", "symbol"], "full_outer")
    return out.select("run_id", "date", "symbol", rounded(F.col("weight")).alias("weight"), "held")


@query("rebalance_orders", f"""WITH {SQL_REB}, j AS (SELECT run_id, date, symbol, coalesce(held, 0) AS held, CASE WHEN weight IS NULL THEN 0 WHEN weight >= 0 THEN floor(abs(nav * weight / (price * fx)) / 10)::BIGINT * 10 ELSE -ceil(abs(nav * weight / (price * fx)) / 10)::BIGINT * 10 END AS target FROM t FULL JOIN h USING (run_id, date, symbol))
    SELECT run_id, date, symbol, CASE WHEN target > held THEN CASE WHEN held < 0 THEN 'cover' ELSE 'buy' END ELSE CASE WHEN held > 0 THEN 'sell' ELSE 'short' END END AS side, abs(target - held) AS shares FROM j WHERE held <> target""")
def rebalance_orders(spark, sf):
    return ac.rebalance_orders(*_rebalance(spark, sf), lot=10)


def _flagged(spark, sf):
    return v.v_bar(spark, sf).withColumns({"is_suspended": F.col("volume") % 7 == 0, "hit_limit_up": F.col("close") == F.col("high"), "hit_limit_down": F.col("close") == F.col("low")})


@query("order_eligibility", """WITH o AS (SELECT exec_date AS date, symbol, CASE WHEN side = 'sell' AND shares % 4 = 0 THEN 'short' ELSE side END AS side, shares, notional, exec_date + CAST(shares % 3 - 1 AS INTEGER) AS locked_until FROM v_trade),
    j AS (SELECT o.*, CASE WHEN b.symbol IS NULL THEN 'no_price_bar' WHEN volume % 7 = 0 THEN 'suspended' WHEN side = 'buy' AND close = high THEN 'limit_up' WHEN side IN ('sell', 'short') AND close = low THEN 'limit_down'
      WHEN side = 'sell' AND o.date <= locked_until THEN 'T+N lock' WHEN side = 'short' AND o.symbol NOT LIKE '%.HK' THEN 'a_share_short_disallowed' END AS reason FROM o LEFT JOIN v_bar b ON b.symbol = o.symbol AND b.date = o.date)
    SELECT date, symbol, side, shares, notional, reason, coalesce(reason IN ('suspended', 'limit_up', 'limit_down'), false) AS retry FROM j""")
def order_eligibility(spark, sf):
    side = F.when((F.col("side") == "sell") & (F.col("shares") % 4 == 0), "short").otherwise(F.col("side"))
    orders = v.v_trade(spark, sf).select(F.col("exec_date").alias("date"), "symbol", side.alias("side"), "shares", "notional",
                                         F.date_add("exec_date", (F.col("shares") % 3 - 1).cast("int")).alias("locked_until"))
    return ac.order_eligibility(orders, _flagged(spark, sf)).drop("locked_until")


@query("price_fills", """WITH f AS (SELECT t.exec_date AS date, t.symbol, t.side, t.shares, b.close * (1 + CASE t.side WHEN 'buy' THEN 1 ELSE -1 END * CASE WHEN t.symbol LIKE '%.HK' THEN 10 ELSE 5 END / 10000) AS fill_price FROM v_trade t JOIN v_bar b ON b.symbol = t.symbol AND b.date = t.exec_date)
    SELECT date, symbol, side, shares, round(fill_price, 3) AS fill_price, round(greatest(fill_price * shares * CASE WHEN symbol LIKE '%.HK' THEN 0.002 ELSE 0.00025 END, CASE WHEN symbol LIKE '%.HK' THEN 50 ELSE 5 END)
      + fill_price * shares * CASE WHEN symbol LIKE '%.HK' THEN 0.0013215 WHEN side = 'sell' THEN 0.0005441 ELSE 0.0000441 END, 3) AS cost_total FROM f""")
def price_fills(spark, sf):
    orders = v.v_trade(spark, sf).select(F.col("exec_date").alias("date"), "symbol", "side", "shares")
    out = ac.price_fills(orders, v.v_bar(spark, sf))
    return out.select("date", "symbol", "side", "shares", rounded(F.col("fill_price"), 3).alias("fill_price"), rounded(F.col("cost_total"), 3).alias("cost_total"))


SQL_HOLD = """dt AS (SELECT run_id, symbol, exec_date AS date, sum(CASE side WHEN 'buy' THEN shares ELSE -shares END) AS net, sum(CASE side WHEN 'buy' THEN shares ELSE 0 END) AS bought, sum(CASE side WHEN 'buy' THEN notional ELSE 0 END) AS paid FROM v_trade GROUP BY 1, 2, 3),
    hold AS (SELECT run_id, symbol, date, sum(net) OVER w::BIGINT AS shares, CASE WHEN sum(bought) OVER w > 0 THEN sum(paid) OVER w / sum(bought) OVER w END AS avg_cost FROM dt WINDOW w AS (PARTITION BY run_id, symbol ORDER BY date))"""


def _holdings(spark, sf):
    return ac.holdings_from_trades(v.v_trade(spark, sf), ["run_id", "symbol"])


@query("holdings_from_trades", f"WITH {SQL_HOLD} SELECT run_id, symbol, date, shares, round(avg_cost::DECIMAL(28, 8), 6)::DOUBLE AS avg_cost FROM hold")
def holdings_from_trades(spark, sf):
    return _holdings(spark, sf).withColumn("avg_cost", settled_round(F.col("avg_cost")))


@query("apply_split_to_holdings", f"WITH {SQL_HOLD}, sp AS (SELECT symbol, ex_date AS date, product(1 + floor(amount))::DOUBLE AS r FROM v_payout GROUP BY 1, 2) SELECT run_id, symbol, date, CAST(floor(shares * coalesce(r, 1)) AS BIGINT) AS shares, round((avg_cost / coalesce(r, 1))::DECIMAL(28, 8), 6)::DOUBLE AS avg_cost FROM hold LEFT JOIN sp USING (symbol, date)")
def apply_split_to_holdings(spark, sf):
    splits = v.v_payout(spark, sf).select("symbol", "ex_date", F.lit("split").alias("kind"), (1 + F.floor("amount")).cast("double").alias("ratio"))
    return ac.apply_split_to_holdings(_holdings(spark, sf), splits).withColumn("avg_cost", settled_round(F.col("avg_cost")))


@query("dividend_cash", f"WITH {SQL_HOLD}, dv AS (SELECT symbol, ex_date, sum(amount) AS amount FROM v_payout GROUP BY 1, 2), ow AS (SELECT DISTINCT run_id, symbol FROM hold), c AS (SELECT * FROM dv JOIN ow USING (symbol)) "
       "SELECT c.run_id, c.symbol, c.ex_date, h.shares, round(h.shares * c.amount, 4) AS cash FROM c ASOF JOIN hold h ON c.run_id = h.run_id AND c.symbol = h.symbol AND c.ex_date > h.date WHERE h.shares > 0")
def dividend_cash(spark, sf):
    out = ac.dividend_cash(_holdings(spark, sf), v.v_payout(spark, sf), ["run_id", "symbol"])
    return out.select("run_id", "symbol", "ex_date", "shares", rounded(F.col("cash"), 4).alias("cash"))


SQL_FXD = "fxd AS (SELECT d.date, coalesce(f.cny_per_hkd, (SELECT arg_min(cny_per_hkd, date) FROM v_fx)) AS fx FROM (SELECT DISTINCT date FROM v_bar) d ASOF LEFT JOIN v_fx f ON d.date >= f.date)"
SQL_POS = f"{SQL_FXD}, pos AS (SELECT 'r' || volume % 2 AS run_id, b.date, symbol, volume AS shares, volume * close AS loc, volume * close * CASE WHEN symbol LIKE '%.HK' THEN fx ELSE 1 END AS base FROM v_bar b JOIN fxd USING (date))"


def _positions(spark, sf):
    return v.v_bar(spark, sf).select(F.concat(F.lit("r"), (F.col("volume") % 2).cast("string")).alias("run_id"), "date", "symbol", F.col("volume").alias("shares"))


@query("mark_to_market", f"WITH {SQL_POS}, d AS (SELECT DISTINCT run_id, date FROM pos) SELECT run_id, date, round((1000 + sum(base))::DECIMAL(28, 8), 6)::DOUBLE AS nav FROM d JOIN pos USING (run_id, date) GROUP BY 1, 2")
def mark_to_market(spark, sf):
    p = _positions(spark, sf)
    cash = p.select("run_id", "date").distinct().withColumn("cash_base", F.lit(1000.0))
    return ac.mark_to_market(p, v.v_bar(spark, sf), v.v_fx(spark, sf), cash, ["run_id"]).withColumn("nav", settled_round(F.col("nav")))


@query("final_positions", f"WITH {SQL_POS} SELECT run_id, date, symbol, shares, round(loc, 3) AS mkt_value_local, round(base, 3) AS mkt_value_base FROM pos p WHERE date = (SELECT max(date) FROM pos q WHERE q.run_id = p.run_id)")
def final_positions(spark, sf):
    last = ac.final_positions(_positions(spark, sf), ["run_id"])
    out = ac.position_values(last, v.v_bar(spark, sf), v.v_fx(spark, sf))
    return out.select("run_id", "date", "symbol", "shares", F.round("mkt_value_local", 3).alias("mkt_value_local"), F.round("mkt_value_base", 3).alias("mkt_value_base"))


@query("cash_in_base", f"WITH {SQL_FXD} SELECT run_id, date, round(nav * 0.25 + nav * 0.75 * fx, 2) AS cash_base FROM v_nav JOIN (SELECT d.date, coalesce(f.cny_per_hkd, (SELECT arg_min(cny_per_hkd, date) FROM v_fx)) AS fx FROM (SELECT DISTINCT date FROM v_nav) d ASOF LEFT JOIN v_fx f ON d.date >= f.date) USING (date)")
def cash_in_base(spark, sf):
    cash = v.v_nav(spark, sf).select("run_id", "date", (F.col("nav") * 0.25).alias("CNY"), (F.col("nav") * 0.75).alias("HKD"))
    return ac.cash_in_base(cash, v.v_fx(spark, sf)).select("run_id", "date", F.round("cash_base", 2).alias("cash_base"))


@query("weights_to_returns", """WITH mb AS (SELECT CAST(last_day(date) AS DATE) AS date, symbol, sum(volume) AS vol FROM v_bar GROUP BY 1, 2), w AS (SELECT date, symbol, vol / sum(vol) OVER (PARTITION BY date) AS weight FROM mb),
    r AS (SELECT date, symbol, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS ret FROM v_bar), d AS (SELECT x.date, y.date AS rb FROM (SELECT DISTINCT date FROM v_bar) x ASOF JOIN (SELECT DISTINCT date FROM w) y ON x.date > y.date)
    SELECT r.date, round(sum(weight * ret), 6) AS ret FROM r JOIN d USING (date) JOIN w ON w.date = d.rb AND w.symbol = r.symbol GROUP BY 1""")
def weights_to_returns(spark, sf):
    from tidemark.operators import timeseries as ts, weights as wt
    bars = v.v_bar(spark, sf)
    vol = bars.groupBy(F.last_day("date").alias("date"), "symbol").agg(F.sum("volume").cast("double").alias("cap"))
    w = wt.weight_mcap(vol, "cap").select("date", "symbol", "weight")
    return ac.weights_to_returns(w, ts.simple_returns(bars).select("date", "symbol", "ret")).withColumn("ret", rounded(F.col("ret")))
