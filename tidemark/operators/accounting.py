"""Portfolio accounting as table operators: orders, eligibility, fills, holdings, valuation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join, asof_on_axis, asof_with_first_fallback
from tidemark.session import settle

# Rates per venue group (commission, floor, stamp on buys, stamp on sells, transfer, exchange fee).
COST_RATES = {
    "CN": (0.00025, 5.0, 0.0, 0.0005, 0.00001, 0.0000341),
    "HK": (0.002, 50.0, 0.001, 0.001, 0.000265, 0.0000565),
}
SLIPPAGE_BPS = {"CN": 5.0, "HK": 10.0}
LOT_SIZE = 100


def slippage_bps(symbol: Column) -> Column:
    return F.when(symbol.endswith(".HK"), F.lit(SLIPPAGE_BPS["HK"])).otherwise(F.lit(SLIPPAGE_BPS["CN"]))


def _rate(symbol: Column, i: int) -> Column:
    return F.when(symbol.endswith(".HK"), F.lit(COST_RATES["HK"][i])).otherwise(F.lit(COST_RATES["CN"][i]))


def is_sale(side: Column) -> Column:
    return side.isin("sell", "short")


def stamp_rate(symbol: Column, side: Column) -> Column:
    return F.when(is_sale(side), _rate(symbol, 3)).otherwise(_rate(symbol, 2))


def cost_breakdown(trades: DataFrame) -> DataFrame:
    """Commission (with its floor), stamp duty by side, transfer and exchange fee of each trade."""
    s, n = F.col("symbol"), F.col("notional")
    return trades.withColumns({
        "commission": F.greatest(n * _rate(s, 0), _rate(s, 1)),
        "stamp_duty": n * stamp_rate(s, F.col("side")),
        "transfer_fee": n * _rate(s, 4),
        "exchange_fee": n * _rate(s, 5),
    })


def total_cost(symbol: Column, side: Column, notional: Column) -> Column:
    rest = stamp_rate(symbol, side) + _rate(symbol, 4) + _rate(symbol, 5)
    return F.greatest(notional * _rate(symbol, 0), _rate(symbol, 1)) + notional * rest


def slippage_price(base: Column, side: Column, bps: Column) -> Column:
    sign = F.when(is_sale(side), F.lit(-1.0)).otherwise(F.lit(1.0))
    return base * (1 + sign * bps / 10000)


def base_fill_price(mode: str) -> Column:
    if mode == "vwap":
        return F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")).otherwise(F.col("open"))
    return F.col(mode)


def round_to_lot(shares: Column, is_buy: Column, lot: Column) -> Column:
    lots = shares / lot
    return F.when(is_buy, F.floor(lots)).otherwise(F.ceil(lots)).cast("bigint") * lot


def affordable_shares(cash: Column, price: Column, symbol: Column, side: Column, lot: Column) -> Column:
    """Largest whole number of lots whose notional plus costs fits the cash.

    Cost is the greater of two linear functions of the shares, so the answer is the lesser of two bounds.
    """
    other = stamp_rate(symbol, side) + _rate(symbol, 4) + _rate(symbol, 5)
    by_rate = cash / (price * (1 + other + _rate(symbol, 0)))
    by_floor = (cash - _rate(symbol, 1)) / (price * (1 + other))
    return F.greatest(F.floor(F.least(by_rate, by_floor) / lot), F.lit(0)).cast("bigint") * lot


def order_side(current: Column, target: Column) -> Column:
    diff = target - current
    return (
        F.when(diff > 0, F.when(current < 0, "cover").otherwise("buy"))
        .when(diff < 0, F.when(current > 0, "sell").otherwise("short"))
    )


def rebalance_orders(targets: DataFrame, holdings: DataFrame, lot: int = LOT_SIZE) -> DataFrame:
    """Orders from target weights and holdings, keyed (run_id, date, symbol).

    `targets` has weight, nav, price, fx; rows without a price or with a price of zero are left alone
    (their holding too); holdings outside the targets are closed.
    """
    t = targets.withColumn("_target", F.lit(True))
    h = holdings.select("run_id", "date", "symbol", F.col("shares").alias("held"))
    both = t.join(h, ["run_id", "date", "symbol"], "full_outer")
    held = F.coalesce(F.col("held"), F.lit(0))
    raw = F.abs(F.col("nav") * F.col("weight") / (F.col("price") * F.col("fx")))
    magnitude = round_to_lot(raw, F.col("weight") >= 0, F.lit(lot))
    goal = F.when(F.col("_target"), F.when(F.col("weight") < 0, -magnitude).otherwise(magnitude)).otherwise(F.lit(0))
    usable = F.col("_target").isNull() | F.coalesce(F.col("price") > 0, F.lit(False))
    return (
        both.where(usable)
        .select("run_id", "date", "symbol", held.alias("held"), goal.alias("target"))
        .where(F.col("held") != F.col("target"))
        .select(
            "run_id", "date", "symbol", order_side(F.col("held"), F.col("target")).alias("side"),
            F.abs(F.col("target") - F.col("held")).alias("shares"),
        )
    )


def order_eligibility(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """First rule that stops each order on its day, and whether it is tried again; NULL reason may fill.

    `orders` has locked_until; `bars` has the suspension and limit flags.
    """
    flags = bars.select("date", "symbol", "is_suspended", "hit_limit_up", "hit_limit_down", F.lit(True).alias("_bar"))
    side, d = F.col("side"), F.col("date")
    reason = (
        F.when(F.col("_bar").isNull(), "no_price_bar")
        .when(F.col("is_suspended"), "suspended")
        .when(side.isin("buy", "cover") & F.col("hit_limit_up"), "limit_up")
        .when(side.isin("sell", "short") & F.col("hit_limit_down"), "limit_down")
        .when(side.isin("sell", "cover") & F.coalesce(d <= F.col("locked_until"), F.lit(False)), "T+N lock")
        .when((side == "short") & ~F.col("symbol").endswith(".HK"), "a_share_short_disallowed")
    )
    out = orders.join(flags, ["date", "symbol"], "left").withColumn("reason", reason)
    retry = F.coalesce(F.col("reason").isin("suspended", "limit_up", "limit_down"), F.lit(False))
    return out.withColumn("retry", retry).drop("_bar", "is_suspended", "hit_limit_up", "hit_limit_down")


def price_fills(orders: DataFrame, bars: DataFrame, mode: str = "close") -> DataFrame:
    base = bars.select("date", "symbol", base_fill_price(mode).alias("_base"))
    out = orders.join(base, ["date", "symbol"])
    out = out.withColumn("fill_price", slippage_price(F.col("_base"), F.col("side"), slippage_bps(F.col("symbol")))).drop("_base")
    out = out.withColumn("notional", F.col("fill_price") * F.col("shares"))
    return out.withColumn("cost_total", total_cost(F.col("symbol"), F.col("side"), F.col("notional")))


def daily_trades(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades of a key folded per day before anything is ordered: a busy key shrinks to its calendar."""
    buys = F.col("side").isin("buy", "cover")
    signed = F.when(buys, F.col("shares")).otherwise(-F.col("shares"))
    return trades.groupBy(*keys, F.col("exec_date").alias("date")).agg(
        F.sum(signed).alias("_net"),
        F.sum(F.when(buys, F.col("shares")).otherwise(0)).alias("_bought"),
        F.sum(F.when(buys, F.col("notional")).otherwise(0.0)).alias("_paid"),
    )


def holdings_from_trades(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Signed shares and average purchase price per key after each day with trades."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.sum("_bought").over(w)
    return daily_trades(trades, keys).select(
        *keys, "date", F.sum("_net").over(w).alias("shares"),
        F.when(bought > 0, F.sum("_paid").over(w) / bought).alias("avg_cost"),
    )


def apply_split_to_holdings(holdings: DataFrame, actions: DataFrame) -> DataFrame:
    """Holdings after the splits of their day: whole shares, cost per share scaled the other way.

    Ratios are shares after per share before; a stock dividend of r counts as 1 + r.
    """
    grow = F.when(F.col("kind") == "stock_dividend", 1 + F.col("ratio")).otherwise(F.col("ratio"))
    splits = actions.where(F.col("kind").isin("split", "reverse_split", "stock_dividend")).groupBy(
        "symbol", F.col("ex_date").alias("date")
    ).agg(F.product(grow).alias("_r"))
    out = holdings.join(splits, ["symbol", "date"], "left")
    r = F.coalesce(F.col("_r"), F.lit(1.0))
    return out.withColumn("shares", F.floor(F.col("shares") * r).cast("bigint")).withColumn(
        "avg_cost", F.col("avg_cost") / r
    ).drop("_r")


def dividend_cash(holdings: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Cash paid on each ex-date on the shares held strictly before it."""
    cash = actions.where(F.col("kind") == "cash_dividend").groupBy("symbol", "ex_date").agg(F.sum("amount").alias("amount"))
    held = settle(holdings.select(*keys, F.col("date").alias("_held_on"), "shares"))  # read for its owners too
    if any(k != "symbol" for k in keys):
        cash = cash.join(held.select(*keys).distinct(), "symbol")
    out = asof_on_axis(cash, held, keys, "ex_date", "_held_on", how="inner", strict=True)
    return out.where(F.col("shares") > 0).withColumn("cash", F.col("shares") * F.col("amount")).drop("_held_on")


def fx_of(symbol: Column, rate: Column) -> Column:
    return F.when(symbol.endswith(".HK"), rate).otherwise(F.lit(1.0))


def position_values(positions: DataFrame, bars: DataFrame, fx: DataFrame) -> DataFrame:
    """Local and base value of every position that has a bar on its day."""
    priced = positions.join(bars.select("date", "symbol", "close"), ["date", "symbol"])
    rates = fx.select(F.col("date").alias("_fx_date"), "cny_per_hkd")
    out = asof_with_first_fallback(priced, rates, [], "date", "_fx_date", "cny_per_hkd")
    local = F.col("shares") * F.col("close")
    return out.withColumn("mkt_value_local", local).withColumn(
        "mkt_value_base", local * fx_of(F.col("symbol"), F.col("cny_per_hkd"))
    )


def mark_to_market(positions: DataFrame, bars: DataFrame, fx: DataFrame, cash_base: DataFrame, keys: list[str]) -> DataFrame:
    """NAV per (keys, date): base cash plus signed base values."""
    held = position_values(positions, bars, fx).groupBy(*keys, "date").agg(F.sum("mkt_value_base").alias("_held"))
    return cash_base.join(held, [*keys, "date"], "left").select(
        *keys, "date", (F.col("cash_base") + F.coalesce(F.col("_held"), F.lit(0.0))).alias("nav")
    )


def cash_in_base(cash: DataFrame, fx: DataFrame) -> DataFrame:
    """Base value of (keys, date, CNY, HKD) balances."""
    rates = fx.select(F.col("date").alias("_fx_date"), "cny_per_hkd")
    out = asof_with_first_fallback(cash, rates, [], "date", "_fx_date", "cny_per_hkd")
    return out.withColumn("cash_base", F.col("CNY") + F.col("HKD") * F.col("cny_per_hkd"))


def final_positions(positions: DataFrame, keys: list[str]) -> DataFrame:
    last = positions.groupBy(*keys).agg(F.max("date").alias("date"))
    return positions.join(last, [*keys, "date"], "left_semi")


def weights_to_returns(weights: DataFrame, returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gross portfolio return per date: weights of the last rebalance strictly before it times the day's returns.

    Rebalance dates are few, so the date is resolved first and the weights meet by equality. With `keys`, each run has its own
    rebalances, all in one plan. Returns may carry only some of the keys, or none: runs that share them meet the same rows, which
    are not copied per run, and a run keeps the sums of its own rebalances.
    """
    keys = list(keys)
    shared = [k for k in keys if k in returns.columns]
    rebalances = settle(weights.select(*keys, F.col("date").alias("rebalance")).distinct())
    days = settle(returns.select(*shared, "date").distinct())
    if shared != keys:
        runs = rebalances.select(*keys).distinct()
        days = days.join(runs, shared) if shared else days.crossJoin(runs)
    at = asof_join(days, rebalances, keys, "date", "rebalance", how="inner", strict=True)
    at = settle(at.select(*keys, "date", "rebalance"))  # one row per run and day
    w = weights.select(*keys, F.col("date").alias("rebalance"), "symbol", "weight")
    met = returns.join(F.broadcast(at.select(*shared, "date", "rebalance").distinct()), [*shared, "date"])
    sums = met.join(w, [*shared, "rebalance", "symbol"]).groupBy(*keys, "date", "rebalance").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    return sums.join(at, [*keys, "date", "rebalance"], "left_semi").select(*keys, "date", "ret")
