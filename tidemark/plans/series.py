"""Queries over bars: adjustment, returns, resampling, calendars and as-of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import joins, timeseries as ts
from tidemark.plans import views as v
from tidemark.plans.registry import query


def _actions(spark, sf):
    k = F.col("k")
    return v.v_action(spark, sf).select(
        "symbol", "ex_date", "kind", "action_id",
        F.when(F.col("kind") == "cash_dividend", k / 1000.0).alias("amount"),
        F.when(F.col("kind") == "split", (1.0 + k % 3)).alias("ratio"),
    )


SQL_ACTIONS = """acts AS (SELECT symbol, ex_date, kind, action_id,
      CASE WHEN kind = 'cash_dividend' THEN k / 1000.0::DOUBLE END AS amount,
      CASE WHEN kind = 'split' THEN 1.0::DOUBLE + k % 3 END AS ratio FROM v_action),
  factors AS (SELECT a.symbol, a.ex_date, a.kind, a.action_id, p.close AS base_close,
      CASE WHEN kind = 'cash_dividend' THEN (p.close - a.amount) / p.close ELSE 1 / a.ratio END AS hfq_factor,
      CASE WHEN kind = 'cash_dividend' THEN 1 + a.amount / p.close ELSE 1.0 END AS tr_factor
    FROM acts a ASOF JOIN v_px p ON a.symbol = p.symbol AND a.ex_date > p.date WHERE p.close > 0)"""


@query("action_factors", f"""WITH {SQL_ACTIONS} SELECT symbol, ex_date, kind, action_id,
    round(hfq_factor, 6) AS hfq_factor, round(tr_factor, 6) AS tr_factor FROM factors""")
def action_factors(spark, sf):
    out = ts.action_factors(_actions(spark, sf), v.v_px(spark, sf))
    return out.select("symbol", "ex_date", "kind", "action_id",
                      rounded(F.col("hfq_factor")).alias("hfq_factor"), rounded(F.col("tr_factor")).alias("tr_factor"))


@query("asof_strict_before", """SELECT a.action_id, a.symbol, a.ex_date, p.date AS price_date, p.close AS base_close
    FROM v_action a ASOF LEFT JOIN v_px p ON a.symbol = p.symbol AND a.ex_date > p.date""")
def asof_strict_before(spark, sf):
    closes = v.v_px(spark, sf).select("symbol", F.col("date").alias("price_date"), F.col("close").alias("base_close"))
    acts = v.v_action(spark, sf).select("action_id", "symbol", "ex_date")
    return joins.asof_join(acts, closes, ["symbol"], "ex_date", "price_date", strict=True)


def _adjusted(spark, sf):
    bars = v.v_px(spark, sf)
    return ts.adjust_prices(bars, ts.action_factors(_actions(spark, sf), bars))


@query("close_hfq", f"""WITH {SQL_ACTIONS} SELECT b.date, b.symbol,
      round(b.close * coalesce(product(f.hfq_factor), 1), 6) AS close_hfq
    FROM v_px b LEFT JOIN factors f ON f.symbol = b.symbol AND f.ex_date > b.date GROUP BY b.date, b.symbol, b.close""")
def close_hfq(spark, sf):
    return _adjusted(spark, sf).select("date", "symbol", rounded(F.col("close_hfq")).alias("close_hfq"))


@query("total_return", f"""WITH {SQL_ACTIONS} SELECT b.date, b.symbol,
      round(b.close * coalesce(product(f.tr_factor), 1), 6) AS total_return
    FROM v_px b LEFT JOIN factors f ON f.symbol = b.symbol AND f.ex_date <= b.date GROUP BY b.date, b.symbol, b.close""")
def total_return(spark, sf):
    return _adjusted(spark, sf).select("date", "symbol", rounded(F.col("total_return")).alias("total_return"))


@query("prev_close", """SELECT date, symbol, close,
    coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) AS prev_close FROM v_bar""")
def prev_close(spark, sf):
    return ts.prev_close(v.v_bar(spark, sf)).select("date", "symbol", "close", "prev_close")


SQL_LIMITS = """lagged AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM v_bar),
  banded AS (SELECT *, coalesce(before, close) AS pc, CASE WHEN regexp_matches(symbol, '^(300|688)') THEN 0.2::DOUBLE
      WHEN volume % 10 = 0 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS pct FROM lagged),
  limits AS (SELECT date, symbol, high, low, before,
      CASE WHEN symbol LIKE '%.HK' THEN 1e9 ELSE CAST(round(CAST(pc * (1 + pct) AS DECIMAL(20, 6)), 2) AS DOUBLE) END AS limit_up,
      CASE WHEN symbol LIKE '%.HK' THEN 0.0 ELSE CAST(round(CAST(pc * (1 - pct) AS DECIMAL(20, 6)), 2) AS DOUBLE) END AS limit_down FROM banded)"""


def _limits(spark, sf):
    return ts.daily_limits(v.v_bar(spark, sf).withColumn("is_st", F.col("volume") % 10 == 0))


@query("daily_limits", f"WITH {SQL_LIMITS} SELECT date, symbol, limit_up, limit_down FROM limits")
def daily_limits(spark, sf):
    return _limits(spark, sf).select("date", "symbol", "limit_up", "limit_down")


@query("hit_limits", f"""WITH {SQL_LIMITS} SELECT date, symbol, before IS NOT NULL AND high >= limit_up - 0.01::DOUBLE AS hit_limit_up,
      before IS NOT NULL AND low <= limit_down + 0.01::DOUBLE AS hit_limit_down FROM limits""")
def hit_limits(spark, sf):
    return _limits(spark, sf).select("date", "symbol", "hit_limit_up", "hit_limit_down")


@query("simple_returns", """SELECT date, symbol,
    round(coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0), 6) AS ret FROM v_bar""")
def simple_returns(spark, sf):
    return ts.simple_returns(v.v_bar(spark, sf)).select("date", "symbol", rounded(F.col("ret")).alias("ret"))


@query("log_returns", """SELECT date, symbol,
    round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)), 6) AS log_ret FROM v_bar""")
def log_returns(spark, sf):
    return ts.log_returns(v.v_bar(spark, sf)).select("date", "symbol", rounded(F.col("log_ret")).alias("log_ret"))


@query("forward_log_return", """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx
      FROM (SELECT DISTINCT date FROM v_bar)),
    p AS (SELECT symbol, date, idx, close FROM v_bar JOIN cal USING (date))
    SELECT a.date, a.symbol, h.horizon, round(ln(b.close / a.close), 6) AS fwd
    FROM p a CROSS JOIN (VALUES (1), (5), (20)) h(horizon)
    JOIN p b ON b.symbol = a.symbol AND b.idx = a.idx + h.horizon WHERE a.close > 0 AND b.close > 0""")
def forward_log_return(spark, sf):
    out = ts.forward_log_return(v.v_bar(spark, sf), [1, 5, 20])
    return out.withColumn("fwd", rounded(F.col("fwd")))


SQL_PERIOD = {
    "M": "CAST(last_day(date) AS DATE)",
    "W": "date + CAST((12 - isodow(date)) % 7 AS INTEGER)",
    "Q": "CAST(last_day(date_trunc('quarter', date)::DATE + INTERVAL 2 MONTH) AS DATE)",
}


def _resample(freq):
    sql = f"""SELECT {SQL_PERIOD[freq]} AS date, symbol, first(open ORDER BY date) AS open, max(high) AS high,
        min(low) AS low, last(close ORDER BY date) AS close, CAST(sum(volume) AS BIGINT) AS volume,
        round(sum(amount), 2) AS amount FROM v_bar GROUP BY 1, 2"""

    def run(spark, sf):
        return ts.resample_ohlcv(v.v_bar(spark, sf), freq).withColumn("amount", F.round("amount", 2))

    return run, sql


for _freq, _name in (("M", "resample_ohlcv"), ("W", "resample_ohlcv_week"), ("Q", "resample_ohlcv_quarter")):
    _fn, _sql = _resample(_freq)
    query(_name, _sql)(_fn)


@query("resample_spine", """WITH m AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS m, last(close ORDER BY date) AS close,
       max(high) AS high FROM v_bar GROUP BY 1, 2),
    spine AS (SELECT symbol, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM m GROUP BY symbol)
    SELECT s.symbol, CAST(last_day(s.m) AS DATE) AS date, close, high FROM spine s LEFT JOIN m ON m.symbol = s.symbol AND m.m = s.m""")
def resample_spine(spark, sf):
    return ts.resample_ohlcv(v.v_bar(spark, sf), "M", fill_empty=True).select("symbol", "date", "close", "high")


@query("merge_calendars", """SELECT DISTINCT date FROM v_calendar WHERE is_trading_day AND exchange IN ('SH', 'HK')
    UNION SELECT DISTINCT date FROM v_bar""")
def merge_calendars(spark, sf):
    cal = v.v_calendar(spark, sf)
    open_days = v.v_bar(spark, sf).select("date", F.lit(True).alias("is_trading_day"))
    return ts.merge_calendars(cal.where("exchange = 'SH'"), cal.where("exchange = 'HK'"), open_days)


@query("period_end_trading_days", f"""SELECT {SQL_PERIOD['W']} AS period, max(date) AS date
    FROM (SELECT DISTINCT date FROM v_calendar WHERE is_trading_day AND exchange = 'SH') GROUP BY 1""")
def period_end_trading_days(spark, sf):
    days = v.v_calendar(spark, sf).where("is_trading_day AND exchange = 'SH'").select("date")
    return ts.period_end_trading_days(days, "W")


SQL_NTH = """idx AS (SELECT exchange, date, row_number() OVER (PARTITION BY exchange ORDER BY date) AS i
      FROM v_calendar WHERE is_trading_day),
    ends AS (SELECT exchange, max(i) AS last_i FROM idx GROUP BY exchange),
    t AS (SELECT *, split_part(symbol, '.', 2) AS exchange FROM v_trade),
    placed AS (SELECT t.*, coalesce(x.i, 0) AS at FROM t ASOF LEFT JOIN idx x ON t.exchange = x.exchange AND t.exec_date >= x.date),
    found AS (SELECT p.*, greatest(coalesce(y.date, p.exec_date), p.exec_date) AS target
      FROM placed p JOIN ends e ON p.exchange = e.exchange
      LEFT JOIN idx y ON y.exchange = p.exchange AND y.i = least(p.at + {n}, e.last_i))"""


def _trades(spark, sf):
    return v.v_trade(spark, sf).withColumn("exchange", F.substring_index("symbol", ".", -1))


@query("nth_trading_day_after", "WITH " + SQL_NTH.format(n="5") + " SELECT exec_date, exchange, target, count(*) AS n_trades FROM found GROUP BY ALL")
def nth_trading_day_after(spark, sf):
    days = _trades(spark, sf).groupBy("exchange", "exec_date").agg(F.count(F.lit(1)).alias("n_trades"))
    return ts.nth_trading_day_after(days, v.v_calendar(spark, sf), "exec_date", F.lit(5), "target")


@query("settlement_lock", "WITH " + SQL_NTH.format(n="CASE p.exchange WHEN 'HK' THEN 2 ELSE 1 END")
       + " SELECT exec_date, symbol, side, shares, notional, target AS locked_until FROM found WHERE side = 'buy'")
def settlement_lock(spark, sf):
    out = ts.settlement_lock(_trades(spark, sf).where("side = 'buy'"), v.v_calendar(spark, sf))
    return out.select("exec_date", "symbol", "side", "shares", "notional", "locked_until")


@query("weekday_spine", """SELECT symbol, CAST(d AS DATE) AS date FROM (SELECT symbol,
      unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM v_px GROUP BY symbol)
    WHERE isodow(d) < 6""")
def weekday_spine(spark, sf):
    spans = v.v_px(spark, sf).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ts.date_spine(spans, "a", "b", "B").select("symbol", "date")


@query("month_end_spine", """SELECT symbol, CAST(last_day(d) AS DATE) AS date FROM (SELECT symbol, min(date) AS a, max(date) AS b,
      unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS d FROM v_bar GROUP BY symbol)
    WHERE last_day(d) BETWEEN a AND b""")
def month_end_spine(spark, sf):
    spans = v.v_bar(spark, sf).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ts.date_spine(spans, "a", "b", "M").select("symbol", "date")


SQL_GRID = """days AS (SELECT symbol, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
      FROM v_px GROUP BY symbol),
    grid AS (SELECT d.symbol, d.date, p.close FROM days d LEFT JOIN v_px p USING (symbol, date))"""


@query("max_null_run", f"""WITH {SQL_GRID}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM grid),
    runs AS (SELECT symbol, rn - row_number() OVER (PARTITION BY symbol ORDER BY date) AS run FROM numbered WHERE close IS NULL),
    lens AS (SELECT symbol, run, count(*) AS n FROM runs GROUP BY 1, 2)
    SELECT s.symbol, coalesce(max(n), 0) AS max_null_run FROM (SELECT DISTINCT symbol FROM grid) s LEFT JOIN lens USING (symbol) GROUP BY 1""")
def max_null_run(spark, sf):
    px = v.v_px(spark, sf)
    spans = px.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = spans.select("symbol", F.explode(F.sequence("a", "b")).alias("date"))
    return ts.max_null_run(grid.join(px.select("symbol", "date", "close"), ["symbol", "date"], "left"), ["symbol"], "close")


@query("benchmark_curve", """WITH base AS (SELECT run_id, arg_min(nav, date) AS b FROM v_nav GROUP BY 1),
    days AS (SELECT r.run_id, d.date FROM base r, (SELECT DISTINCT date FROM v_calendar WHERE is_trading_day) d),
    al AS (SELECT d.run_id, d.date, n.nav / base.b AS raw FROM days d JOIN base USING (run_id) LEFT JOIN v_nav n USING (run_id, date)),
    f AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ff FROM al)
    SELECT run_id, date, round(coalesce(first_value(ff IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY date
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS benchmark FROM f""")
def benchmark_curve(spark, sf):
    nav = v.v_nav(spark, sf)
    calendar = v.v_calendar(spark, sf).where("is_trading_day").select("date").distinct()
    runs = nav.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).drop("n")
    days = calendar.agg(F.collect_list("date").alias("days"))
    spine = runs.withColumn("date", F.explode(days.scalar()))
    return ts.benchmark_curve(nav, spine, ["run_id"]).select("run_id", "date", rounded(F.col("benchmark")).alias("benchmark"))


SQL_PREMIUM = """premium AS (SELECT * FROM (SELECT a.date, p.a AS symbol_a, p.h AS symbol_h, a.close AS close_a, h.close AS close_h
      FROM v_pair p JOIN v_bar a ON a.symbol = p.a JOIN v_bar h ON h.symbol = p.h AND h.date = a.date WHERE p.h IS NOT NULL) j
      ASOF JOIN (SELECT date AS fx_date, cny_per_hkd FROM v_fx) f ON j.date >= f.fx_date)"""


def premium(spark, sf):
    from tidemark.operators.pit import ah_premium

    return ah_premium(v.v_pair(spark, sf), v.v_bar(spark, sf), v.v_fx(spark, sf))


@query("ah_premium", f"""WITH {SQL_PREMIUM} SELECT date, symbol_a, symbol_h,
    round(close_a / (close_h * cny_per_hkd) - 1, 6) AS premium FROM premium""")
def ah_premium(spark, sf):
    return premium(spark, sf).select("date", "symbol_a", "symbol_h", rounded(F.col("premium")).alias("premium"))


@query("join_on_date", """SELECT a.date, p.a AS symbol_a, p.h AS symbol_h, a.close AS close_a, h.close AS close_h
    FROM v_pair p JOIN v_bar a ON a.symbol = p.a JOIN v_bar h ON h.symbol = p.h AND h.date = a.date""")
def join_on_date(spark, sf):
    from tidemark.operators.pit import pair_closes

    return pair_closes(v.v_pair(spark, sf), v.v_bar(spark, sf))


@query("asof_backward", """SELECT b.date, b.symbol, f.date AS fx_date, round(f.cny_per_hkd, 6) AS cny_per_hkd
    FROM v_bar b ASOF LEFT JOIN v_fx f ON b.date >= f.date""")
def asof_backward(spark, sf):
    fx = v.v_fx(spark, sf).select(F.col("date").alias("fx_date"), rounded(F.col("cny_per_hkd")).alias("cny_per_hkd"))
    return joins.asof_join(v.v_bar(spark, sf).select("date", "symbol"), fx, [], "date", "fx_date")


@query("asof_with_first_fallback", """SELECT b.date, b.symbol, round(coalesce(f.cny_per_hkd, (SELECT arg_min(cny_per_hkd, date) FROM v_fx)), 6) AS cny_per_hkd
    FROM v_bar b ASOF LEFT JOIN v_fx f ON b.date >= f.date""")
def asof_with_first_fallback(spark, sf):
    fx = v.v_fx(spark, sf).select(F.col("date").alias("fx_date"), "cny_per_hkd")
    bars = v.v_bar(spark, sf).select("date", "symbol")
    out = joins.asof_with_first_fallback(bars, fx, [], "date", "fx_date", "cny_per_hkd")
    return out.withColumn("cny_per_hkd", rounded(F.col("cny_per_hkd")))


@query("rolling_zscore", """WITH z AS (SELECT date, symbol, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s
      FROM v_bar WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT date, symbol, CASE WHEN n >= 30 AND s >= 1e-10 THEN round((close - m) / s, 6) END AS zscore FROM z""")
def rolling_zscore(spark, sf):
    out = ts.rolling_zscore(v.v_bar(spark, sf), "close", ["symbol"], 60)
    return out.select("date", "symbol", rounded(F.col("zscore")).alias("zscore"))
