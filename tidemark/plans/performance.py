"""Queries of run metrics, splits and verification checks."""

from __future__ import annotations

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import metrics as mt
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.session import settle

KEYS = ["run_id"]
SQL_RET = """rt AS (SELECT run_id, date, nav, ln(nav / lag(nav) OVER (PARTITION BY run_id ORDER BY date)) AS ret FROM v_nav),
    dd AS (SELECT *, max(nav) OVER (PARTITION BY run_id ORDER BY date) AS peak FROM v_nav),
    wd AS (SELECT run_id, min((nav - peak) / peak) AS mdd, arg_min(date, ((nav - peak) / peak, date)) AS trough FROM dd GROUP BY 1),
    pk AS (SELECT w.run_id, any_value(mdd) AS mdd, any_value(trough) AS trough, arg_max(n.date, (n.nav, -epoch(n.date))) AS peak FROM wd w JOIN v_nav n ON n.run_id = w.run_id AND n.date <= w.trough GROUP BY 1)"""
YEARS = "(date_diff('day', min(date), max(date)) / 365.25)"
CAGR = f"pow(arg_max(nav, date) / arg_min(nav, date), 1 / {YEARS}) - 1"


def _ret(spark, sf):
    return mt.log_curve(v.v_nav(spark, sf), KEYS)


def _metric(name, column, sql, digits=6, source=_ret):
    @query(name, f"WITH {SQL_RET} SELECT run_id, round({sql}, {digits}) AS value FROM rt GROUP BY 1")
    def run(spark, sf):
        return source(spark, sf).groupBy("run_id").agg(rounded(column(), digits).alias("value"))


_metric("cagr", mt.cagr, CAGR)
_metric("total_return_metric", mt.total_return, "arg_max(nav, date) / arg_min(nav, date) - 1")
_metric("annualized_vol", lambda: mt.annualized_vol(F.col("ret")), "stddev_samp(ret) * sqrt(252)")
_metric("sharpe", lambda: mt.sharpe(F.col("ret"), 0.02), "avg(ret - 0.02 / 252) / stddev_samp(ret - 0.02 / 252) * sqrt(252)")
_metric("sortino", lambda: mt.sortino(F.col("ret")), "avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252)")


@query("max_drawdown", f"WITH {SQL_RET} SELECT run_id, round(mdd, 6) AS max_drawdown, trough, peak, trough - peak AS drawdown_days FROM pk")
def max_drawdown(spark, sf):
    return mt.drawdown(v.v_nav(spark, sf), KEYS).withColumn("max_drawdown", rounded(F.col("max_drawdown")))


@query("running_peak_drawdown", f"WITH {SQL_RET} SELECT run_id, date, round(peak, 2) AS peak, round((nav - peak) / peak, 6) AS drawdown FROM dd")
def running_peak_drawdown(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = v.v_nav(spark, sf).withColumn("peak", F.max("nav").over(w))
    return out.select("run_id", "date", F.round("peak", 2).alias("peak"), rounded((F.col("nav") - F.col("peak")) / F.col("peak")).alias("drawdown"))


@query("calmar", f"WITH {SQL_RET}, c AS (SELECT run_id, {CAGR} AS c FROM v_nav GROUP BY 1) SELECT run_id, round(c / abs(mdd), 6) AS calmar FROM c JOIN wd USING (run_id)")
def calmar(spark, sf):
    nav = v.v_nav(spark, sf)
    out = nav.groupBy("run_id").agg(mt.cagr().alias("c")).join(mt.drawdown(nav, KEYS), "run_id")
    return out.select("run_id", rounded(mt.calmar(F.col("c"), F.col("max_drawdown"))).alias("calmar"))


def _aligned(spark, sf):
    rets = _ret(spark, sf)
    bench = mt.log_curve(rets.groupBy("date").agg(F.sum("nav").alias("nav")), [])
    return mt.align_returns(rets, bench, KEYS)


SQL_AL = SQL_RET + """, bc AS (SELECT date, ln(nav / lag(nav) OVER (ORDER BY date)) AS rb FROM (SELECT date, sum(nav) AS nav FROM v_nav GROUP BY 1)),
    al AS (SELECT run_id, date, ret AS rp, rb FROM rt JOIN bc USING (date) WHERE ret IS NOT NULL AND rb IS NOT NULL)"""


@query("align_returns", f"WITH {SQL_AL} SELECT run_id, date, round(rp, 6) AS rp, round(rb, 6) AS rb FROM al")
def align_returns(spark, sf):
    return _aligned(spark, sf).select("run_id", "date", rounded(F.col("rp")).alias("rp"), rounded(F.col("rb")).alias("rb"))


@query("information_ratio", f"WITH {SQL_AL} SELECT run_id, round(avg(rp - rb) * 252, 6) AS excess_return, round(stddev_samp(rp - rb) * sqrt(252), 6) AS tracking_error, round(avg(rp - rb) * 252 / (stddev_samp(rp - rb) * sqrt(252)), 6) AS information_ratio FROM al GROUP BY 1")
def information_ratio(spark, sf):
    out = mt.relative_metrics(_aligned(spark, sf), KEYS)
    return out.select("run_id", *[rounded(F.col(c)).alias(c) for c in ("excess_return", "tracking_error", "information_ratio")])


SQL_NW = SQL_AL + """, f AS (SELECT run_id, regr_slope(rp, rb) AS beta, regr_intercept(rp, rb) AS alpha, count(*) AS n, greatest(1, floor(4 * pow(count(*) / 100, 2 / 9))) AS lags, sum(rb) AS sx, sum(rb * rb) AS sxx FROM al GROUP BY 1),
    u AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY date) AS t, rp - alpha - beta * rb AS u, (rp - alpha - beta * rb) * rb AS v, lags FROM al JOIN f USING (run_id)),
    g AS (SELECT run_id, sum(u * u) AS g11, sum(u * v) AS g12, sum(v * v) AS g22 FROM u GROUP BY 1),
    l AS (SELECT a.run_id, sum((1 - (b.t - a.t) / (a.lags + 1)) * a.u * b.u) AS l11, sum((1 - (b.t - a.t) / (a.lags + 1)) * (a.u * b.v + a.v * b.u)) AS l12, sum((1 - (b.t - a.t) / (a.lags + 1)) * a.v * b.v) AS l22 FROM u a JOIN u b ON a.run_id = b.run_id AND b.t > a.t AND b.t - a.t <= a.lags GROUP BY 1),
    s AS (SELECT f.*, g11 + 2 * l11 AS s11, g12 + l12 AS s12, g22 + 2 * l22 AS s22, n * sxx - sx * sx AS det FROM f JOIN g USING (run_id) JOIN l USING (run_id)),
    nw AS (SELECT run_id, n, alpha, beta, lags, sqrt((sxx * sxx * s11 - 2 * sxx * sx * s12 + sx * sx * s22) / (det * det)) AS alpha_se, sqrt((sx * sx * s11 - 2 * sx * n * s12 + n * n * s22) / (det * det)) AS beta_se FROM s)"""
NW_COLS = ("alpha", "beta", "alpha_se", "beta_se", "alpha_t_stat", "beta_t_stat")


@query("newey_west", f"WITH {SQL_NW} SELECT run_id, n, lags::INTEGER AS newey_west_lag, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha_se, 6) AS alpha_se, round(beta_se, 6) AS beta_se, round(alpha / alpha_se, 4) AS alpha_t_stat, round(beta / beta_se, 4) AS beta_t_stat FROM nw")
def newey_west(spark, sf):
    out = mt.newey_west(_aligned(spark, sf), KEYS)
    return out.select("run_id", "n", "newey_west_lag", *[rounded(F.col(c), 4 if c.endswith("stat") else 6).alias(c) for c in NW_COLS])


def _run_trades(spark, sf):
    pri = F.element_at(F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.col("shares") % 5 + 1).cast("int"))
    return v.v_trade(spark, sf).withColumn("run_id", pri)


SQL_TR = "tr AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][shares % 5 + 1] AS run_id, exec_date, symbol, side, shares, notional FROM v_trade)"


@query("annualized_turnover", f"WITH {SQL_TR}, n AS (SELECT run_id, avg(nav) AS a, {YEARS} AS y FROM v_nav GROUP BY 1), t AS (SELECT run_id, sum(notional) AS s FROM tr GROUP BY 1) SELECT run_id, round(s / a / y, 5) AS turnover FROM n JOIN t USING (run_id)")
def annualized_turnover(spark, sf):
    return mt.annualized_turnover(_run_trades(spark, sf), v.v_nav(spark, sf), KEYS).withColumn("turnover", rounded(F.col("turnover"), 5))


@query("avg_positions", f"WITH {SQL_TR} SELECT run_id, round(avg(n), 6) AS avg_positions FROM (SELECT run_id, exec_date, count(symbol) AS n FROM tr GROUP BY 1, 2) GROUP BY 1")
def avg_positions(spark, sf):
    return mt.avg_positions(_run_trades(spark, sf).withColumnRenamed("exec_date", "date"), KEYS).withColumn("avg_positions", rounded(F.col("avg_positions")))


SQL_HP = "hp AS (SELECT run_id, symbol, max(exec_date) FILTER (side = 'sell') - min(exec_date) FILTER (side = 'buy') AS d FROM tr GROUP BY 1, 2)"


@query("avg_holding_period", f"WITH {SQL_TR}, {SQL_HP} SELECT run_id, round(avg(d) FILTER (d >= 0), 6) AS holding_period FROM hp GROUP BY 1")
def avg_holding_period(spark, sf):
    return mt.avg_holding_period(_run_trades(spark, sf), KEYS).withColumn("holding_period", rounded(F.col("holding_period")))


@query("avg_dividend_yield", f"WITH {SQL_TR}, n AS (SELECT run_id, avg(nav) AS a, count(*) AS c FROM v_nav GROUP BY 1), t AS (SELECT run_id, sum(notional * 0.01) AS s FROM tr GROUP BY 1) SELECT run_id, round(s / a / (c / 252), 5) AS dividend_yield FROM n JOIN t USING (run_id)")
def avg_dividend_yield(spark, sf):
    income = _run_trades(spark, sf).select("run_id", (F.col("notional") * 0.01).alias("dividend_income"))
    return mt.avg_dividend_yield(income, v.v_nav(spark, sf), KEYS).withColumn("dividend_yield", rounded(F.col("dividend_yield"), 5))


@query("metrics_bundle", f"WITH {SQL_NW}, {SQL_TR}, {SQL_HP}, m AS (SELECT run_id, {CAGR} AS cagr, stddev_samp(ret) * sqrt(252) AS vol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM rt GROUP BY 1), h AS (SELECT run_id, avg(d) FILTER (d >= 0) AS hd FROM hp GROUP BY 1), "
       "ap AS (SELECT run_id, avg(n) AS np FROM (SELECT run_id, exec_date, count(symbol) AS n FROM tr GROUP BY 1, 2) GROUP BY 1), dv AS (SELECT run_id, avg(nav) AS a, count(*) AS c FROM v_nav GROUP BY 1), di AS (SELECT run_id, sum(notional * 0.01) AS s FROM tr GROUP BY 1) "
       "SELECT run_id, round(cagr, 6) AS cagr, round(vol, 6) AS annualized_vol, round(sharpe, 6) AS sharpe, round(mdd, 6) AS max_drawdown, round(cagr / abs(mdd), 6) AS calmar, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(hd, 6) AS holding_period, round(np, 6) AS avg_positions, round(s / a / (c / 252), 5) AS dividend_yield FROM m JOIN wd USING (run_id) JOIN nw USING (run_id) JOIN h USING (run_id) JOIN ap USING (run_id) JOIN dv USING (run_id) JOIN di USING (run_id)")
def metrics_bundle(spark, sf):
    nav = v.v_nav(spark, sf)
    trades = _run_trades(spark, sf)
    income = trades.select("run_id", (F.col("notional") * 0.01).alias("dividend_income"))
    positions = trades.withColumnRenamed("exec_date", "date")
    out = mt.metrics_bundle(nav, KEYS, nav.groupBy("date").agg(F.sum("nav").alias("nav")), trades, positions, income)
    out = out.withColumn("dividend_yield", rounded(F.col("dividend_yield"), 5))
    return out.select("run_id", *[rounded(F.col(c)).alias(c) for c in ("cagr", "annualized_vol", "sharpe", "max_drawdown", "calmar", "alpha", "beta", "holding_period", "avg_positions")], "dividend_yield")


SQL_WF = """dy AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM v_nav)),
    ch AS (SELECT CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS c, min(date) AS a, max(date) AS b FROM dy GROUP BY 1),
    sp AS (SELECT c::INTEGER AS split, min(a) OVER () AS is_start, lag(b) OVER (ORDER BY c) AS is_end, a AS oos_start, b AS oos_end FROM ch)"""


def _splits(spark, sf):
    return mt.walk_forward_splits(v.v_nav(spark, sf).select("date").distinct(), 4)


@query("walk_forward_splits", f"WITH {SQL_WF} SELECT * FROM sp WHERE split > 0")
def walk_forward_splits(spark, sf):
    return _splits(spark, sf)


@query("combine_oos", f"WITH {SQL_WF}, pm AS (SELECT run_id, split, {CAGR} AS cagr, count(*) AS days FROM v_nav JOIN sp ON split > 0 AND date BETWEEN oos_start AND oos_end GROUP BY 1, 2) SELECT run_id, round(avg(cagr), 6) AS cagr, round_even(avg(days), 0)::BIGINT AS days FROM pm GROUP BY 1")
def combine_oos(spark, sf):
    per = mt.curves_by_split(v.v_nav(spark, sf), _splits(spark, sf)).groupBy("run_id", "split").agg(mt.cagr().alias("cagr"), F.count(F.lit(1)).alias("days"))
    return mt.combine_oos(per, KEYS, ["cagr"], ["days"]).withColumn("cagr", rounded(F.col("cagr")))


@query("sensitivity_grid", f"WITH {SQL_RET}, g AS (SELECT q, s FROM (VALUES (0.5), (1.0), (2.0)) a(q), (VALUES (0), (1)) b(s)) SELECT 'lever=' || q || ',shift=' || s AS run_id, round(avg(ret * q - s * 0.001) / stddev_samp(ret * q - s * 0.001) * sqrt(252), 6) AS sharpe FROM rt, g WHERE ret IS NOT NULL GROUP BY 1")
def sensitivity_grid(spark, sf):
    grid = mt.sensitivity_grid(_ret(spark, sf).where("ret IS NOT NULL").drop("run_id"), {"lever": [0.5, 1.0, 2.0], "shift": [0, 1]})
    return grid.groupBy("run_id").agg(rounded(mt.sharpe(F.col("ret") * F.col("lever") - F.col("shift") * 0.001)).alias("sharpe"))


CUT = D(1999, 6, 30)


@query("shuffle_future", "SELECT count(*) AS n_rows, count(DISTINCT (date, symbol)) AS n_keys, round(sum(close), 2) AS total, round(sum(close) FILTER (date <= DATE '1999-06-30'), 2) AS past FROM v_bar")
def shuffle_future(spark, sf):
    out = mt.shuffle_future(v.v_bar(spark, sf), CUT, ["date", "symbol"], ["close", "volume"])
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date", "symbol").alias("n_keys"), F.round(F.sum("close"), 2).alias("total"),
                   F.round(F.sum(F.when(F.col("date") <= F.lit(CUT), F.col("close"))), 2).alias("past"))


# Two strategies over the same bars, rebalanced at month ends: one buys what rose in the month, one what will rise in the next.
CHANGE = D(1999, 6, 15)
SQL_RUNS = f"""fut AS (SELECT date, symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM v_bar WHERE date > DATE '{CHANGE}'),
    bb AS (SELECT 'base' AS variant, date, symbol, close FROM v_bar UNION ALL SELECT 'changed', date, symbol, close FROM v_bar WHERE date <= DATE '{CHANGE}' UNION ALL SELECT 'changed', f.date, f.symbol, g.close FROM fut f JOIN fut g ON g.symbol = f.symbol AND g.k = f.n + 1 - f.k),
    ends AS (SELECT last_day(date) AS m, max(date) AS d FROM v_bar GROUP BY 1), mc AS (SELECT variant, symbol, d AS date, arg_max(close, bb.date) AS close FROM bb JOIN ends ON m = last_day(bb.date) GROUP BY 1, 2, 3),
    sg AS (SELECT variant, symbol, date, close / lag(close) OVER w AS own, lead(close) OVER w / close AS peek FROM mc WINDOW w AS (PARTITION BY variant, symbol ORDER BY date)),
    wt AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY variant, run_id, date) AS weight FROM (SELECT variant, 'honest' AS run_id, date, symbol FROM sg WHERE own > 1 UNION ALL SELECT variant, 'peeks', date, symbol FROM sg WHERE peek > 1)),
    rr AS (SELECT variant, date, symbol, coalesce(close / lag(close) OVER (PARTITION BY variant, symbol ORDER BY date) - 1, 0) AS ret FROM bb)"""
SQL_CURVE = """{to} AS (SELECT d.variant, d.run_id, d.date, sum(weight * ret) AS ret FROM (SELECT x.variant, x.run_id, x.date, y.date AS rb FROM (SELECT DISTINCT variant, run_id, rr.date FROM rr CROSS JOIN (VALUES ('honest'), ('peeks')) t(run_id)) x ASOF JOIN (SELECT DISTINCT variant, run_id, date FROM {of}) y ON x.variant = y.variant AND x.run_id = y.run_id AND x.date > y.date) d
    JOIN rr ON rr.variant = d.variant AND rr.date = d.date JOIN {of} w ON w.variant = d.variant AND w.run_id = d.run_id AND w.date = d.rb AND w.symbol = rr.symbol GROUP BY 1, 2, 3)"""


def _runs(spark, sf, changed: bool):
    """Bars, and the weights that both strategies draw from them, with the future reversed too or without.

    The bars carry no run: the strategies share them, and reversing the future keeps all bars up to the cut.
    """
    from pyspark.sql import Window
    bars = settle(v.v_bar(spark, sf).select("date", "symbol", "close").repartition("symbol"))  # many steps read them
    strategies = spark.createDataFrame([("honest", False), ("peeks", True)], "run_id string, peeks boolean")
    every = bars.withColumn("variant", F.lit("base"))
    if changed:
        every = every.unionByName(mt.reverse_future(bars, CHANGE, ["close"]).withColumn("variant", F.lit("changed")))
    ends = bars.groupBy(F.last_day("date").alias("month")).agg(F.max("date").alias("end"))
    keys = ["variant", "run_id"]
    monthly = every.groupBy("variant", "symbol", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close")).join(F.broadcast(ends), "month")
    w = Window.partitionBy("variant", "symbol").orderBy("end")
    monthly = monthly.withColumns({"own": F.col("close") / F.lag("close").over(w), "peek": F.lead("close").over(w) / F.col("close")})
    rise = F.when(F.col("peeks"), F.col("peek")).otherwise(F.col("own"))
    bought = settle(mt.parameter_runs(monthly, strategies).where(rise > 1).select(*keys, F.col("end").alias("date"), "symbol"))
    sizes = bought.groupBy(*keys, "date").agg((1 / F.count(F.lit(1))).alias("weight"))
    return bars, bought.join(F.broadcast(sizes), [*keys, "date"]), keys


@query("leakage_check", f"WITH {SQL_RUNS}, {SQL_CURVE.format(to='pr', of='wt')}, cv AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY variant, run_id ORDER BY date) AS nav FROM pr), "
       f"df AS (SELECT run_id, max(coalesce(abs(a.nav - b.nav), 'inf'::DOUBLE)) AS d FROM (SELECT * FROM cv WHERE variant = 'base' AND date <= DATE '{CHANGE}') a FULL JOIN (SELECT * FROM cv WHERE variant = 'changed' AND date <= DATE '{CHANGE}') b USING (run_id, date) GROUP BY 1) SELECT run_id, round(d, 6) AS max_diff, d < 1e-6 AS passed FROM df")
def leakage_check(spark, sf):
    bars, weights, keys = _runs(spark, sf, changed=True)
    upto = F.col("date") <= F.lit(CHANGE)  # all that is compared; no curve reads ahead of itself
    curves = settle(mt.run_curves(bars.where(upto), weights.where(upto), keys).select(*keys, "date", "nav"))
    side = lambda x: curves.where(F.col("variant") == x).drop("variant")
    return mt.leakage_check(side("base"), side("changed"), CHANGE).withColumn("max_diff", rounded(F.col("max_diff")))


SQL_SHIFT = "cd AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM v_nav)), sh AS (SELECT prev AS date, symbol, close AS weight FROM v_bar JOIN cd USING (date) WHERE prev IS NOT NULL)"


@query("shift_dates_back", f"WITH {SQL_SHIFT} SELECT * FROM sh")
def shift_dates_back(spark, sf):
    w = v.v_bar(spark, sf).select("date", "symbol", F.col("close").alias("weight"))
    return mt.shift_dates_back(w, v.v_nav(spark, sf).select("date").distinct())


@query("signal_shift_check", f"WITH {SQL_RUNS}, days AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM v_bar)), early AS (SELECT variant, run_id, prev AS date, symbol, weight FROM wt JOIN days USING (date) WHERE prev IS NOT NULL), {SQL_CURVE.format(to='pr', of='wt')}, {SQL_CURVE.format(to='pe', of='early')}, "
       "a AS (SELECT run_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS base FROM pr WHERE variant = 'base' GROUP BY 1), b AS (SELECT run_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS moved FROM pe WHERE variant = 'base' GROUP BY 1) "
       "SELECT run_id, round(base, 6) AS base, round(moved, 6) AS moved, moved >= base AS passed FROM a JOIN b USING (run_id)")
def signal_shift_check(spark, sf):
    bars, weights, keys = _runs(spark, sf, changed=False)
    early = mt.shift_dates_back(weights, bars.select("date").distinct(), keys)
    both = weights.withColumn("moved", F.lit(False)).unionByName(early.withColumn("moved", F.lit(True)))
    curves = settle(mt.run_curves(bars, both, [*keys, "moved"]))
    out = mt.shift_check(curves.where("not moved"), curves.where("moved"))
    return out.select("run_id", rounded(F.col("base")).alias("base"), rounded(F.col("moved")).alias("moved"), "passed")


@query("static_universe", "SELECT DISTINCT index_name, symbol, d.date FROM v_member, (SELECT DISTINCT last_day(date)::DATE AS date FROM v_bar) d WHERE effective_from <= DATE '2001-06-30' AND (effective_to IS NULL OR effective_to > DATE '2001-06-30')")
def static_universe(spark, sf):
    from tidemark.operators.pit import pit_constituents
    days = v.v_bar(spark, sf).select(F.last_day("date").alias("date")).distinct()
    return mt.static_universe(pit_constituents(v.v_member(spark, sf), D(2001, 6, 30)), days)


def _samples(spark, sf):
    return mt.random_universes(v.v_member(spark, sf), 30, 20)


@query("random_universes")
def random_universes(spark, sf):
    return _samples(spark, sf)


@query("survivorship_percentile")
def survivorship_percentile(spark, sf):
    from tidemark.operators.timeseries import simple_returns
    rets = simple_returns(v.v_bar(spark, sf)).select("date", "symbol", "ret")
    whole = rets.groupBy("date").agg(F.avg("ret").alias("ret")).agg(mt.sharpe(F.col("ret"))).scalar()
    per = rets.join(_samples(spark, sf), "symbol").groupBy("sample_id", "date").agg(F.avg("ret").alias("ret"))
    sharpes = per.groupBy("sample_id").agg(mt.sharpe(F.col("ret")).alias("sharpe"))
    return mt.survivorship_percentile(sharpes, whole)


@query("config_hash", """SELECT run_id, sha256('{"days":' || count(*) || ',"end":"' || max(date) || '","run":"' || run_id || '","start":"' || min(date) || '"}') AS config_sha256
    FROM v_nav GROUP BY 1""")
def config_hash(spark, sf):
    runs = v.v_nav(spark, sf).groupBy("run_id").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"))
    settings = {"run": F.col("run_id"), "start": F.col("start"), "end": F.col("end"), "days": F.col("days")}
    return runs.select("run_id", mt.config_hash_of(settings).alias("config_sha256"))
