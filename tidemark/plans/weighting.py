"""Queries of portfolio weights, constraints and risk estimates."""

from __future__ import annotations

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import timeseries as ts, weights as wt
from tidemark.plans import views as v
from tidemark.plans.factors import SQL_STUDY, monthly_bars, study
from tidemark.plans.registry import query

TOP = """, tq AS (SELECT date, symbol, signal, row_number() OVER (PARTITION BY date ORDER BY signal DESC, symbol) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY date) * 0.3, 0)) AS k FROM sig),
    w AS (SELECT date, symbol, 1 / k AS weight FROM tq WHERE rn <= k)"""
SQL_TOP = SQL_STUDY + TOP
SQL_SW = SQL_STUDY + """, ws AS (SELECT date, symbol, (signal - min(signal) OVER p) / (sum(signal) OVER p - count(*) OVER p * min(signal) OVER p) AS weight FROM sig WINDOW p AS (PARTITION BY date))"""


def _w(df, digits=6):
    return df.select("date", "symbol", rounded(F.col("weight"), digits).alias("weight"))


def _signal_weights(spark, sf):
    return wt.weight_signal(study(spark, sf)[0]).select("date", "symbol", "weight")


@query("top_quantile_weights", f"WITH {SQL_TOP} SELECT date, symbol, round(weight, 6) AS weight FROM w")
def top_quantile_weights(spark, sf):
    return _w(wt.top_quantile_weights(study(spark, sf)[0], 0.3))


@query("sector_neutralize", f"WITH {SQL_TOP}, s AS (SELECT w.*, sector_l1 FROM w JOIN v_sector USING (symbol)) SELECT date, symbol, round(weight / sum(weight) OVER (PARTITION BY date, sector_l1) / (SELECT count(DISTINCT sector_l1) FROM s s2 WHERE s2.date = s.date), 6) AS weight FROM s")
def sector_neutralize(spark, sf):
    return _w(wt.sector_neutralize(wt.top_quantile_weights(study(spark, sf)[0], 0.3), v.v_sector(spark, sf)))


# The capped weights solve w = min(cap, scale * raw) with the total kept: the scale is the fixed point over the sorted prefix.
SQL_CAP = """, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) AS k, sum(weight) OVER (PARTITION BY date) AS s,
      coalesce(sum(weight) OVER (PARTITION BY date ORDER BY weight DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {t} WHERE weight > 0),
    l AS (SELECT *, (s - (k - 1) * {cap}) / (s - b) AS scale FROM o WHERE s - b > 1e-15),
    c AS (SELECT date, arg_min(scale, k) AS scale FROM l WHERE scale * weight <= {cap} + 1e-12 GROUP BY 1)
    SELECT t.date, t.symbol, round(CASE WHEN t.weight > 0 THEN least({cap}, t.weight * coalesce(c.scale, 1e300)) ELSE t.weight END, 6) AS weight FROM {t} t LEFT JOIN c USING (date)"""


@query("cap_at", f"WITH {SQL_SW}" + SQL_CAP.format(t="ws", cap="0.015"))
def cap_at(spark, sf):
    return _w(wt.cap_at(_signal_weights(spark, sf), 0.015))


@query("signal_to_weights", f"WITH {SQL_TOP}, s AS (SELECT w.*, sector_l1 FROM w JOIN v_sector USING (symbol)), sn AS (SELECT date, symbol, weight / sum(weight) OVER (PARTITION BY date, sector_l1) / (SELECT count(DISTINCT sector_l1) FROM s s2 WHERE s2.date = s.date) AS weight FROM s)" + SQL_CAP.format(t="sn", cap="0.06"))
def signal_to_weights(spark, sf):
    return _w(wt.signal_to_weights(study(spark, sf)[0], 0.3, 0.06, v.v_sector(spark, sf)))


@query("select_all_positive", "SELECT fact_id, symbol, pe FROM v_fund WHERE pe > 0")
def select_all_positive(spark, sf):
    return v.v_fund(spark, sf).where("pe > 0").select("fact_id", "symbol", "pe")


@query("weight_equal", f"WITH {SQL_STUDY} SELECT date, symbol, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM sig")
def weight_equal(spark, sf):
    return _w(wt.weight_equal(study(spark, sf)[0]))


@query("weight_signal", f"WITH {SQL_SW} SELECT date, symbol, round(weight, 6) AS weight FROM ws")
def weight_signal(spark, sf):
    return _w(_signal_weights(spark, sf))


@query("weight_mcap", "SELECT report_date AS date, fact_id, round(coalesce(market_cap_free_float / sum(market_cap_free_float) OVER (PARTITION BY report_date), 0), 8) AS weight FROM v_fund")
def weight_mcap(spark, sf):
    return wt.weight_mcap(v.v_fund(spark, sf).withColumnRenamed("report_date", "date")).select("date", "fact_id", rounded(F.col("weight"), 8).alias("weight"))


@query("constraint_max_weight", f"WITH {SQL_SW} SELECT date, CASE WHEN max(weight) > 0.015 THEN 'bound' ELSE 'slack' END AS status, round(least(sum(weight), 0.015 * count(*) FILTER (weight > 0)), 6) AS total FROM ws GROUP BY 1")
def constraint_max_weight(spark, sf):
    return wt.constraint_max_weight(_signal_weights(spark, sf), 0.015).groupBy("date").agg(F.max("status").alias("status"), rounded(F.sum("weight")).alias("total"))


@query("constraint_max_gross", f"WITH {SQL_SW} SELECT date, symbol, round(weight * 0.8 / sum(abs(weight)) OVER (PARTITION BY date), 6) AS weight, 'bound' AS status FROM ws")
def constraint_max_gross(spark, sf):
    return wt.constraint_max_gross(_signal_weights(spark, sf), 0.8).withColumn("weight", rounded(F.col("weight")))


@query("constraint_min_positions", f"WITH {SQL_SW} SELECT date, symbol, round(weight, 6) AS weight, CASE WHEN count(*) FILTER (weight > 0) OVER (PARTITION BY date) < 99 THEN 'infeasible_relaxed' ELSE 'slack' END AS status FROM ws")
def constraint_min_positions(spark, sf):
    return wt.constraint_min_positions(_signal_weights(spark, sf), 99).withColumn("weight", rounded(F.col("weight")))


@query("constraint_max_positions", f"WITH {SQL_SW} SELECT date, symbol, round(CASE WHEN row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) <= 20 THEN weight ELSE 0 END, 6) AS weight, CASE WHEN count(*) FILTER (weight > 0) OVER (PARTITION BY date) > 20 THEN 'bound' ELSE 'slack' END AS status FROM ws")
def constraint_max_positions(spark, sf):
    return wt.constraint_max_positions(_signal_weights(spark, sf), 20).withColumn("weight", rounded(F.col("weight")))


@query("constraint_sector_match", f"WITH {SQL_SW}, sh AS (SELECT sector_l1, count(*) / sum(count(*)) OVER () AS share FROM v_sector GROUP BY 1), j AS (SELECT ws.*, sector_l1, share FROM ws JOIN v_sector USING (symbol) JOIN sh USING (sector_l1)) "
       "SELECT date, symbol, round(CASE WHEN weight > 0 THEN weight * share / sum(weight) OVER (PARTITION BY date, sector_l1) ELSE weight END, 6) AS weight, CASE WHEN (SELECT count(DISTINCT sector_l1) FROM j x WHERE x.date = j.date AND x.weight > 0) < (SELECT count(*) FROM sh) THEN 'infeasible_relaxed' ELSE 'bound' END AS status FROM j")
def constraint_sector_match(spark, sf):
    s = v.v_sector(spark, sf)
    return wt.constraint_sector_match(_signal_weights(spark, sf), s, wt.sector_shares(s)).withColumn("weight", rounded(F.col("weight")))


@query("constraint_tracking_error", f"WITH {SQL_SW}, t AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, stddev_pop(weight) OVER (PARTITION BY date) * sqrt(252) AS te FROM ws) "
       "SELECT date, symbol, round(CASE WHEN te * 10000 > 500 THEN 0.05 / te * weight + (1 - 0.05 / te) / n ELSE weight END, 6) AS weight, CASE WHEN te * 10000 > 500 THEN 'bound' ELSE 'slack' END AS status FROM t")
def constraint_tracking_error(spark, sf):
    return wt.constraint_tracking_error(_signal_weights(spark, sf), 500).withColumn("weight", rounded(F.col("weight")))


def _sequence(spark, sf):
    from functools import partial
    return wt.apply_constraints(_signal_weights(spark, sf), [
        ("max_positions", partial(wt.constraint_max_positions, n=40)), ("min_positions", partial(wt.constraint_min_positions, n=10)),
        ("max_weight", partial(wt.constraint_max_weight, cap=0.5)), ("max_gross", partial(wt.constraint_max_gross, limit=0.9))])


@query("constraint_sequence", f"WITH {SQL_SW}, m AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) <= 40 AS kept FROM ws) "
       "SELECT date, symbol, round(CASE WHEN kept THEN weight ELSE 0 END / sum(CASE WHEN kept THEN weight ELSE 0 END) OVER (PARTITION BY date), 6) AS weight FROM m")
def constraint_sequence(spark, sf):
    return _w(_sequence(spark, sf)[0])


@query("constraint_statuses", f"WITH {SQL_SW}, s AS (SELECT date, sum(weight) FILTER (rn <= 40) AS s40 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) AS rn FROM ws) GROUP BY 1) "
       "SELECT date, unnest(['max_positions', 'min_positions', 'max_weight', 'max_gross']) AS \"constraint\", unnest(['bound', 'slack', 'slack', CASE WHEN s40 > 0.9 THEN 'bound' ELSE 'slack' END]) AS status FROM s")
def constraint_statuses(spark, sf):
    return _sequence(spark, sf)[1]


@query("turnover_l1", f"WITH {SQL_TOP}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM w)), p AS (SELECT nxt AS date, symbol, weight AS w0 FROM w JOIN d USING (date) WHERE nxt IS NOT NULL) "
       "SELECT date, round(sum(abs(coalesce(weight, 0) - coalesce(w0, 0))), 6) AS turnover, sum(abs(coalesce(weight, 0) - coalesce(w0, 0))) >= 1.5 - 1e-4 AS active FROM (SELECT * FROM w WHERE date > (SELECT min(date) FROM w)) c FULL JOIN p USING (date, symbol) GROUP BY 1")
def turnover_l1(spark, sf):
    return wt.turnover_l1(wt.top_quantile_weights(study(spark, sf)[0], 0.3), 1.5).withColumn("turnover", rounded(F.col("turnover")))


@query("gross_exposure_check", f"WITH {SQL_STUDY} SELECT date, round(sum(abs(signal)), 6) AS gross, 0 AS n_unknown FROM sig GROUP BY 1 HAVING sum(abs(signal)) > 1 + 1e-6")
def gross_exposure_check(spark, sf):
    return wt.gross_exposure_check(study(spark, sf)[0].withColumnRenamed("signal", "weight")).withColumn("gross", rounded(F.col("gross")))


def daily_returns(spark, sf):
    return ts.log_returns(v.v_bar(spark, sf)).select("date", "symbol", F.col("log_ret").alias("ret")).where(F.col("ret").isNotNull())


SQL_RET = "ret AS (SELECT * FROM (SELECT date, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret FROM v_bar) WHERE ret IS NOT NULL)"
# The complete panel: every symbol on every date after the last first bar, 0 where it has none.
SQL_PANEL = SQL_RET + """, st AS (SELECT max(f) AS s FROM (SELECT symbol, min(date) AS f FROM v_bar GROUP BY 1)), pd AS (SELECT DISTINCT date FROM v_bar, st WHERE date > s),
    pn AS (SELECT date, symbol, coalesce(ret, 0) AS ret FROM pd CROSS JOIN (SELECT DISTINCT symbol FROM v_bar) LEFT JOIN ret USING (date, symbol))"""


@query("hist_mean_returns", f"WITH {SQL_RET}, r AS (SELECT *, dense_rank() OVER (ORDER BY date DESC) AS k FROM ret WHERE date < DATE '1999-06-30'), m AS (SELECT symbol, coalesce(avg(ret) FILTER (k <= 730), 0) AS mu FROM r GROUP BY 1) SELECT symbol, round(0.7 * mu + 0.3 * (SELECT avg(mu) FROM m), 6) AS mu FROM m")
def hist_mean_returns(spark, sf):
    return wt.hist_mean_returns(daily_returns(spark, sf), D(1999, 6, 30), 730, 0.3).withColumn("mu", rounded(F.col("mu")))


@query("signal_returns", f"WITH {SQL_STUDY}, r AS (SELECT date, symbol, rank() OVER (PARTITION BY date ORDER BY signal) + (count(*) OVER (PARTITION BY date, signal) - 1) / 2 AS r, count(*) OVER (PARTITION BY date) AS n FROM sig) SELECT date, symbol, round(CASE WHEN n <= 1 THEN 0 ELSE (2 * (r - 1) / (n - 1) - 1) * 0.05 END, 6) AS mu FROM r")
def signal_returns(spark, sf):
    return wt.signal_returns(study(spark, sf)[0], 0.05).withColumn("mu", rounded(F.col("mu")))


@query("user_returns", "SELECT symbol, round(arg_max(roe, (report_date, fact_id)), 6) AS mu FROM v_fund WHERE symbol IN (SELECT symbol FROM v_sector) GROUP BY 1")
def user_returns(spark, sf):
    mu = v.v_fund(spark, sf).groupBy("symbol").agg(F.max_by("roe", F.struct("report_date", "fact_id")).alias("mu"))
    return wt.user_returns(v.v_fund(spark, sf).select("symbol").distinct(), mu).withColumn("mu", rounded(F.col("mu")))


@query("sample_cov", f"WITH {SQL_RET} SELECT a.symbol AS i, b.symbol AS j, round(covar_samp(a.ret, b.ret), 6) AS cov, count(*) AS n FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2")
def sample_cov(spark, sf):
    return wt.sample_cov(daily_returns(spark, sf)).withColumn("cov", rounded(F.col("cov")))


SQL_LW = SQL_PANEL + """, x AS (SELECT date, symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM pn),
    nn AS (SELECT count(DISTINCT date) AS n, count(DISTINCT symbol) AS p FROM x),
    q AS (SELECT date, sum(x * x) AS q FROM x GROUP BY 1), bq AS (SELECT sum(q * q) AS b0, sum(q) AS tr FROM q),
    sc AS (SELECT a.symbol AS i, b.symbol AS j, sum(a.x * b.x) AS s FROM x a JOIN x b USING (date) GROUP BY 1, 2), dq AS (SELECT sum(s * s) AS d0 FROM sc),
    lw AS (SELECT n, p, tr / n / p AS mu, (b0 / n - d0 / (n * n)) / (p * n) AS b, (d0 / (n * n) - 2 * tr / n / p * tr / n + p * (tr / n / p) * (tr / n / p)) / p AS d FROM nn, bq, dq)"""


@query("ledoit_wolf_shrinkage", f"WITH {SQL_LW} SELECT n, p, round(mu, 6) AS mu, round(CASE WHEN b <= 0 THEN 0 ELSE least(b, d) / d END, 6) AS shrinkage FROM lw")
def ledoit_wolf_shrinkage(spark, sf):
    moves, size = wt.carried_panel(v.v_bar(spark, sf))
    out = wt.ledoit_wolf_shrinkage(moves, size=size)
    return out.select("n", "p", rounded(F.col("mu")).alias("mu"), rounded(F.col("shrinkage")).alias("shrinkage"))


@query("ledoit_wolf_cov", f"WITH {SQL_LW} SELECT i, j, round((1 - least(b, d) / d) * s / n + CASE WHEN i = j THEN least(b, d) / d * mu ELSE 0 END, 5) AS cov FROM sc, lw WHERE i <= j")
def ledoit_wolf_cov(spark, sf):
    moves, size = wt.carried_panel(v.v_bar(spark, sf))
    return wt.ledoit_wolf_cov(moves, size=size).withColumn("cov", rounded(F.col("cov"), 5))


# Every return enters: the panel begins with the first bar of all, a symbol does not move before its own.
SQL_WHOLE = SQL_PANEL.replace("max(f) AS s", "min(f) AS s")


@query("risk_contribution", f"WITH {SQL_WHOLE}, c AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) AS cov FROM pn a JOIN pn b USING (date) GROUP BY 1, 2), w AS (SELECT symbol, 1.0 / count(*) OVER () AS w FROM (SELECT DISTINCT symbol FROM pn)), "
       "m AS (SELECT i AS symbol, sum(cov * w) AS m FROM c JOIN w ON w.symbol = c.j GROUP BY 1) SELECT symbol, round(w, 6) AS weight, round(w * m / sum(w * m) OVER (), 6) AS contribution, round(sum(w * m) OVER (), 6) AS variance FROM w JOIN m USING (symbol)")
def risk_contribution(spark, sf):
    bars = v.v_bar(spark, sf)
    moves, size = wt.carried_panel(bars, whole=True)
    one = wt.weight_equal(bars.select("symbol").distinct().withColumn("date", F.lit(0))).select("symbol", "weight")
    out = wt.risk_contribution_of(one, moves, size)
    return out.select("symbol", *[rounded(F.col(c)).alias(c) for c in ("weight", "contribution", "variance")])


@query("inverse_vol_weights", f"WITH {SQL_RET}, s AS (SELECT symbol, stddev_samp(ret) AS sd FROM ret GROUP BY 1) SELECT symbol, round(1 / sd / sum(1 / sd) OVER (), 6) AS weight FROM s WHERE sd > 0")
def inverse_vol_weights(spark, sf):
    return wt.inverse_vol_weights(daily_returns(spark, sf)).withColumn("weight", rounded(F.col("weight")))
