"""Queries of the screen and of per-symbol summaries."""

from __future__ import annotations

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded, settled_round
from tidemark.operators import documents as dc, pit, screen as sc, timeseries as ts
from tidemark.plans import views as v
from tidemark.plans.point_in_time import ASOF, SQL_KNOWN
from tidemark.plans.registry import query
from tidemark.session import settle

SQL_NEWEST = SQL_KNOWN + """, newest AS (SELECT * EXCLUDE (rn2) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC, known_as_of DESC, fact_id DESC) AS rn2 FROM known) WHERE rn2 = 1)"""
T0 = "DATE '1999-06-30'"


def _known(spark, sf):
    return pit.fundamentals_asof(v.v_fund(spark, sf), ASOF)


CONDITIONS = {"pe": ("between", 5, 25), "roe": (">", 0.02), "pb": ("!=", 2.0), "sector_l1": ("not_in", ["BUILDING"])}
SQL_PASS = "coalesce(pe BETWEEN 5 AND 25, false) AND coalesce(roe > 0.02, false) AND coalesce(pb <> 2.0, true) AND coalesce(sector_l1 NOT IN ('BUILDING'), true)"


@query("screen_predicates", f"SELECT fact_id, f.symbol, pe, pb, roe FROM v_fund f LEFT JOIN v_sector USING (symbol) WHERE {SQL_PASS}")
def screen_predicates(spark, sf):
    base = v.v_fund(spark, sf).join(v.v_sector(spark, sf), "symbol", "left")
    return sc.screen_predicates(base, CONDITIONS).select("fact_id", "symbol", "pe", "pb", "roe")


@query("run_screen", f"""WITH {SQL_NEWEST}, avg3 AS (SELECT symbol, round(avg(roe), 12) AS roe_3y_avg FROM known WHERE report_date BETWEEN DATE '1996-06-30' AND {T0} GROUP BY 1),
    members AS (SELECT DISTINCT symbol FROM v_member WHERE index_name = 'N' AND effective_from <= {T0} AND (effective_to IS NULL OR effective_to > {T0}))
    SELECT n.symbol, n.report_date, n.fact_id, n.pe, n.roe, sector_l1, round(roe_3y_avg, 6) AS roe_3y_avg FROM newest n LEFT JOIN v_sector USING (symbol) LEFT JOIN avg3 USING (symbol)
    WHERE n.symbol IN (SELECT symbol FROM members) AND {SQL_PASS} AND coalesce(roe_3y_avg > 0.05, false)""")
def run_screen(spark, sf):
    out = sc.run_screen({**CONDITIONS, "roe_3y_avg": (">", 0.05)}, v.v_fund(spark, sf), v.v_sector(spark, sf), ASOF, v.v_member(spark, sf), "N")
    return out.select("symbol", "report_date", "fact_id", "pe", "roe", "sector_l1", rounded(F.col("roe_3y_avg")).alias("roe_3y_avg"))


@query("screen_counts", f"SELECT count(*) AS n_input, count(*) FILTER ({SQL_PASS}) AS n_passed FROM v_fund LEFT JOIN v_sector USING (symbol)")
def screen_counts(spark, sf):
    return sc.screen_counts(v.v_fund(spark, sf).join(v.v_sector(spark, sf), "symbol", "left"), CONDITIONS)


def _tail(years):
    return f"report_date BETWEEN CAST({T0} - INTERVAL {years} YEAR AS DATE) AND {T0}"


SQL_GROWTH = """CASE WHEN count(*) >= 2 AND arg_min({c}, {d}) > 0 AND max({d}) > min({d}) THEN round(pow(arg_max({c}, {d}) / arg_min({c}, {d}), 1 / ({years})) - 1, 6) END"""


@query("lazy_derived_columns", f"""WITH {SQL_KNOWN}, a3 AS (SELECT symbol, avg(roe) AS r3 FROM known WHERE {_tail(3)} GROUP BY 1), a5 AS (SELECT symbol, avg(roe) AS r5 FROM known WHERE {_tail(5)} GROUP BY 1)
    SELECT s.symbol, round(r3, 6) AS roe_3y_avg, round(r5, 6) AS roe_5y_avg FROM (SELECT DISTINCT symbol FROM known) s LEFT JOIN a3 USING (symbol) LEFT JOIN a5 USING (symbol)""")
def lazy_derived_columns(spark, sf):
    known = _known(spark, sf)
    build = sc.derived_columns(known, None, ASOF)
    out = known.select("symbol").distinct()
    for name in ("roe_3y_avg", "roe_5y_avg"):
        out = out.join(build[name]().withColumn(name, rounded(F.col(name))), "symbol", "left")
    return out


@query("trailing_mean", f"WITH {SQL_KNOWN} SELECT symbol, round(avg(roe), 6) AS roe_3y_avg FROM known WHERE {_tail(3)} GROUP BY 1")
def trailing_mean(spark, sf):
    return sc.trailing_mean(_known(spark, sf), ASOF, "roe", 3, "roe_3y_avg").withColumn("roe_3y_avg", rounded(F.col("roe_3y_avg")))


@query("growth_cagr", f"WITH {SQL_KNOWN} SELECT symbol, " + SQL_GROWTH.format(c="revenue", d="report_date", years="date_diff('day', min(report_date), max(report_date)) / 365.25") + f" AS growth FROM known WHERE {_tail(3)} GROUP BY 1")
def growth_cagr(spark, sf):
    return sc.growth_cagr(_known(spark, sf), ASOF, "revenue", 3, "growth").withColumn("growth", rounded(F.col("growth")))


def _payouts(spark, sf):
    return v.v_payout(spark, sf).withColumn("amount", sc.cash_amount(F.col("params_json")))


@query("annual_dividends", "SELECT symbol, year(ex_date) AS year, round(sum(amount), 6) AS amount FROM v_payout GROUP BY 1, 2")
def annual_dividends(spark, sf):
    return sc.annual_dividends(_payouts(spark, sf)).withColumn("amount", rounded(F.col("amount")))


@query("dividend_growth_cagr", f"WITH y AS (SELECT symbol, year(ex_date) AS y, sum(amount) AS amount FROM v_payout WHERE ex_date BETWEEN DATE '1994-06-30' AND {T0} GROUP BY 1, 2) SELECT symbol, "
       + SQL_GROWTH.format(c="amount", d="y", years="max(y) - min(y)") + " AS dividend_growth FROM y GROUP BY 1")
def dividend_growth_cagr(spark, sf):
    return sc.dividend_growth_cagr(_payouts(spark, sf), ASOF, 5).withColumn("dividend_growth", rounded(F.col("dividend_growth")))


@query("dividend_grade", """WITH y AS (SELECT symbol, year(ex_date) AS y, round(sum(amount), 9) AS a FROM v_payout WHERE ex_date BETWEEN DATE '1992-01-01' AND DATE '2001-12-31' GROUP BY 1, 2),
    d AS (SELECT *, a - lag(a) OVER (PARTITION BY symbol ORDER BY y) AS diff, row_number() OVER (PARTITION BY symbol ORDER BY y DESC) AS r FROM y),
    g AS (SELECT symbol, count(*) AS n, coalesce(bool_or(r <= 4 AND diff < 0), false) AS cut, coalesce(bool_or(diff < 0), false) AS any_cut, arg_min(a, y) AS a0, arg_max(a, y) AS a1 FROM d GROUP BY 1)
    SELECT symbol, n AS paid_years, cut AS recent_cut, CASE WHEN n < 3 THEN 'F' WHEN n <= 4 THEN 'E' WHEN n <= 6 THEN 'D' WHEN n >= 10 AND NOT any_cut THEN CASE WHEN pow(a1 / a0, 1.0 / 9) - 1 >= 0.08 THEN 'A' ELSE 'B' END ELSE CASE WHEN cut THEN 'D' ELSE 'C' END END AS grade FROM g""")
def dividend_grade(spark, sf):
    return sc.dividend_grade(_payouts(spark, sf), D(2001, 12, 31))


@query("lag_diff", "SELECT symbol, y AS year, round(a - lag(a) OVER (PARTITION BY symbol ORDER BY y), 6) AS change FROM (SELECT symbol, year(ex_date) AS y, sum(amount) AS a FROM v_payout GROUP BY 1, 2)")
def lag_diff(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("year")
    return sc.annual_dividends(_payouts(spark, sf)).select("symbol", "year", rounded(F.col("amount") - F.lag("amount").over(w)).alias("change"))


@query("dividend_continuity", "WITH d AS (SELECT last_day(m)::DATE AS d FROM generate_series(DATE '1998-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) t(m)) SELECT d AS as_of, symbol, count(*) AS n_paid FROM d JOIN v_payout ON ex_date > d - 1095 AND ex_date <= d GROUP BY 1, 2 HAVING count(*) >= 3")
def dividend_continuity(spark, sf):
    from tidemark.operators.factor import dividend_continuity as f
    return f(v.v_payout(spark, sf), D(1998, 1, 1), D(2000, 12, 31))


SQL_OE = "oe AS (SELECT symbol, report_date, fact_id, net_income + d_and_a - capex - working_capital_change AS oe FROM {t} WHERE working_capital_change IS NOT NULL)"


@query("owner_earnings", f"WITH {SQL_OE.format(t='v_fund')} SELECT symbol, report_date, round(oe, 4) AS owner_earnings FROM oe")
def owner_earnings(spark, sf):
    return sc.owner_earnings(v.v_fund(spark, sf)).withColumn("owner_earnings", rounded(F.col("owner_earnings"), 4))


@query("owner_earnings_yield", f"WITH {SQL_KNOWN}, {SQL_OE.format(t='known')} SELECT c.symbol, round(e / CASE WHEN cap <> 0 THEN cap END, 6) AS owner_earnings_yield FROM (SELECT symbol, arg_max(market_cap, report_date) AS cap FROM known GROUP BY 1) c LEFT JOIN (SELECT symbol, arg_max(oe, report_date) AS e FROM oe GROUP BY 1) USING (symbol)")
def owner_earnings_yield(spark, sf):
    return sc.owner_earnings_yield(_known(spark, sf)).withColumn("owner_earnings_yield", rounded(F.col("owner_earnings_yield")))


@query("oe_summary", f"WITH {SQL_KNOWN}, {SQL_OE.format(t='known')} SELECT symbol, round(arg_max(oe, report_date)::DECIMAL(28, 8), 6)::DOUBLE AS latest, round(avg(oe)::DECIMAL(28, 8), 6)::DOUBLE AS mean, round(stddev_samp(oe) / CASE WHEN avg(oe) <> 0 THEN abs(avg(oe)) END, 6) AS cv FROM oe GROUP BY 1")
def oe_summary(spark, sf):
    return sc.oe_summary(_known(spark, sf)).select("symbol", settled_round(F.col("latest")).alias("latest"), settled_round(F.col("mean")).alias("mean"), rounded(F.col("cv")).alias("cv"))


@query("valuation_bands", f"""WITH {SQL_KNOWN}, p AS (SELECT symbol, quantile_cont(pe, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q, arg_max(pe, report_date) AS cur, date_diff('day', min(report_date), max(report_date)) / 365.25 AS years FROM known GROUP BY 1)
    SELECT p.symbol, round(q[1], 6) AS p10, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p90, cur AS current, round(100 * avg(CASE WHEN pe <= cur THEN 1.0 ELSE 0.0 END), 6) AS percentile, round(any_value(years), 6) AS years
    FROM known k JOIN p USING (symbol) GROUP BY ALL""")
def valuation_bands(spark, sf):
    out = sc.valuation_bands(_known(spark, sf), "pe")
    return out.select("symbol", "current", *[rounded(F.col(c)).alias(c) for c in ("p10", "p25", "p50", "p75", "p90", "percentile", "years")])


@query("metric_trajectory", f"WITH {SQL_KNOWN} SELECT symbol, report_date, metric, value FROM (UNPIVOT (SELECT symbol, report_date, pe, pb, roe FROM known) ON pe, pb, roe INTO NAME metric VALUE value)")
def metric_trajectory(spark, sf):
    return sc.metric_trajectory(_known(spark, sf), ["pe", "pb", "roe"])


@query("fundamentals_defaults", "SELECT fact_id, publication_date AS known_as_of, 'audited' AS statement_kind, round(CASE WHEN total_equity + total_debt > 0 THEN net_income / (total_equity + total_debt) END, 6) AS roic FROM v_fund")
def fundamentals_defaults(spark, sf):
    out = sc.fundamentals_defaults(v.v_fund(spark, sf).drop("known_as_of", "statement_kind"))
    return out.select("fact_id", "known_as_of", "statement_kind", rounded(F.col("roic")).alias("roic"))


SQL_LAST_HFQ = f"""pf AS (SELECT a.symbol, a.ex_date, (p.close - a.amount) / p.close AS f FROM v_payout a ASOF JOIN v_bar p ON a.symbol = p.symbol AND a.ex_date > p.date WHERE p.close > 0),
    lb AS (SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM v_bar WHERE date <= {T0} GROUP BY 1),
    lp AS (SELECT lb.symbol, round(any_value(lb.close) * coalesce(product(f), 1), 6) AS price FROM lb LEFT JOIN pf ON pf.symbol = lb.symbol AND pf.ex_date > lb.date GROUP BY 1)"""


@query("watchlist_snapshot", f"""WITH {SQL_NEWEST}, {SQL_LAST_HFQ}, l AS (SELECT DISTINCT index_name AS watchlist_name, symbol FROM v_member)
    SELECT l.*, p.price, n.pe, n.dividend_yield, sector_l1, {T0} AS snapshot_date FROM l LEFT JOIN lp p USING (symbol)
    LEFT JOIN newest n USING (symbol) LEFT JOIN v_sector USING (symbol)""")
def watchlist_snapshot(spark, sf):
    lists = v.v_member(spark, sf).select(F.col("index_name").alias("watchlist_name"), "symbol").distinct()
    bars = settle(v.v_bar(spark, sf).select("date", "symbol", "close"))  # priced and adjusted
    actions = v.v_payout(spark, sf).select("symbol", "ex_date", "kind", "amount", F.lit(None).cast("double").alias("ratio"))
    adjusted = ts.adjust_prices(bars, ts.action_factors(actions, bars))
    out = sc.watchlist_snapshot(lists, adjusted, v.v_fund(spark, sf), v.v_sector(spark, sf), ASOF)
    return out.select("watchlist_name", "symbol", rounded(F.col("price")).alias("price"), "pe", "dividend_yield", "sector_l1", "snapshot_date")


@query("snapshot_dates", "SELECT DISTINCT index_name AS watchlist_name, effective_from AS snapshot_date FROM v_member")
def snapshot_dates(spark, sf):
    return v.v_member(spark, sf).select(F.col("index_name").alias("watchlist_name"), F.col("effective_from").alias("snapshot_date")).distinct()


@query("sector_shares", "SELECT sector_l1, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v_sector GROUP BY 1")
def sector_shares(spark, sf):
    from tidemark.operators.weights import sector_shares as f
    return f(v.v_sector(spark, sf)).withColumn("share", rounded(F.col("share")))


@query("distinct_sectors", "SELECT f.report_date, count(DISTINCT sector_l1) AS n_sectors FROM v_fund f LEFT JOIN v_sector USING (symbol) GROUP BY 1")
def distinct_sectors(spark, sf):
    return v.v_fund(spark, sf).join(v.v_sector(spark, sf), "symbol", "left").groupBy("report_date").agg(F.count_distinct("sector_l1").alias("n_sectors"))


SQL_CORPUS = """f AS (SELECT symbol, count(*) FILTER (kind = 'annual') AS n_annual, max(year) FILTER (kind = 'annual') AS latest_annual_year, coalesce(bool_or(kind = 'ipo'), false) AS has_ipo,
      count(*) FILTER (kind = 'research') AS n_research, max(date) FILTER (kind = 'research') AS latest_research FROM v_filing GROUP BY 1),
    p AS (SELECT symbol, max(date) AS profile_date FROM v_profile GROUP BY 1)"""


@query("corpus_summary", f"""WITH {SQL_CORPUS} SELECT symbol, coalesce(n_annual, 0) AS n_annual, latest_annual_year, coalesce(has_ipo, false) AS has_ipo, coalesce(n_research, 0) AS n_research, latest_research,
    profile_date IS NOT NULL AS has_profile, profile_date, DATE '2024-06-30' - profile_date AS profile_age_days, 2024 - latest_annual_year AS staleness_years FROM f FULL JOIN p USING (symbol)""")
def corpus_summary(spark, sf):
    return dc.corpus_summary(v.v_filing(spark, sf), v.v_profile(spark, sf), D(2024, 6, 30))


@query("enrich_with_filings", f"WITH {SQL_CORPUS} SELECT s.symbol, sector_l1, coalesce(n_annual, 0) AS n_annual, latest_annual_year, coalesce(n_research, 0) AS n_research, latest_research, p.symbol IS NOT NULL AS has_profile FROM v_sector s LEFT JOIN f USING (symbol) LEFT JOIN p ON p.symbol = s.symbol")
def enrich_with_filings(spark, sf):
    out = dc.enrich_with_filings(v.v_sector(spark, sf), v.v_filing(spark, sf), v.v_profile(spark, sf), D(2024, 6, 30))
    return out.select("symbol", "sector_l1", "n_annual", "latest_annual_year", "n_research", "latest_research", "has_profile")


@query("dossier", f"""WITH {SQL_NEWEST}, {SQL_CORPUS}, b AS (SELECT symbol, quantile_cont(pe, 0.5) AS m FROM known GROUP BY 1), d AS (SELECT symbol, count(DISTINCT year(ex_date)) AS y FROM v_payout WHERE ex_date BETWEEN DATE '1989-06-30' AND {T0} GROUP BY 1)
    SELECT n.symbol, sector_l1, n.fact_id, round(b.m, 6) AS pe_median, coalesce(d.y, 0) AS paid_years, coalesce(f.n_annual, 0) AS n_annual, (SELECT count(*) FROM known k WHERE k.symbol = n.symbol) AS n_reports
    FROM newest n LEFT JOIN v_sector USING (symbol) LEFT JOIN b USING (symbol) LEFT JOIN d USING (symbol) LEFT JOIN f USING (symbol)""")
def dossier(spark, sf):
    out = dc.dossier(v.v_fund(spark, sf), v.v_sector(spark, sf), _payouts(spark, sf), v.v_filing(spark, sf), v.v_profile(spark, sf), ASOF)
    return out.select("symbol", "sector_l1", "fact_id", rounded(F.col("pe_bands.p50")).alias("pe_median"), "paid_years", "n_annual", F.size("series").cast("bigint").alias("n_reports"))
