"""Queries on bitemporal facts, memberships and requests."""

from __future__ import annotations

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import joins, pit
from tidemark.plans import views as v
from tidemark.plans.registry import query

RANK = "CASE statement_kind WHEN 'restated' THEN 3 WHEN 'audited' THEN 2 ELSE 1 END"
SQL_KNOWN = f"""known AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, report_date
      ORDER BY known_as_of DESC, {RANK} DESC, fact_id DESC) AS rn FROM v_fund
      WHERE publication_date <= DATE '1999-06-30' AND known_as_of <= DATE '1999-06-30') WHERE rn = 1)"""
ASOF = D(1999, 6, 30)
START, END = D(1996, 1, 1), D(2000, 12, 31)
SQL_MONTHS = "months AS (SELECT CAST(last_day(m) AS DATE) AS d FROM generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) t(m))"


@query("fundamentals_asof", f"WITH {SQL_KNOWN} SELECT symbol, report_date, known_as_of, statement_kind, fact_id, revenue FROM known")
def fundamentals_asof(spark, sf):
    return pit.fundamentals_asof(v.v_fund(spark, sf), ASOF).select("symbol", "report_date", "known_as_of", "statement_kind", "fact_id", "revenue")


@query("fundamentals_asof_many", f"""WITH {SQL_MONTHS}, r AS (SELECT d AS "asof", f.*, row_number() OVER (PARTITION BY d, symbol, report_date
      ORDER BY known_as_of DESC, {RANK} DESC, fact_id DESC) AS rn FROM months JOIN v_fund f ON f.publication_date <= d AND f.known_as_of <= d)
    SELECT "asof", symbol, report_date, fact_id FROM r WHERE rn = 1""")
def fundamentals_asof_many(spark, sf):
    return pit.fundamentals_asof_month_ends(v.v_fund(spark, sf), START, END).select("asof", "symbol", "report_date", "fact_id")


@query("fundamentals_asof_days", f"""WITH days AS (SELECT DISTINCT date AS d FROM v_fx), r AS (SELECT d AS "asof", f.*, row_number() OVER (PARTITION BY d, symbol, report_date
      ORDER BY known_as_of DESC, {RANK} DESC, fact_id DESC) AS rn FROM days JOIN v_fund f ON f.publication_date <= d AND f.known_as_of <= d)
    SELECT "asof", count(*) AS n, sum(fact_id)::BIGINT AS ids FROM r WHERE rn = 1 GROUP BY 1""")
def fundamentals_asof_days(spark, sf):
    spine = v.v_fx(spark, sf).select(F.col("date").alias("asof"))
    out = pit.fundamentals_asof_many(v.v_fund(spark, sf), spine)
    return out.groupBy("asof").agg(F.count(F.lit(1)).alias("n"), F.sum("fact_id").alias("ids"))


@query("latest_per_symbol", """SELECT symbol, arg_max(pb, (report_date, known_as_of, fact_id)) AS pb, arg_max(working_capital_change, (report_date, known_as_of, fact_id)) AS wc FROM
    (SELECT * FROM v_fund) GROUP BY 1""")
def latest_per_symbol(spark, sf):
    facts = v.v_fund(spark, sf).withColumnRenamed("working_capital_change", "wc")
    order = [F.col("report_date"), F.col("known_as_of"), F.col("fact_id")]
    return pit.latest_non_null(facts, ["symbol"], order, ["pb", "wc"])


@query("latest_by_publication", "SELECT symbol, arg_max(fact_id, (publication_date, fact_id)) AS fact_id, max(publication_date) AS publication_date FROM v_fund GROUP BY 1")
def latest_by_publication(spark, sf):
    return joins.latest_by(v.v_fund(spark, sf), ["symbol"], [F.col("publication_date"), F.col("fact_id")], ["fact_id", "publication_date"])


@query("latest_document", "SELECT symbol, arg_max(path, (year, path)) AS path, max(year) AS year FROM v_filing WHERE kind = 'annual' GROUP BY 1")
def latest_document(spark, sf):
    return pit.latest_document(v.v_filing(spark, sf), "annual", F.col("year")).select("symbol", "path", "year")


@query("pit_constituents", "SELECT index_name, symbol, row_id, effective_from FROM v_member WHERE effective_from <= DATE '1998-06-30' AND (effective_to IS NULL OR effective_to > DATE '1998-06-30')")
def pit_constituents(spark, sf):
    return pit.pit_constituents(v.v_member(spark, sf), D(1998, 6, 30)).select("index_name", "symbol", "row_id", "effective_from")


@query("universe_over_time", f"""WITH {SQL_MONTHS} SELECT d AS date, index_name, symbol, count(*) AS n FROM months JOIN v_member
    ON effective_from <= d AND (effective_to IS NULL OR effective_to > d) GROUP BY 1, 2, 3""")
def universe_over_time(spark, sf):
    return pit.members_per_month(v.v_member(spark, sf), START, END)


@query("interval_join_days", """SELECT f.date, m.index_name, count(*) AS n, count(DISTINCT m.symbol) AS symbols FROM v_fx f JOIN v_member m
    ON m.effective_from <= f.date AND (m.effective_to IS NULL OR m.effective_to > f.date) GROUP BY 1, 2""")
def interval_join_days(spark, sf):
    days = v.v_fx(spark, sf).select("date")
    out = joins.active_counts(days, v.v_member(spark, sf), ["index_name"], "symbol", "date", "effective_from", "effective_to")
    return out.withColumnRenamed("members", "symbols")


@query("membership_history", """WITH s AS (SELECT DISTINCT l_returnflag AS index_name, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, symbol
      FROM (SELECT lineitem.*, lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') || CASE l_suppkey % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.HK' END AS symbol FROM lineitem)),
    d AS (SELECT *, row_number() OVER (PARTITION BY index_name ORDER BY date) AS i, lead(date) OVER (PARTITION BY index_name ORDER BY date) AS nxt FROM (SELECT DISTINCT index_name, date FROM s)),
    r AS (SELECT s.*, i, nxt, i - row_number() OVER (PARTITION BY s.index_name, symbol ORDER BY s.date) AS run FROM s JOIN d USING (index_name, date))
    SELECT index_name, symbol, min(date) AS effective_from, last(nxt ORDER BY date) AS effective_to FROM r GROUP BY index_name, symbol, run""")
def membership_history(spark, sf):
    m = v.v_member(spark, sf)
    return pit.membership_history(m.select("index_name", "symbol", F.trunc("effective_from", "month").alias("date")))


@query("left_join_sectors", "SELECT f.fact_id, f.symbol, sector_l1, sector_l2 FROM v_fund f LEFT JOIN v_sector s ON s.symbol = f.symbol AND s.sector_l1 <> 'BUILDING'")
def left_join_sectors(spark, sf):
    return v.v_fund(spark, sf).select("fact_id", "symbol").join(v.v_sector(spark, sf).where("sector_l1 <> 'BUILDING'"), "symbol", "left")


@query("semi_join_selected", "SELECT fact_id, symbol, revenue FROM v_fund WHERE symbol IN (SELECT symbol FROM v_bar)")
def semi_join_selected(spark, sf):
    return v.v_fund(spark, sf).select("fact_id", "symbol", "revenue").join(v.v_bar(spark, sf).select("symbol"), "symbol", "left_semi")


@query("anti_join_missing", "SELECT DISTINCT symbol FROM v_fund WHERE symbol NOT IN (SELECT symbol FROM v_bar)")
def anti_join_missing(spark, sf):
    return joins.anti_missing(v.v_fund(spark, sf).select("symbol").distinct(), v.v_bar(spark, sf), ["symbol"])


@query("bar_lookup", "SELECT exec_date, t.symbol, t.shares, t.side, b.close FROM v_trade t JOIN v_bar b ON b.symbol = t.symbol AND b.date = t.exec_date")
def bar_lookup(spark, sf):
    bars = v.v_bar(spark, sf).select("symbol", F.col("date").alias("exec_date"), "close")
    return v.v_trade(spark, sf).join(bars, ["symbol", "exec_date"]).select("exec_date", "symbol", "shares", "side", "close")


SQL_PAIRED = """bounds AS (SELECT DATE '1997-06-30' AS d0, DATE '1999-06-30' AS d1)"""


@query("snapshot_diff", """WITH a AS (SELECT symbol, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM v_bar WHERE date <= DATE '1997-06-30' GROUP BY 1),
    b AS (SELECT symbol, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM v_bar WHERE date <= DATE '1999-06-30' GROUP BY 1)
    SELECT symbol, round(b.close - a.close, 6) AS close_delta, b.volume - a.volume AS volume_delta FROM a JOIN b USING (symbol)""")
def snapshot_diff(spark, sf):
    from tidemark.operators.screen import snapshot_diff as diff
    bars = v.v_bar(spark, sf)
    snap = lambda d: bars.where(F.col("date") <= F.lit(d)).groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max_by("volume", "date").alias("volume"))
    return diff(snap(D(1997, 6, 30)), snap(D(1999, 6, 30)), ["close", "volume"]).withColumn("close_delta", rounded(F.col("close_delta")))
