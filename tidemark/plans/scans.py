"""Queries over sources: scans, coverage, upserts, vendor rows, files."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import symbols as sy
from tidemark.functions.numeric import rounded
from tidemark.operators import pit
from tidemark.plans import views as v
from tidemark.plans.registry import query
from tidemark.sources import declared as dl
from tidemark.sources import readers as rd

D = date


@query("scan_prices", """SELECT date, symbol, open, high, low, close, volume FROM v_bar WHERE symbol IN (SELECT symbol FROM v_sector WHERE sector_l1 = 'BUILDING')
    AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def scan_prices(spark, sf):
    wanted = v.v_sector(spark, sf).where("sector_l1 = 'BUILDING'")
    return rd.scan(v.v_bar(spark, sf), "date", D(1996, 1, 1), D(1998, 12, 31), wanted).select("date", "symbol", "open", "high", "low", "close", "volume")


@query("scan_calendar", "SELECT exchange, date, is_trading_day FROM v_calendar WHERE exchange = 'HK' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def scan_calendar(spark, sf):
    return rd.scan(v.v_calendar(spark, sf), "date", D(1997, 1, 1), D(1999, 12, 31), ["HK"], "exchange")


@query("scan_fx", "SELECT date, pair, round(cny_per_hkd, 6) AS cny_per_hkd FROM v_fx WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def scan_fx(spark, sf):
    return rd.scan_fx(v.v_fx(spark, sf), "CNY_HKD", D(1997, 1, 1), D(1999, 12, 31)).withColumn("cny_per_hkd", rounded(F.col("cny_per_hkd")))


@query("scan_sectors", "SELECT * FROM v_sector WHERE symbol IN (SELECT symbol FROM v_bar)")
def scan_sectors(spark, sf):
    return v.v_sector(spark, sf).join(v.v_bar(spark, sf).select("symbol"), "symbol", "left_semi")


@query("scan_corporate_actions", "SELECT * FROM v_payout WHERE ex_date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' AND symbol IN (SELECT symbol FROM v_sector WHERE sector_l1 = 'BUILDING')")
def scan_corporate_actions(spark, sf):
    wanted = v.v_sector(spark, sf).where("sector_l1 = 'BUILDING'")
    return rd.scan(v.v_payout(spark, sf), "ex_date", D(1996, 1, 1), D(1999, 6, 30), wanted).drop("params_json")


@query("price_coverage", "SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM v_bar GROUP BY 1")
def price_coverage(spark, sf):
    return rd.price_coverage(v.v_bar(spark, sf))


@query("uncovered_requests", """SELECT * FROM v_request r WHERE NOT EXISTS (SELECT 1 FROM v_fetch f WHERE f.symbol = r.symbol
    AND f.fetched_start <= r.start AND f.fetched_end >= r."end")""")
def uncovered_requests(spark, sf):
    return pit.uncovered_requests(v.v_request(spark, sf), v.v_fetch(spark, sf)).select("request_id", "symbol", "start", "end")


SQL_UPSERT = """base AS (SELECT date, symbol, close FROM v_bar),
    batch AS (SELECT date + 1 AS date, symbol, max(high) AS close FROM v_bar WHERE volume > 40 GROUP BY 1, 2)"""


def _upsert_frames(spark, sf):
    bars = v.v_bar(spark, sf)
    batch = bars.where("volume > 40").groupBy(F.date_add("date", 1).alias("date"), "symbol").agg(F.max("high").alias("close"))
    return bars.select("date", "symbol", "close"), batch


@query("upsert_by_key", f"WITH {SQL_UPSERT} SELECT * FROM base WHERE (date, symbol) NOT IN (SELECT (date, symbol) FROM batch) UNION ALL SELECT * FROM batch")
def upsert_by_key(spark, sf):
    return rd.upsert_by_key(*_upsert_frames(spark, sf), rd.KEYS["prices"])


@query("insert_or_ignore", f"WITH {SQL_UPSERT} SELECT * FROM base UNION ALL SELECT * FROM batch WHERE (date, symbol) NOT IN (SELECT (date, symbol) FROM base)")
def insert_or_ignore(spark, sf):
    return rd.insert_or_ignore(*_upsert_frames(spark, sf), rd.KEYS["prices"], [F.col("close")])


@query("normalize_vendor_a", """SELECT CAST(l_shipdate AS DATE) AS date, 'k' || l_orderkey || '-' || l_linenumber AS symbol,
    CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS open, l_tax AS close,
    CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS volume, l_discount AS turnover,
    l_linestatus <> 'O' AS is_suspended, l_returnflag = 'A' AS is_st FROM lineitem""")
def normalize_vendor_a(spark, sf):
    t = v.table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    raw = t.select(
        F.to_date("l_shipdate").cast("string").alias("date"),
        F.concat(F.lit("k"), text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("symbol"),
        F.when(F.col("l_linenumber") != 2, text("l_extendedprice")).otherwise(F.lit("--")).alias("open"),
        text("l_tax").alias("high"), text("l_tax").alias("low"), text("l_tax").alias("close"),
        F.when(F.col("l_linenumber") != 4, text("l_quantity")).otherwise(F.lit("")).alias("volume"),
        text("l_extendedprice").alias("amount"), text("l_discount").alias("turn"),
        F.when(F.col("l_linestatus") == "O", F.lit("1")).otherwise(F.lit("0")).alias("tradestatus"),
        F.when(F.col("l_returnflag") == "A", F.lit("1")).otherwise(F.lit("0")).alias("isST"),
    )
    return rd.normalize_vendor_a(raw).select("date", "symbol", "open", "close", "volume", "turnover", "is_suspended", "is_st")


@query("normalize_vendor_hk", """SELECT date, symbol, open, close, volume, round(close / 100, 6) AS turnover, false AS is_suspended FROM v_px WHERE symbol LIKE '%.HK'""")
def normalize_vendor_hk(spark, sf):
    raw = v.v_px(spark, sf).where(F.col("symbol").endswith(".HK")).withColumn("turnover", F.col("close"))
    raw = raw.withColumnsRenamed({en: zh for zh, en in rd.HK_HEADERS.items()})
    return rd.normalize_vendor_hk(raw).select("date", "symbol", "open", "close", "volume", rounded(F.col("turnover")).alias("turnover"), "is_suspended")


@query("normalize_fx_fix", "SELECT date, 'CNY_HKD' AS pair, round(cny_per_hkd * 100 / 100, 6) AS cny_per_hkd FROM v_fx")
def normalize_fx_fix(spark, sf):
    raw = v.v_fx(spark, sf).select("date", (F.col("cny_per_hkd") * 100).alias("fix_per_100"))
    return rd.normalize_fx_fix(raw).withColumn("cny_per_hkd", rounded(F.col("cny_per_hkd")))


@query("extract_dividends", """SELECT symbol, ex_date, kind, amount FROM v_payout WHERE ex_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND amount > 1""")
def extract_dividends(spark, sf):
    raw = v.v_payout(spark, sf).select(
        "symbol", F.col("ex_date").cast("string").alias("ex_date"),
        F.when(F.col("amount") > 1, F.col("amount").cast("string")).otherwise(F.lit("--")).alias("cash"))
    out = rd.extract_dividends(raw, D(1996, 1, 1), D(2000, 12, 31))
    return out.select("symbol", "ex_date", "kind", F.get_json_object("params_json", "$.amount_per_share").cast("double").alias("amount"))


@query("equal_weight_snapshot", """WITH m AS (SELECT DISTINCT index_name, symbol FROM v_member WHERE effective_from <= DATE '1998-06-30' AND (effective_to IS NULL OR effective_to > DATE '1998-06-30'))
    SELECT index_name, symbol, round(1.0 / count(*) OVER (PARTITION BY index_name), 6) AS weight FROM m""")
def equal_weight_snapshot(spark, sf):
    m = pit.pit_constituents(v.v_member(spark, sf), D(1998, 6, 30)).select("index_name", "symbol").distinct()
    return pit.equal_weight_snapshot(m).withColumn("weight", rounded(F.col("weight")))


@query("vendor_symbol_map", """SELECT symbol, lower(split_part(symbol, '.', 2)) || '.' || split_part(symbol, '.', 1) AS vendor,
    CASE WHEN symbol NOT LIKE '%.HK' THEN symbol END AS back, split_part(symbol, '.', 1) AS hk_code FROM v_sector""")
def vendor_symbol_map(spark, sf):
    s = F.col("symbol")
    out = v.v_sector(spark, sf).select("symbol", sy.to_vendor_symbol(s).alias("vendor"), sy.hk_vendor_code(s).alias("hk_code"))
    return out.withColumn("back", sy.from_vendor_symbol(F.col("vendor")))


@query("load_pairs", "SELECT a, h, name_en FROM v_pair WHERE h IS NOT NULL AND h LIKE '%.HK' AND a NOT LIKE '%.HK'")
def load_pairs(spark, sf):
    return v.v_pair(spark, sf).where(F.col("h").isNotNull() & (sy.venue_of(F.col("h")) == "HK") & (sy.venue_of(F.col("a")) != "HK"))


SQL_PATHS = """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN symbol || '/年报-' || year || '.md' WHEN doc_id % 4 = 2 THEN symbol || '/招股说明书.md'
      ELSE symbol || '/research/broker-' || strftime(date, '%Y%m%d') || '.md' END AS path, symbol, kind, year, date FROM v_filing"""


def _paths(spark, sf):
    f = v.v_filing(spark, sf)
    path = (F.when(F.col("kind") == "annual", F.concat("symbol", F.lit("/年报-"), F.col("year").cast("string"), F.lit(".md")))
            .when(F.col("kind") == "ipo", F.concat("symbol", F.lit("/招股说明书.md")))
            .otherwise(F.concat("symbol", F.lit("/research/broker-"), F.date_format("date", "yyyyMMdd"), F.lit(".md"))))
    return f.select(path.alias("path"))


@query("index_filings", f"SELECT symbol, kind, year, date, path FROM ({SQL_PATHS})")
def index_filings(spark, sf):
    return rd.index_filings(_paths(spark, sf)).drop("title")


@query("index_profiles", "SELECT symbol, date, symbol || '-' || strftime(date, '%Y-%m-%d') || '.md' AS path FROM v_profile WHERE day(date) <> 5")
def index_profiles(spark, sf):
    tail = F.when(F.dayofmonth("date") == 5, F.lit("-evaluation.md")).otherwise(F.lit(".md"))
    files = v.v_profile(spark, sf).select(F.concat("symbol", F.lit("-"), F.col("date").cast("string"), tail).alias("path"))
    return rd.index_profiles(files)


@query("read_turns", "SELECT conv_id, turn, role, text FROM v_turn")
def read_turns(spark, sf):
    t = v.v_turn(spark, sf)
    body = t.select("conv_id", F.to_json(F.struct("turn", "role", "text")).alias("line"))
    head = t.where("turn = 0").select("conv_id", F.explode(F.array(F.lit('{"_meta": {"model": "m"}}'), F.lit("  "))).alias("line"))
    return rd.parse_turns(body.unionByName(head))


@query("parse_universe", """SELECT sector_l2 AS id, symbol, CASE WHEN sector_l2 < 'NATION_2' THEN 0.5 ELSE 1.0 END AS signal FROM v_sector""")
def parse_universe(spark, sf):
    s = v.v_sector(spark, sf).groupBy(F.col("sector_l2").alias("id")).agg(F.collect_set("symbol").alias("syms"))
    payload = (F.when(F.col("id") < "NATION_2", F.to_json(F.map_from_arrays("syms", F.transform("syms", lambda _: F.lit(0.5)))))
               .when(F.col("id") < "NATION_5", F.to_json("syms")).otherwise(F.array_join("syms", "\n")))
    return rd.parse_universe(s.select("id", payload.alias("payload")))


@query("export_records", """SELECT symbol, date, CAST(json_extract_string(j, '$.close') AS DOUBLE) AS close, CAST(json_extract_string(j, '$.volume') AS BIGINT) AS volume
    FROM (SELECT symbol, date, to_json({'close': close, 'volume': volume}) AS j FROM v_bar)""")
def export_records(spark, sf):
    out = rd.export_records(v.v_bar(spark, sf).select("symbol", "date", "close", "volume"), ["symbol", "date"])
    return out.select("symbol", "date", F.get_json_object("record", "$.close").cast("double").alias("close"),
                      F.get_json_object("record", "$.volume").cast("bigint").alias("volume"))


@query("sort_multi", "SELECT symbol, date, close FROM v_px ORDER BY close DESC NULLS LAST, symbol, date")
def sort_multi(spark, sf):
    return v.v_px(spark, sf).select("symbol", "date", "close").orderBy(F.desc_nulls_last("close"), "symbol", "date")


@query("top_n", "SELECT symbol, date, close FROM v_bar ORDER BY close DESC NULLS LAST, symbol, date LIMIT 25")
def top_n(spark, sf):
    return v.v_bar(spark, sf).select("symbol", "date", "close").orderBy(F.desc_nulls_last("close"), "symbol", "date").limit(25)


@query("union_distinct", "SELECT symbol FROM v_filing UNION SELECT symbol FROM v_profile")
def union_distinct(spark, sf):
    return v.v_filing(spark, sf).select("symbol").union(v.v_profile(spark, sf).select("symbol")).distinct()


@query("concat_frames", "SELECT symbol, date, close FROM v_bar UNION ALL SELECT symbol, date, close FROM v_px")
def concat_frames(spark, sf):
    return v.v_bar(spark, sf).select("symbol", "date", "close").unionByName(v.v_px(spark, sf).select("symbol", "date", "close"))


@query("set_difference", "SELECT symbol FROM v_fund EXCEPT SELECT symbol FROM v_member")
def set_difference(spark, sf):
    held = v.v_fund(spark, sf).select("symbol").distinct()
    return held.join(v.v_member(spark, sf).select("symbol"), "symbol", "left_anti")


@query("intersect", "SELECT symbol FROM v_fund INTERSECT SELECT symbol FROM v_member")
def intersect(spark, sf):
    return v.v_fund(spark, sf).select("symbol").intersect(v.v_member(spark, sf).select("symbol"))


@query("dedupe_keep_last", "SELECT exec_date, symbol, last(notional ORDER BY notional, shares) AS notional FROM v_trade GROUP BY 1, 2")
def dedupe_keep_last(spark, sf):
    from tidemark.operators.joins import latest_by
    return latest_by(v.v_trade(spark, sf), ["exec_date", "symbol"], [F.col("notional"), F.col("shares")], ["notional"])


# --- the seven sources, declared over the given tables ------------------------------------------

SOURCE_VIEWS = {
    "prices": v.v_bar, "fundamentals": v.v_fund, "fx": v.v_fx, "calendar": v.v_calendar, "sectors": v.v_sector,
    "corporate_actions": v.v_payout, "constituents": v.v_member,
}
FETCH = {name: dl.source(name)(view) for name, view in SOURCE_VIEWS.items()}


@query("source_contract", """WITH building AS (SELECT symbol FROM v_sector WHERE sector_l1 = 'BUILDING'),
    asked AS (SELECT 'prices' AS source, CAST(date AS VARCHAR) || symbol AS key FROM v_bar WHERE symbol IN (FROM building) AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
      UNION ALL SELECT 'fundamentals', symbol || report_date || known_as_of || statement_kind FROM v_fund WHERE symbol IN (FROM building) AND report_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
      UNION ALL SELECT 'fx', CAST(date AS VARCHAR) FROM v_fx WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
      UNION ALL SELECT 'calendar', CAST(date AS VARCHAR) FROM v_calendar WHERE exchange = 'HK' AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
      UNION ALL SELECT 'sectors', symbol FROM v_sector WHERE symbol IN (FROM building)
      UNION ALL SELECT 'corporate_actions', symbol || ex_date || kind FROM v_payout WHERE symbol IN (FROM building) AND ex_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
      UNION ALL SELECT 'constituents', symbol || effective_from FROM v_member WHERE index_name = 'N' AND effective_from <= DATE '1997-06-30' AND (effective_to IS NULL OR effective_to > DATE '1997-06-30')),
    copies AS (SELECT source, key, count(*) AS n FROM asked GROUP BY 1, 2)
    SELECT source, 'rows' AS rule, CAST(sum(n) AS BIGINT) AS n FROM copies GROUP BY 1
    UNION ALL SELECT source, 'duplicate:key', CAST(sum(n) AS BIGINT) FROM copies WHERE n > 1 GROUP BY 1""")
def source_contract(spark, sf):
    wanted = v.v_sector(spark, sf).where("sector_l1 = 'BUILDING'")
    dates = {"start": D(1995, 1, 1), "end": D(1998, 12, 31)}
    listed = {"symbols": wanted}
    asked = {
        "prices": dates | listed, "fundamentals": dates | listed, "fx": dates | {"of": "CNY_HKD"}, "calendar": dates | {"of": "HK"},
        "sectors": listed, "corporate_actions": dates | listed, "constituents": {"of": "N", "asof": D(1997, 6, 30)},
    }
    reports = [dl.audit(name, FETCH[name](spark, sf, **how)) for name, how in asked.items()]
    return reduce(lambda a, b: a.unionByName(b), reports)
