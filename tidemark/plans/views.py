"""Market, filing and event views over the driver tables, as DataFrames and as SQL text.

Bars, facts, memberships and actions keep the contracts of `tidemark.sources.contracts`: bars are
unique per (date, symbol), so a window over one symbol never holds more rows than its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import quarter_end

SQL_SYMBOL = (
    "lpad(CAST({k} AS VARCHAR), CAST(greatest(6, length(CAST({k} AS VARCHAR))) AS INTEGER), '0') || "
    "CASE {k} % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.HK' END"
)


def _sql_symbol(key: str) -> str:
    return SQL_SYMBOL.format(k=key)


def symbol_of(key: Column) -> Column:
    text = key.cast("string")
    return F.concat(
        F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0")),
        F.when(key % 3 == 0, F.lit(".SH")).when(key % 3 == 1, F.lit(".SZ")).otherwise(F.lit(".HK")),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(ticks: DataFrame, price: str, order: Column) -> DataFrame:
    """Daily bars of ticks by `key`, which the symbol spells: only finished bars get theirs."""
    bars = ticks.groupBy("date", "key").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("shares").cast("bigint").alias("volume"),
        F.round(F.sum("amount"), 2).alias("amount"),
    )
    return bars.select("date", symbol_of(F.col("key")).alias("symbol"), "open", "high", "low", "close", "volume", "amount")


def v_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days of daily bars from the event stream."""
    ticks = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        F.col("user_id").alias("key"),
        "ts",
        "event_id",
        "value",
        F.lit(1).alias("shares"),
        F.col("value").alias("amount"),
    )
    return _bars(ticks, "value", F.struct("ts", "event_id"))


def v_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six years of daily bars: unit prices of each supplier's shipments."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("key"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("shares"),
        F.col("l_extendedprice").alias("amount"),
    )
    return _bars(ticks, "price", F.struct("l_orderkey", "l_linenumber", "l_partkey", "price"))


def v_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal fundamentals: an order is one statement version."""
    k, rev, day = F.col("o_orderkey"), F.col("o_totalprice"), F.to_date("o_orderdate")
    status = F.col("o_orderstatus")
    lag = F.when(status == "P", 30).when(status == "F", 60).otherwise(90)
    kind = (
        F.when(status == "P", F.lit("preliminary"))
        .when(status == "F", F.lit("audited"))
        .otherwise(F.lit("restated"))
    )
    return table(spark, sf_dir, "orders").select(
        symbol_of(F.col("o_custkey")).alias("symbol"),
        quarter_end(day).alias("report_date"),
        F.date_add(day, lag).alias("publication_date"),
        F.date_add(day, lag).alias("known_as_of"),
        kind.alias("statement_kind"),
        k.alias("fact_id"),
        rev.alias("revenue"),
        (rev * 0.1).alias("net_income"),
        ((k % 40) / 100.0 - 0.05).alias("roe"),
        F.when(k % 11 == 0, -1.0 * (k % 7) - 1).otherwise(5.0 + k % 30).alias("pe"),
        F.when(k % 13 != 0, 0.5 + (k % 23) / 4.0).alias("pb"),
        ((k % 9) / 100.0).alias("dividend_yield"),
        F.when(k % 17 == 0, 0.0).otherwise(rev * (5 + k % 30)).alias("market_cap"),
        F.when(k % 17 == 0, 0.0).otherwise(rev * (3 + k % 20)).alias("market_cap_free_float"),
        (rev * 0.05).alias("capex"),
        (rev * 0.03).alias("d_and_a"),
        F.when(k % 19 != 0, rev * 0.01 * (k % 3)).alias("working_capital_change"),
        (rev * 2 - rev * (k % 5)).alias("total_equity"),
        (rev * (k % 4) * 0.5 + rev * 0.3).alias("total_debt"),
    )


def v_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            symbol_of(F.col("c_custkey")).alias("symbol"),
            F.col("c_mktsegment").alias("sector_l1"),
            F.col("n_name").alias("sector_l2"),
        )
    )


def v_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    still_open = (F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("index_name"),
        symbol_of(F.col("l_suppkey")).alias("symbol"),
        day.alias("effective_from"),
        F.when(~still_open, F.date_add(day, F.col("l_quantity").cast("int"))).alias("effective_to"),
        F.col("l_orderkey").alias("row_id"),
    )


def v_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .where(kind.isin("purchase", "signup"))
        .select(
            symbol_of(F.col("user_id")).alias("symbol"),
            F.to_date("ts").alias("ex_date"),
            F.when(kind == "purchase", F.lit("cash_dividend")).otherwise(F.lit("split")).alias("kind"),
            F.col("props").alias("params_json"),
            F.col("event_id").alias("action_id"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )
    )


def v_payout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash dividends over years: every third line of a shipment pays."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linenumber") == 3)
        .select(
            symbol_of(F.col("l_suppkey")).alias("symbol"),
            F.to_date("l_shipdate").alias("ex_date"),
            F.lit("cash_dividend").alias("kind"),
            F.to_json(F.struct((F.col("l_quantity") / 10.0).alias("amount_per_share"))).alias("params_json"),
            (F.col("l_quantity") / 10.0).alias("amount"),
        )
    )


def v_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .where(F.dayofmonth(day) % 3 == 0)
        .groupBy(day.alias("date"))
        .agg((0.85 + (F.avg("o_orderkey") % 100) / 1000).alias("cny_per_hkd"))
        .withColumn("pair", F.lit("CNY_HKD"))
    )


def v_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("exec_date"),
        symbol_of(F.col("l_partkey")).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", F.lit("sell")).otherwise(F.lit("buy")).alias("side"),
        F.col("l_quantity").cast("bigint").alias("shares"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_linestatus").alias("run_id"),
    )


def v_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("run_id"), F.to_date("o_orderdate").alias("date"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("nav"))
    )


def v_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select(
        F.explode(F.array(F.lit("SH"), F.lit("SZ"), F.lit("HK"))).alias("exchange"),
        "date",
        (F.weekday("date") < 5).alias("is_trading_day"),
    )


def v_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        symbol_of(F.col("l_suppkey")).alias("symbol"),
        day.alias("fetched_start"),
        F.date_add(day, (F.col("l_quantity") * 7).cast("int")).alias("fetched_end"),
    )


def v_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        symbol_of(F.col("o_custkey")).alias("symbol"),
        day.alias("start"),
        F.date_add(day, 200).alias("end"),
    )


def v_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing (supplier 3n) with the Hong Kong listing (supplier 3n + 2) next to it."""
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .where(key % 3 == 0)
        .select(
            symbol_of(key).alias("a"),
            F.when(key % 12 != 9, symbol_of(key + 2)).alias("h"),
            F.col("s_name").alias("name_en"),
        )
    )


def v_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def v_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def v_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing rows of a corpus: one document is one filing of the issuer its id maps to."""
    doc = F.col("doc_id")
    issuer = F.floor(doc / 4).cast("bigint")
    kind = F.when(doc % 4 < 2, F.lit("annual")).when(doc % 4 == 2, F.lit("ipo")).otherwise(F.lit("research"))
    year = (2010 + doc % 13).cast("int")
    return table(spark, sf_dir, "documents").select(
        symbol_of(issuer).alias("symbol"),
        kind.alias("kind"),
        F.when(doc % 4 < 2, year).alias("year"),
        F.concat(F.lit("doc "), doc.cast("string")).alias("title"),
        F.when(doc % 4 == 3, F.make_date(year, F.lit(6), (1 + doc % 28).cast("int"))).alias("date"),
        F.concat(F.lit("corpus/"), doc.cast("string"), F.lit(".md")).alias("path"),
        "text",
        "doc_id",
    )


def v_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile dates per issuer: one in three labelled documents has one."""
    doc = F.col("doc_id")
    return (
        table(spark, sf_dir, "labels")
        .where(F.col("quality") == 1)
        .select(
            symbol_of(F.floor(doc / 3).cast("bigint")).alias("symbol"),
            F.date_add(F.lit("2021-01-01").cast("date"), (doc % 900).cast("int")).alias("date"),
        )
    )


def v_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcement catalog: titles follow the order priority, issuers are customers."""
    k, day, pri = F.col("o_orderkey"), F.to_date("o_orderdate"), F.col("o_orderpriority")
    fy = (F.year(day) - 1).cast("string")
    title = (
        F.when(pri == "1-URGENT", F.concat(fy, F.lit("年年度报告（修订版）")))
        .when((pri == "2-HIGH") & (k % 5 == 0), F.concat(F.lit("关于取消"), fy, F.lit("年年度报告的公告")))
        .when((pri == "5-LOW") & (k % 7 == 0), F.concat(fy, F.lit("年年度报告更正公告")))
        .when((pri == "4-NOT SPECIFIED") & (k % 3 == 0), F.concat(fy, F.lit("年年度报告摘要")))
        .when((pri == "4-NOT SPECIFIED") & (k % 3 == 1), F.lit("招股说明书（修订稿）"))
        .otherwise(F.concat(fy, F.lit("年年度报告")))
    )
    return table(spark, sf_dir, "orders").select(
        symbol_of(F.col("o_custkey")).alias("issuer"),
        k.cast("string").alias("announcement_id"),
        day.alias("announced"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400).alias("announced_s"),
        title.alias("title"),
    )


def v_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulatory-event records: an event row is one report of an event on one subject."""
    e, u = F.col("event_id"), F.col("user_id")
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("record_id"),
        F.concat(F.lit("s"), (e % 4).cast("string")).alias("source_id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("Case  "), (F.floor(u / 2)).cast("string"), F.lit(" "), F.col("event_type")).alias("title"),
        F.concat(F.lit("p"), u.cast("string")).alias("subject_id"),
        day.alias("occurrence_date"),
        F.date_add(day, (e % 5).cast("int")).alias("publication_date"),
        F.date_add(day, (e % 9).cast("int")).alias("effective_date"),
        F.when(e % 3 == 0, F.lit("open")).otherwise(F.lit("closed")).alias("status"),
        F.when(e % 2 == 0, F.lit("director")).otherwise(F.lit("supervisor")).alias("role"),
    )


def v_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenure segments per person and role: one per customer key, some open, some doubled."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 11).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.floor(k / 2).cast("bigint").cast("string")).alias("person_id"),
        F.when(k % 4 < 2, F.lit("director")).otherwise(F.lit("supervisor")).alias("role"),
        start.alias("tenure_start"),
        F.when(k % 3 != 0, F.date_add(start, (k % 17).cast("int"))).alias("tenure_end"),
        k.alias("segment_id"),
    )


def v_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence series: yearly values per claim and source, rounded so that sources can agree."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("claim_id"),
            F.concat(F.lit("src-"), F.lower(F.col("o_orderstatus"))).alias("source_id"),
            F.year("o_orderdate").alias("period"),
            F.round(F.col("o_totalprice") / 100000, 0).alias("amount"),
        )
        .groupBy("claim_id", "source_id", "period")
        .agg(F.max("amount").alias("value"))
    )


SQL_VIEWS: dict[str, str] = {
    "v_px": f"""
        SELECT CAST(ts AS DATE) AS date, {_sql_symbol('user_id')} AS symbol,
               first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
               last(value ORDER BY ts, event_id) AS close, count(*) AS volume, round(sum(value), 2) AS amount
        FROM events GROUP BY 1, 2""",
    "v_bar": f"""
        SELECT date, symbol, first(p ORDER BY l_orderkey, l_linenumber, l_partkey, p) AS open,
               max(p) AS high, min(p) AS low,
               last(p ORDER BY l_orderkey, l_linenumber, l_partkey, p) AS close,
               CAST(sum(l_quantity) AS BIGINT) AS volume, round(sum(l_extendedprice), 2) AS amount
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, {_sql_symbol('l_suppkey')} AS symbol,
                     l_extendedprice / l_quantity AS p, * FROM lineitem) GROUP BY 1, 2""",
    "v_fund": f"""
        SELECT {_sql_symbol('o_custkey')} AS symbol,
               CAST(last_day(date_trunc('quarter', o_orderdate)::DATE + INTERVAL 2 MONTH) AS DATE) AS report_date,
               CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'P' THEN 30 WHEN 'F' THEN 60 ELSE 90 END AS publication_date,
               CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'P' THEN 30 WHEN 'F' THEN 60 ELSE 90 END AS known_as_of,
               CASE o_orderstatus WHEN 'P' THEN 'preliminary' WHEN 'F' THEN 'audited' ELSE 'restated' END AS statement_kind,
               o_orderkey AS fact_id, o_totalprice AS revenue, o_totalprice * 0.1::DOUBLE AS net_income,
               (o_orderkey % 40) / 100.0::DOUBLE - 0.05::DOUBLE AS roe,
               CASE WHEN o_orderkey % 11 = 0 THEN -1.0::DOUBLE * (o_orderkey % 7) - 1 ELSE 5.0::DOUBLE + o_orderkey % 30 END AS pe,
               CASE WHEN o_orderkey % 13 <> 0 THEN 0.5::DOUBLE + (o_orderkey % 23) / 4.0::DOUBLE END AS pb,
               (o_orderkey % 9) / 100.0::DOUBLE AS dividend_yield,
               CASE WHEN o_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE o_totalprice * (5 + o_orderkey % 30) END AS market_cap,
               CASE WHEN o_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE o_totalprice * (3 + o_orderkey % 20) END AS market_cap_free_float,
               o_totalprice * 0.05::DOUBLE AS capex, o_totalprice * 0.03::DOUBLE AS d_and_a,
               CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice * 0.01::DOUBLE * (o_orderkey % 3) END AS working_capital_change,
               o_totalprice * 2 - o_totalprice * (o_orderkey % 5) AS total_equity,
               o_totalprice * (o_orderkey % 4) * 0.5::DOUBLE + o_totalprice * 0.3::DOUBLE AS total_debt
        FROM orders""",
    "v_sector": f"""
        SELECT {_sql_symbol('c_custkey')} AS symbol, c_mktsegment AS sector_l1, n_name AS sector_l2
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_member": f"""
        SELECT l_returnflag AS index_name, {_sql_symbol('l_suppkey')} AS symbol,
               CAST(l_shipdate AS DATE) AS effective_from,
               CASE WHEN l_linenumber = 1 AND l_linestatus = 'O' THEN NULL
                    ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS effective_to,
               l_orderkey AS row_id
        FROM lineitem""",
    "v_action": f"""
        SELECT {_sql_symbol('user_id')} AS symbol, CAST(ts AS DATE) AS ex_date,
               CASE event_type WHEN 'purchase' THEN 'cash_dividend' ELSE 'split' END AS kind,
               props AS params_json, event_id AS action_id,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "v_payout": f"""
        SELECT {_sql_symbol('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS ex_date,
               'cash_dividend' AS kind, l_quantity / 10.0::DOUBLE AS amount
        FROM lineitem WHERE l_linenumber = 3""",
    "v_fx": """
        SELECT CAST(o_orderdate AS DATE) AS date, 0.85::DOUBLE + (avg(o_orderkey) % 100) / 1000 AS cny_per_hkd,
               'CNY_HKD' AS pair
        FROM orders WHERE day(o_orderdate) % 3 = 0 GROUP BY 1""",
    "v_trade": f"""
        SELECT CAST(l_shipdate AS DATE) AS exec_date, {_sql_symbol('l_partkey')} AS symbol,
               CASE l_returnflag WHEN 'A' THEN 'sell' ELSE 'buy' END AS side,
               CAST(l_quantity AS BIGINT) AS shares, l_extendedprice AS notional,
               l_extendedprice / l_quantity AS price, l_linestatus AS run_id
        FROM lineitem""",
    "v_nav": """
        SELECT o_orderpriority AS run_id, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS nav
        FROM orders GROUP BY 1, 2""",
    "v_calendar": """
        SELECT unnest(['SH', 'SZ', 'HK']) AS exchange, date, isodow(date) < 6 AS is_trading_day
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""",
    "v_fetch": f"""
        SELECT {_sql_symbol('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS fetched_start,
               CAST(l_shipdate AS DATE) + CAST(l_quantity * 7 AS INTEGER) AS fetched_end
        FROM lineitem""",
    "v_request": f"""
        SELECT o_orderkey AS request_id, {_sql_symbol('o_custkey')} AS symbol,
               CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 200 AS "end"
        FROM orders""",
    "v_pair": f"""
        SELECT {_sql_symbol('s_suppkey')} AS a,
               CASE WHEN s_suppkey % 12 <> 9 THEN {_sql_symbol('(s_suppkey + 2)')} END AS h, s_name AS name_en
        FROM supplier WHERE s_suppkey % 3 = 0""",
    "v_page": "SELECT * FROM pages",
    "v_turn": "SELECT * FROM conversations",
    "v_filing": f"""
        SELECT {_sql_symbol('(doc_id // 4)')} AS symbol,
               CASE WHEN doc_id % 4 < 2 THEN 'annual' WHEN doc_id % 4 = 2 THEN 'ipo' ELSE 'research' END AS kind,
               CASE WHEN doc_id % 4 < 2 THEN CAST(2010 + doc_id % 13 AS INTEGER) END AS year,
               'doc ' || doc_id AS title,
               CASE WHEN doc_id % 4 = 3 THEN make_date(2010 + doc_id % 13, 6, 1 + doc_id % 28) END AS date,
               'corpus/' || doc_id || '.md' AS path, text, doc_id
        FROM documents""",
    "v_profile": f"""
        SELECT {_sql_symbol('(doc_id // 3)')} AS symbol,
               DATE '2021-01-01' + CAST(doc_id % 900 AS INTEGER) AS date
        FROM labels WHERE quality = 1""",
    "v_catalog": f"""
        SELECT {_sql_symbol('o_custkey')} AS issuer, CAST(o_orderkey AS VARCHAR) AS announcement_id,
               CAST(o_orderdate AS DATE) AS announced,
               CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS announced_s,
               CASE WHEN o_orderpriority = '1-URGENT' THEN (year(o_orderdate) - 1) || '年年度报告（修订版）'
                    WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0
                         THEN '关于取消' || (year(o_orderdate) - 1) || '年年度报告的公告'
                    WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0
                         THEN (year(o_orderdate) - 1) || '年年度报告更正公告'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0
                         THEN (year(o_orderdate) - 1) || '年年度报告摘要'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 1 THEN '招股说明书（修订稿）'
                    ELSE (year(o_orderdate) - 1) || '年年度报告' END AS title
        FROM orders""",
    "v_event": """
        SELECT CAST(event_id AS VARCHAR) AS record_id, 's' || (event_id % 4) AS source_id, event_type AS category,
               'Case  ' || (user_id // 2) || ' ' || event_type AS title, 'p' || user_id AS subject_id,
               CAST(ts AS DATE) AS occurrence_date,
               CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) AS publication_date,
               CAST(ts AS DATE) + CAST(event_id % 9 AS INTEGER) AS effective_date,
               CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'closed' END AS status,
               CASE WHEN event_id % 2 = 0 THEN 'director' ELSE 'supervisor' END AS role
        FROM events""",
    "v_roster": """
        SELECT 'p' || (c_custkey // 2) AS person_id,
               CASE WHEN c_custkey % 4 < 2 THEN 'director' ELSE 'supervisor' END AS role,
               DATE '2024-01-01' + CAST(c_custkey % 11 AS INTEGER) AS tenure_start,
               CASE WHEN c_custkey % 3 <> 0
                    THEN DATE '2024-01-01' + CAST(c_custkey % 11 AS INTEGER) + CAST(c_custkey % 17 AS INTEGER) END AS tenure_end,
               c_custkey AS segment_id
        FROM customer""",
    "v_series": """
        SELECT 'c' || o_custkey AS claim_id, 'src-' || lower(o_orderstatus) AS source_id,
               year(o_orderdate) AS period, max(round(o_totalprice / 100000, 0)) AS value
        FROM orders GROUP BY 1, 2, 3""",
}
