"""Queries of catalogs, events and evidence."""

from __future__ import annotations

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.operators import catalog as ca, evidence as ev
from tidemark.plans import views as v
from tidemark.plans.registry import query

CUT, END_YEAR, N_YEARS = D(2001, 3, 31), 2000, 4
SQL_CLASS = """cl AS (SELECT *, CASE WHEN regexp_matches(title, '[0-9]{4}年年度报告') THEN CAST(regexp_extract(title, '([0-9]{4})', 1) AS INTEGER) END AS fiscal_year, CASE WHEN contains(title, '修订版') THEN 1 ELSE 0 END AS revised FROM v_catalog),
    k AS (SELECT *, (announced_s, CAST(announcement_id AS BIGINT), revised) AS key, CASE WHEN announced > DATE '2001-03-31' THEN 'after_cutoff' WHEN contains(title, '取消') THEN 'cancellation' WHEN contains(title, '更正公告') THEN 'correction_notice'
      WHEN contains(title, '摘要') OR fiscal_year IS NULL THEN 'excluded' WHEN fiscal_year > 2000 THEN 'after_target_year' ELSE 'candidate' END AS class FROM cl)"""
SQL_BIND = SQL_CLASS + """, bd AS (SELECT *, coalesce(last_value(CASE WHEN class NOT IN ('cancellation', 'correction_notice', 'excluded', 'after_cutoff') THEN announcement_id END IGNORE NULLS) OVER w,
      first_value(CASE WHEN class = 'cancellation' THEN announcement_id END IGNORE NULLS) OVER w) AS target_id FROM k WHERE fiscal_year IS NOT NULL WINDOW w AS (PARTITION BY issuer, fiscal_year ORDER BY announced_s, CAST(announcement_id AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    dead AS (SELECT DISTINCT issuer, fiscal_year, target_id AS announcement_id FROM bd WHERE class = 'cancellation' AND (issuer, fiscal_year, target_id) IN (SELECT (issuer, fiscal_year, announcement_id) FROM k WHERE class = 'candidate')),
    la AS (SELECT issuer, fiscal_year, arg_max(announcement_id, (announced_s, CAST(announcement_id AS BIGINT))) AS latest, max(announced_s) AS latest_s FROM k WHERE class = 'candidate' GROUP BY 1, 2)"""


@query("annual_catalog_select", f"""WITH {SQL_BIND}, al AS (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY fiscal_year DESC) AS r FROM la WHERE (issuer, fiscal_year, latest) NOT IN (SELECT (issuer, fiscal_year, announcement_id) FROM dead))
    SELECT k.issuer, k.announcement_id, k.fiscal_year, title, CASE WHEN class <> 'candidate' THEN class WHEN latest = k.announcement_id AND r <= 4 THEN 'selected' WHEN dead.issuer IS NOT NULL THEN 'cancelled'
      WHEN latest IS NOT NULL AND latest <> k.announcement_id THEN 'superseded' ELSE 'outside_window' END AS status
    FROM k LEFT JOIN dead USING (issuer, fiscal_year, announcement_id) LEFT JOIN al ON al.issuer = k.issuer AND al.fiscal_year = k.fiscal_year""")
def annual_catalog_select(spark, sf):
    return ca.annual_catalog_select(v.v_catalog(spark, sf), CUT, END_YEAR, N_YEARS)


def _classified(spark, sf):
    return ca.classify(v.v_catalog(spark, sf), CUT, END_YEAR)


@query("bind_replacements", f"WITH {SQL_BIND} SELECT issuer, fiscal_year, announcement_id, target_id FROM bd WHERE class IN ('cancellation', 'correction_notice') OR revised = 1")
def bind_replacements(spark, sf):
    return ca.bind_replacements(_classified(spark, sf)).select("issuer", "fiscal_year", "announcement_id", "target_id")


@query("cancellation_apply", f"WITH {SQL_BIND} SELECT * FROM dead")
def cancellation_apply(spark, sf):
    return ca.cancelled_reports(_classified(spark, sf))


@query("latest_fiscal_years", f"WITH {SQL_BIND} SELECT issuer, fiscal_year FROM la QUALIFY dense_rank() OVER (PARTITION BY issuer ORDER BY fiscal_year DESC) <= 3")
def latest_fiscal_years(spark, sf):
    from tidemark.operators.ranking import top_k
    return top_k(ca.latest_candidates(_classified(spark, sf)).select("issuer", "fiscal_year"), ["issuer"], 3, [F.desc("fiscal_year")])


@query("correction_without_revision", f"""WITH {SQL_BIND}, n AS (SELECT issuer, fiscal_year, arg_max(announcement_id, (announced_s, CAST(announcement_id AS BIGINT))) AS notice_id, max(announced_s) AS ns FROM k WHERE class = 'correction_notice' GROUP BY 1, 2)
    SELECT n.issuer, n.fiscal_year, notice_id FROM n JOIN la USING (issuer, fiscal_year) WHERE (ns, CAST(notice_id AS BIGINT)) > (latest_s, CAST(latest AS BIGINT)) AND NOT EXISTS (SELECT 1 FROM k WHERE k.issuer = n.issuer AND k.fiscal_year = n.fiscal_year AND class = 'candidate' AND revised = 1
      AND ((k.announced_s, CAST(k.announcement_id AS BIGINT)) > (ns, CAST(notice_id AS BIGINT)) OR (CAST(notice_id AS BIGINT) - CAST(k.announcement_id AS BIGINT) = 1 AND ns - k.announced_s BETWEEN 0 AND 300)))""")
def correction_without_revision(spark, sf):
    return ca.correction_without_revision(v.v_catalog(spark, sf), CUT, END_YEAR)


@query("prospectus_select", "SELECT issuer, announcement_id, title FROM v_catalog WHERE title = '招股说明书（修订稿）' AND announced <= DATE '1999-06-30'")
def prospectus_select(spark, sf):
    return ca.prospectus_select(v.v_catalog(spark, sf), D(1999, 6, 30)).select("issuer", "announcement_id", "title")


@query("parse_announcements", "SELECT issuer, announcement_id, title, CAST(to_timestamp(announced_s) AT TIME ZONE 'Asia/Shanghai' AS DATE) AS announced FROM v_catalog")
def parse_announcements(spark, sf):
    item = F.struct(F.lit("600000").alias("secCode"), F.lit("o").alias("orgId"), F.col("announcement_id").alias("announcementId"), F.col("title").alias("announcementTitle"), (F.col("announced_s") * 1000).alias("announcementTime"), F.lit("u").alias("adjunctUrl"))
    packed = v.v_catalog(spark, sf).select("issuer", F.to_json(F.struct(F.lit(1).alias("totalAnnouncement"), F.array(item).alias("announcements"))).alias("payload"))
    return ca.parse_announcements_a(packed).select("issuer", "announcement_id", "title", "announced")


@query("parse_announcements_hk", "SELECT issuer, announcement_id, title, announced, announced_s % 50 = 0 AS malformed FROM (SELECT issuer, announcement_id, title, announced_s, CASE WHEN announced_s % 50 <> 0 THEN announced END AS announced FROM v_catalog)")
def parse_announcements_hk(spark, sf):
    stamp = F.when(F.col("announced_s") % 50 == 0, F.lit("soon")).otherwise(F.date_format("announced", "dd/MM/yyyy 09:30"))
    item = F.struct(F.col("announcement_id").alias("NEWS_ID"), stamp.alias("DATE_TIME"), F.lit("00700").alias("STOCK_CODE"), F.col("title").alias("TITLE"), F.lit("f").alias("FILE_LINK"))
    packed = v.v_catalog(spark, sf).select("issuer", F.to_json(F.struct(F.to_json(F.array(item)).alias("result"))).alias("payload"))
    return ca.parse_announcements_hk(packed).select("issuer", "announcement_id", "title", "announced", "malformed")


@query("latest_compatible_run", "SELECT o_custkey AS input_id, arg_max(o_orderkey, (CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1")
def latest_compatible_run(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    runs = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("input_id"), status.alias("status"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("version"))
    return ca.latest_compatible_run(runs, ["input_id"]).select("input_id", "version")


@query("snapshot_drift", """WITH s AS (SELECT date, symbol, close, volume FROM v_bar WHERE volume % 9 <> 0), f AS (SELECT date, symbol, CASE WHEN volume % 5 = 0 THEN high ELSE close END AS close, CASE WHEN volume % 7 = 0 THEN 0 ELSE volume END AS volume FROM v_bar WHERE volume % 8 <> 0)
    SELECT date, symbol, CASE WHEN s.volume IS NULL THEN ['added'] WHEN f.volume IS NULL THEN ['removed'] ELSE [x FOR x IN [CASE WHEN s.close <> f.close THEN 'close' END, CASE WHEN s.volume <> f.volume THEN 'volume' END] IF x IS NOT NULL] END AS drift
    FROM s FULL JOIN f USING (date, symbol) WHERE s.volume IS NULL OR f.volume IS NULL OR s.close <> f.close OR s.volume <> f.volume""")
def snapshot_drift(spark, sf):
    bars = v.v_bar(spark, sf)
    fresh = bars.where("volume % 8 <> 0").select("date", "symbol", F.when(F.col("volume") % 5 == 0, F.col("high")).otherwise(F.col("close")).alias("close"), F.when(F.col("volume") % 7 == 0, 0).otherwise(F.col("volume")).cast("bigint").alias("volume"))
    return ca.snapshot_drift(bars.where("volume % 9 <> 0").select("date", "symbol", "close", "volume"), fresh, ["date", "symbol"], ["close", "volume"])


@query("ttl_precedence", """WITH o AS (SELECT o_custkey AS route_id, CASE o_orderstatus WHEN 'P' THEN 'cache' WHEN 'F' THEN 'snapshot' ELSE 'default' END AS layer, CAST(o_orderdate AS DATE) AS observed, o_orderkey AS value FROM orders)
    SELECT route_id, arg_max(layer, k) AS layer, arg_max(value, k) AS value FROM (SELECT *, (CASE layer WHEN 'cache' THEN 3 WHEN 'snapshot' THEN 2 ELSE 1 END, observed, value) AS k FROM o WHERE layer <> 'cache' OR (observed <= DATE '1999-06-30' AND DATE '1999-06-30' - observed <= 365)) GROUP BY 1""")
def ttl_precedence(spark, sf):
    layer = F.when(F.col("o_orderstatus") == "P", "cache").when(F.col("o_orderstatus") == "F", "snapshot").otherwise("default")
    obs = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("route_id"), layer.alias("layer"), F.to_date("o_orderdate").alias("observed"), F.lit(365).alias("ttl_days"), F.col("o_orderkey").alias("value"))
    return ca.ttl_precedence(obs, ["route_id"], F.lit(D(1999, 6, 30))).select("route_id", "layer", "value")


# --- events -----------------------------------------------------------------------------------


@query("page_completeness", """WITH p AS (SELECT l_orderkey AS query_id, l_linenumber AS page, 4 + l_orderkey % 3 AS page_count, 60 + l_orderkey % 2 AS total, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
    g AS (SELECT query_id, count(*) AS c, count(DISTINCT page) AS d, min(page) AS a, max(page) AS b, max(page_count) AS pc, max(total) AS t, sum(n) AS s FROM p GROUP BY 1)
    SELECT query_id, [x FOR x IN [CASE WHEN c <> d THEN 'duplicate_page' END, CASE WHEN a <> 1 OR b <> pc OR d <> pc THEN 'missing_page' END, CASE WHEN s <> t THEN 'row_total' END] IF x IS NOT NULL] AS violations FROM g WHERE c <> d OR a <> 1 OR b <> pc OR d <> pc OR s <> t""")
def page_completeness(spark, sf):
    k = F.col("l_orderkey")
    return ev.page_completeness(v.table(spark, sf, "lineitem").select(k.alias("query_id"), F.col("l_linenumber").alias("page"), (4 + k % 3).alias("page_count"), (60 + k % 2).alias("total"), F.col("l_quantity").cast("bigint").alias("rows")))


@query("event_merge", """SELECT lower(regexp_replace(title, '\\s+', ' ', 'g')) AS title, occurrence_date, category, count(DISTINCT (source_id, subject_id)) AS n_provenance, min(source_id) AS first_source FROM v_event GROUP BY 1, 2, 3""")
def event_merge(spark, sf):
    out = ev.event_merge(v.v_event(spark, sf), ["title", "occurrence_date", "category"], ["source_id", "subject_id"])
    return out.select("title", "occurrence_date", "category", F.size("provenance").cast("bigint").alias("n_provenance"), F.col("provenance")[0]["source_id"].alias("first_source"))


@query("event_window_filter", "SELECT record_id, status FROM v_event WHERE greatest(occurrence_date, publication_date, effective_date) <= DATE '2024-01-25' AND (least(occurrence_date, publication_date) >= DATE '2024-01-10' OR status = 'open')")
def event_window_filter(spark, sf):
    return ev.event_window_filter(v.v_event(spark, sf), D(2024, 1, 10), D(2024, 1, 25)).select("record_id", "status")


@query("event_exchange_dates", f"SELECT event_id AS record_id, {v._sql_symbol('user_id')} AS symbol, CAST(CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) AS publication_date FROM events")
def event_exchange_dates(spark, sf):
    symbol = v.symbol_of(F.col("user_id"))
    day = ev.exchange_date(F.col("ts").cast("timestamp"), F.substring_index(symbol, ".", -1))
    return v.table(spark, sf, "events").select(F.col("event_id").alias("record_id"), symbol.alias("symbol"), day.alias("publication_date"))


@query("event_rules", "SELECT record_id, category, status FROM v_event WHERE (category, status) NOT IN (SELECT (event_type, 'open') FROM events WHERE event_type IN ('click', 'view')) AND NOT (status = 'closed' AND category <> 'error')")
def event_rules(spark, sf):
    e = v.v_event(spark, sf)
    rules = e.where("category IN ('click', 'view') OR (category <> 'error' AND status = 'closed')").select("category", "status")
    return ev.event_rules(e, rules, ["category", "status"]).select("record_id", "category", "status")


@query("tenure_match", """WITH h AS (SELECT e.record_id, e.subject_id, e.role, count(*) AS n, min(r.segment_id) AS s FROM v_event e JOIN v_roster r ON r.person_id = e.subject_id AND r.role = e.role AND r.tenure_start <= e.occurrence_date AND (r.tenure_end IS NULL OR r.tenure_end >= e.occurrence_date) GROUP BY 1, 2, 3)
    SELECT e.record_id, e.subject_id AS person_id, CASE WHEN e.subject_id NOT IN (SELECT person_id FROM v_roster) THEN 'unknown_person' WHEN n IS NULL THEN 'no_segment' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match, CASE WHEN n = 1 THEN s END AS segment_id FROM v_event e LEFT JOIN h USING (record_id, subject_id, role)""")
def tenure_match(spark, sf):
    return ev.tenure_match(v.v_event(spark, sf), v.v_roster(spark, sf))


@query("active_listings", "SELECT segment_id, CASE WHEN tenure_start > DATE '2024-01-08' THEN 'future' WHEN tenure_end <= DATE '2024-01-08' THEN 'historical' ELSE 'active' END AS listing_state FROM v_roster")
def active_listings(spark, sf):
    rows = v.v_roster(spark, sf).withColumnsRenamed({"tenure_start": "listed_from", "tenure_end": "listed_to"})
    return ev.active_listings(rows, F.lit(D(2024, 1, 8))).select("segment_id", "listing_state")


@query("required_sources", "WITH s AS (SELECT DISTINCT subject_id, category FROM v_event), q AS (SELECT DISTINCT category, source_id FROM v_event), p AS (SELECT DISTINCT subject_id, source_id FROM v_event WHERE category = 'error' AND status = 'open') SELECT s.subject_id, s.category, q.source_id FROM s JOIN q USING (category) WHERE (s.subject_id, q.source_id) NOT IN (SELECT (subject_id, source_id) FROM p)")
def required_sources(spark, sf):
    e = v.v_event(spark, sf)
    out = ev.required_sources(e.select("subject_id", "category").distinct(), e.select("category", "source_id").distinct(), e.where("category = 'error' AND status = 'open'").select("subject_id", "source_id"), ["category"])
    return out.select("subject_id", "category", "source_id")


@query("roster_coverage", """WITH c AS (SELECT person_id AS issuer, min(tenure_start) AS a, max(coalesce(tenure_end, DATE '2024-12-31')) AS b, bool_or(role = 'director') AS d, bool_or(role = 'supervisor') AS s FROM v_roster GROUP BY 1), l AS (SELECT subject_id AS issuer, min(occurrence_date) AS f, max(occurrence_date) AS t FROM v_event GROUP BY 1)
    SELECT issuer, coalesce(a <= f AND b >= t, false) AS covered, [x FOR x IN [CASE WHEN d IS NOT TRUE THEN 'director' END, CASE WHEN s IS NOT TRUE THEN 'supervisor' END] IF x IS NOT NULL] AS missing_roles FROM l LEFT JOIN c USING (issuer)""")
def roster_coverage(spark, sf):
    cover = v.v_roster(spark, sf).select(F.col("person_id").alias("issuer"), F.col("tenure_start").alias("start"), F.coalesce("tenure_end", F.lit(D(2024, 12, 31))).alias("end"), "role")
    listings = v.v_event(spark, sf).groupBy(F.col("subject_id").alias("issuer")).agg(F.min("occurrence_date").alias("listed_from"), F.max("occurrence_date").alias("listed_to"))
    return ev.roster_coverage(cover, listings, ["director", "supervisor"])


@query("observation_freshness", """WITH o AS (SELECT symbol, date_add(max(date), INTERVAL (hash_day) DAY)::DATE AS date FROM (SELECT symbol, date, 0 AS hash_day FROM v_px) GROUP BY symbol, hash_day)
    SELECT a.symbol, a.date, CASE WHEN a.date > DATE '2024-01-28' THEN 'future' WHEN a.date <> o.date THEN 'not_latest' WHEN DATE '2024-01-28' - a.date > 3 THEN 'stale' END AS failure FROM v_px a JOIN o USING (symbol)""")
def observation_freshness(spark, sf):
    px = v.v_px(spark, sf).select("symbol", "date")
    return ev.observation_freshness(px, px, ["symbol"], F.lit(D(2024, 1, 28)), 3)


# --- evidence ---------------------------------------------------------------------------------


@query("scope_fingerprint", "SELECT p_partkey, sha256('{\"p_brand\":\"' || lower(trim(p_brand)) || '\",\"p_type\":\"' || lower(trim(p_type)) || '\"}') AS scope_fingerprint FROM part")
def scope_fingerprint(spark, sf):
    return ev.scope_fingerprint(v.table(spark, sf, "part"), ["p_type", "p_brand"]).select("p_partkey", "scope_fingerprint")


S = ["claim_id", "source_id"]


@query("series_continuity", "WITH s AS (SELECT claim_id, source_id, unnest(range(min(period), max(period) + 1)) AS period FROM v_series GROUP BY 1, 2) SELECT claim_id, source_id, period FROM s WHERE (claim_id, source_id, period) NOT IN (SELECT (claim_id, source_id, period) FROM v_series)")
def series_continuity(spark, sf):
    return ev.series_continuity(v.v_series(spark, sf), S)


@query("series_freshness", "SELECT claim_id, source_id, max(period) AS latest_period, max(period) >= 2000 AS fresh FROM v_series GROUP BY 1, 2")
def series_freshness(spark, sf):
    return ev.series_freshness(v.v_series(spark, sf), S, 2001, 1)


# Quotes of a claim in the units of their sources: mostly one value a year, some of them wrong, some sources far apart.
SQL_QUOTES = """q AS (SELECT claim_id, source_id, period, max(v) AS v FROM (SELECT o_custkey AS claim_id, o_orderpriority AS source_id, year(o_orderdate) AS period, o_custkey % 7 + year(o_orderdate) - 1990 + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END AS v
    FROM orders WHERE (o_custkey + year(o_orderdate)) % 5 < 2) GROUP BY 1, 2, 3)"""


def _quotes(spark, sf):
    o = v.table(spark, sf, "orders")
    year = F.year("o_orderdate")
    rows = o.where((F.col("o_custkey") + year) % 5 < 2).select(
        F.col("o_custkey").alias("claim_id"), F.col("o_orderpriority").alias("source_id"), year.alias("period"),
        (F.col("o_custkey") % 7 + year - 1990 + F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)).cast("double").alias("v"))
    unit = F.when(F.col("source_id").startswith("1"), "thousand").when(F.col("source_id").startswith("2"), "percent").otherwise("one")
    factor = F.when(F.col("unit") == "thousand", 1000.0).when(F.col("unit") == "percent", 0.01).otherwise(1.0)
    return rows.groupBy("claim_id", "source_id", "period").agg(F.max("v").alias("v")).withColumn("unit", unit).withColumn("value", F.col("v") / factor).drop("v")


@query("series_stitch", f"WITH RECURSIVE {SQL_QUOTES}, link AS (SELECT DISTINCT x.claim_id, x.source_id AS a, y.source_id AS b FROM q x JOIN q y USING (claim_id, period)), reach AS (SELECT * FROM link UNION SELECT r.claim_id, r.a, l.b FROM reach r JOIN link l ON l.claim_id = r.claim_id AND l.a = r.b), "
       "n AS (SELECT claim_id, count(DISTINCT source_id) AS n FROM q GROUP BY 1), whole AS (SELECT claim_id, n FROM reach JOIN n USING (claim_id) GROUP BY 1, 2 HAVING count(DISTINCT (a, b)) = n * n), p AS (SELECT claim_id, period, count(DISTINCT v) AS k, arg_min(v, source_id) AS value, min(source_id) AS source_id FROM q GROUP BY 1, 2) "
       "SELECT claim_id, period, value::DOUBLE AS value, source_id, CASE WHEN n > 1 THEN 'stitched' ELSE 'single' END AS series_form FROM p JOIN whole USING (claim_id) WHERE claim_id NOT IN (SELECT claim_id FROM p WHERE k > 1)")
def series_stitch(spark, sf):
    units = spark.createDataFrame([("one", "one", 1.0), ("thousand", "one", 1000.0), ("percent", "one", 0.01)], "unit string, canonical_unit string, factor double")
    return ev.series_stitch(_quotes(spark, sf), "claim_id", units)


# The same orders as series at quarters and months, and some whose labels mix both.
SQL_PERIODS = "pp AS (SELECT DISTINCT o_custkey AS claim_id, o_orderstatus AS source_id, CASE WHEN o_custkey % 3 = 0 OR (o_custkey % 3 = 2 AND o_orderkey % 2 = 0) THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) WHEN o_custkey % 11 = 1 AND o_orderkey % 7 = 0 THEN 'FY' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m') END AS period FROM orders)"


def _periods(spark, sf):
    o, day, c = v.table(spark, sf, "orders"), F.col("o_orderdate"), F.col("o_custkey")
    quarter = F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    label = F.when((c % 3 == 0) | ((c % 3 == 2) & (F.col("o_orderkey") % 2 == 0)), quarter).when((c % 11 == 1) & (F.col("o_orderkey") % 7 == 0), F.concat(F.lit("FY"), F.year(day).cast("string"))).otherwise(F.date_format(day, "yyyy-MM"))
    return o.select(c.alias("claim_id"), F.col("o_orderstatus").alias("source_id"), label.alias("period")).distinct()


@query("series_gaps_by_frequency", f"WITH {SQL_PERIODS}, n AS (SELECT claim_id, source_id, CASE WHEN period LIKE '%Q%' THEN 'Q' ELSE 'M' END AS f, CASE WHEN period LIKE '%Q%' THEN left(period, 4)::INT * 4 + right(period, 1)::INT - 1 ELSE left(period, 4)::INT * 12 + right(period, 2)::INT - 1 END AS n FROM pp WHERE period NOT LIKE 'FY%'), "
       "s AS (SELECT claim_id, source_id, f, unnest(range(min(n), max(n) + 1)) AS n FROM n GROUP BY 1, 2, 3) SELECT claim_id, source_id, CASE f WHEN 'Q' THEN (n // 4) || 'Q' || (n % 4 + 1) ELSE (n // 12) || '-' || lpad((n % 12 + 1)::VARCHAR, 2, '0') END AS period FROM s ANTI JOIN n USING (claim_id, source_id, f, n)")
def series_gaps_by_frequency(spark, sf):
    return ev.series_continuity(_periods(spark, sf), S)


@query("series_frequency", f"WITH {SQL_PERIODS}, k AS (SELECT claim_id, source_id, CASE WHEN period LIKE 'FY%' THEN NULL WHEN period LIKE '%Q%' THEN 'Q' ELSE 'M' END AS f FROM pp), g AS (SELECT claim_id, source_id, min(f) AS f, count(DISTINCT f) AS n, bool_or(f IS NULL) AS odd FROM k GROUP BY 1, 2) "
       "SELECT claim_id, source_id, CASE WHEN odd OR n > 1 THEN NULL ELSE f END AS frequency, CASE WHEN odd THEN 'unknown' WHEN n > 1 THEN 'mixed' WHEN f <> 'M' THEN 'frequency' END AS failure FROM g")
def series_frequency(spark, sf):
    return ev.series_frequency(_periods(spark, sf), S, "M")


@query("vintage_freshness", "SELECT l_partkey AS claim_id, max(l_shipdate)::DATE AS vintage, CASE WHEN bool_or(l_quantity::INT % 25 = 0) OR max(l_shipdate) > DATE '2001-09-01' THEN 'future' WHEN date_diff('day', max(l_shipdate), DATE '2001-09-01') > 90 THEN 'stale' END AS failure FROM lineitem GROUP BY 1")
def vintage_freshness(spark, sf):
    day = F.to_date("l_shipdate")
    printed = F.date_add(day, F.col("l_quantity").cast("int") % 25 - 1)  # some are dated after their print
    rows = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("claim_id"), day.alias("vintage"), printed.alias("published_at"))
    return ev.vintage_freshness(rows, ["claim_id"], F.lit("2001-09-01").cast("date"), 90)


SQL_STRENGTH = "st AS (SELECT source_id, CASE source_id WHEN 'src-p' THEN 1 WHEN 'src-f' THEN 2 ELSE 2 END AS authority, CASE source_id WHEN 'src-p' THEN 3 WHEN 'src-f' THEN 2 ELSE 1 END AS directness FROM (SELECT DISTINCT source_id FROM v_series)), r AS (SELECT v_series.*, authority, directness FROM v_series JOIN st USING (source_id))"


@query("series_conflict", f"WITH {SQL_STRENGTH} SELECT claim_id, period, count(DISTINCT value) AS n_values FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.claim_id = r.claim_id AND o.period = r.period AND o.authority >= r.authority AND o.directness >= r.directness AND (o.authority > r.authority OR o.directness > r.directness)) GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def series_conflict(spark, sf):
    s = v.v_series(spark, sf)
    weak = F.col("source_id") == "src-p"
    strength = s.select("source_id").distinct().select("source_id", F.when(weak, 1).otherwise(2).alias("authority"), F.when(weak, 3).when(F.col("source_id") == "src-f", 2).otherwise(1).alias("directness"))
    return ev.series_conflict(s, strength)


def _docs(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("provider_table"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("report"), F.lit(None).cast("string").alias("dataset"), F.col("p_partkey").cast("string").alias("document_id"), "p_type")


SQL_LINE = "ln AS (SELECT p_partkey, p_type, CASE WHEN p_size > 25 THEN 'table:' || lower(p_brand) WHEN p_size % 2 = 0 THEN 'report:' || lower(p_name) ELSE 'document:' || p_partkey END AS lineage_id FROM part)"


@query("lineage_id", f"WITH {SQL_LINE} SELECT p_partkey, lineage_id FROM ln")
def lineage_id(spark, sf):
    return ev.lineage_id(_docs(spark, sf)).select("p_partkey", "lineage_id")


@query("independent_sources", f"WITH {SQL_LINE} SELECT p_type, count(DISTINCT lineage_id) AS n_independent FROM ln GROUP BY 1")
def independent_sources(spark, sf):
    return ev.independent_sources(_docs(spark, sf), ["p_type"])


@query("gate_failures", "WITH c AS (SELECT claim_id, max(period) AS p, count(*) AS n, max(period) - min(period) + 1 AS span, count(DISTINCT source_id) AS s FROM v_series GROUP BY 1) SELECT claim_id, [x FOR x IN [CASE WHEN n < span THEN 'continuity' END, CASE WHEN p < 2001 THEN 'freshness' END, CASE WHEN s < 3 THEN 'lineage' END] IF x IS NOT NULL] AS failures FROM c")
def gate_failures(spark, sf):
    c = v.v_series(spark, sf).groupBy("claim_id").agg(F.max("period").alias("p"), F.count(F.lit(1)).alias("n"), (F.max("period") - F.min("period") + 1).alias("span"), F.count_distinct("source_id").alias("s"))
    out = ev.gate_failures(c, {"continuity": F.col("n") < F.col("span"), "freshness": F.col("p") < 2001, "lineage": F.col("s") < 3})
    return out.select("claim_id", "failures")


@query("role_rollup", """WITH r AS (SELECT o_custkey AS bundle_id, o_orderpriority AS role, CASE o_orderstatus WHEN 'P' THEN 'partial' WHEN 'F' THEN 'complete' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'blocked' ELSE 'complete' END END AS state, o_orderpriority < '3' AS req FROM orders)
    SELECT bundle_id, CASE WHEN bool_or(req AND state = 'blocked') THEN 'blocked' WHEN bool_and(state = 'complete') THEN 'complete' ELSE 'publishable-with-gaps' END AS bundle_state, coalesce(list_sort(list(DISTINCT role) FILTER (state <> 'complete')), []) AS open_roles FROM r GROUP BY 1""")
def role_rollup(spark, sf):
    state = F.when(F.col("o_orderstatus") == "P", "partial").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 4 == 0), "blocked").otherwise("complete")
    rows = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderpriority").alias("role"), state.alias("state"), (F.col("o_orderpriority") < "3").alias("required"))
    return ev.role_rollup(rows, "bundle_id")


SQL_ROUTES = """rt AS (SELECT p_partkey AS route_id, p_brand AS function, CASE WHEN p_size % 5 = 0 THEN 'global' ELSE 'N' || (p_size % 25) END AS geography, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS industry, p_size AS authority, p_size % 7 = 0 AS down, DATE '2024-01-30' - CAST(p_size AS INTEGER) AS checked FROM part),
    rq AS (SELECT DISTINCT p_brand || '/' || p_type AS request_id, p_brand AS f, 'N' || (length(p_type) % 25) AS g, p_type AS i FROM part)"""


@query("route_select", f"WITH {SQL_ROUTES}, m AS (SELECT request_id, route_id, authority, down AND DATE '2024-01-30' - checked <= 21 AS skip FROM rt JOIN rq ON function = f AND geography IN ('global', g) AND (industry IS NULL OR industry = i)) SELECT request_id, route_id, row_number() OVER (PARTITION BY request_id ORDER BY skip::INTEGER, authority DESC, route_id) AS place, CASE WHEN skip THEN 'recently_unreachable' END AS skip_reason FROM m")
def route_select(spark, sf):
    p, size = v.table(spark, sf, "part"), F.col("p_size")
    routes = p.select(
        F.col("p_partkey").alias("route_id"), F.col("p_brand").alias("function"), F.when(size % 5 == 0, F.lit("global")).otherwise(F.concat(F.lit("N"), (size % 25).cast("string"))).alias("geography"),
        F.when(size % 3 != 0, F.col("p_type")).alias("industry"), size.alias("authority"), F.when(size % 7 == 0, F.lit("unreachable")).otherwise("ok").alias("last_status"), F.date_sub(F.lit(D(2024, 1, 30)), size).alias("checked"))
    requests = p.select(F.concat_ws("/", "p_brand", "p_type").alias("request_id"), F.col("p_brand").alias("function"), F.concat(F.lit("N"), (F.length("p_type") % 25).cast("string")).alias("geography"), F.col("p_type").alias("industry")).distinct()
    return ev.route_select(routes, requests, F.lit(D(2024, 1, 30)), 21)


@query("route_rank", "SELECT l_orderkey AS task_id, l_linestatus AS layer, l_partkey AS route_id, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY CASE WHEN p_size BETWEEN 0 AND 20 THEN 1 ELSE 0 END DESC, l_linenumber * 1000000 + l_suppkey) AS place FROM (SELECT l_orderkey, l_linestatus, l_partkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3, 4) JOIN part ON p_partkey = l_partkey QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linestatus, l_linenumber) = 1")
def route_rank(spark, sf):
    rows = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linestatus").alias("layer"), F.col("l_partkey").alias("route_id"), F.col("l_linenumber").alias("position")).agg(F.max("l_suppkey").alias("s"))
    routes = rows.withColumn("slot", F.col("position")).withColumn("position", F.col("position") * 1000000 + F.col("s"))
    recipes = v.table(spark, sf, "part").select(F.col("p_partkey").alias("route_id"), F.date_sub(F.lit(D(2024, 1, 30)), F.col("p_size")).alias("recorded"))
    out = ev.route_rank(routes, recipes, F.lit(D(2024, 1, 30)), 20)
    alone = out.groupBy("task_id", "layer", "slot").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return out.join(alone, ["task_id", "layer", "slot"], "left_semi").select("task_id", "layer", "route_id", F.col("slot").alias("position"), "place")


@query("ledger_consistency", """WITH c AS (SELECT o_orderkey AS claim_id, CASE o_orderstatus WHEN 'P' THEN 'accepted' WHEN 'F' THEN 'exhausted' ELSE 'open' END AS state, CAST(o_orderdate AS DATE) AS acc, o_orderkey % 3 AS nf FROM orders),
    a AS (SELECT l_orderkey AS claim_id, bool_or(l_returnflag = 'N') AS op, bool_or(l_returnflag = 'R') AS bl, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1),
    x AS (SELECT claim_id, [x FOR x IN [CASE WHEN state = 'accepted' AND nf > 0 THEN 'accepted_with_failures' END, CASE WHEN state = 'accepted' AND op THEN 'accepted_with_open_routes' END, CASE WHEN state = 'accepted' AND last > acc THEN 'attempt_after_acceptance' END,
      CASE WHEN state = 'exhausted' AND op THEN 'exhausted_with_open_routes' END, CASE WHEN state = 'exhausted' AND bl THEN 'exhausted_but_blocked' END] IF x IS NOT NULL] AS violations FROM c LEFT JOIN a USING (claim_id)) SELECT * FROM x WHERE len(violations) > 0""")
def ledger_consistency(spark, sf):
    st = F.when(F.col("o_orderstatus") == "P", "accepted").when(F.col("o_orderstatus") == "F", "exhausted").otherwise("open")
    claims = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), st.alias("state"), F.to_date("o_orderdate").alias("accepted_at"), (F.col("o_orderkey") % 3).alias("n_failures"))
    outcome = F.when(F.col("l_returnflag") == "N", "pending").when(F.col("l_returnflag") == "R", "blocked").otherwise("done")
    attempts = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), outcome.alias("outcome"), F.to_date("l_shipdate").alias("completed_at"))
    return ev.ledger_consistency(claims, attempts)


@query("period_windows", "SELECT o_orderkey, range(year(o_orderdate) - 5, year(o_orderdate)) AS completed, range(year(o_orderdate), year(o_orderdate) + 3) AS forecast FROM orders")
def period_windows(spark, sf):
    return ev.period_windows(v.table(spark, sf, "orders"), F.col("o_orderdate"), 5, 3).select("o_orderkey", "completed", "forecast")
