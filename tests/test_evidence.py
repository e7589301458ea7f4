"""Ledgers with applicable routes, declared fallbacks, missing periods and unresolved claims."""

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.operators import evidence as ev


def test_ledger_reports_untried_routes_and_missing_attempts(spark):
    day = D(2024, 1, 2)
    claims = spark.createDataFrame([(c, s, day, 0) for c, s in (("a", "accepted"), ("b", "accepted"), ("e", "exhausted"), ("f", "exhausted"), ("g", "exhausted"), ("o", "open"))], "claim_id string, state string, accepted_at date, n_failures int")
    attempts = spark.createDataFrame([(c, r, o, D(2024, 1, 1)) for c, r, o in (("a", "1", "done"), ("b", "1", "done"), ("e", "1", "done"), ("f", "1", "done"), ("f", "2", "pending"))], "claim_id string, route_id string, outcome string, completed_at date")
    routes = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("e", "1"), ("e", "2"), ("f", "1"), ("f", "2"), ("g", "1"), ("o", "1")], "claim_id string, route_id string")
    got = {r.claim_id: r.violations for r in ev.ledger_consistency(claims, attempts, routes).collect()}
    assert got == {
        "b": ["accepted_with_untried_routes"], "e": ["exhausted_with_untried_routes"],
        "f": ["exhausted_with_open_routes", "exhausted_with_untried_routes"], "g": ["exhausted_without_attempts", "exhausted_with_untried_routes"],
    }
    assert {r.claim_id: r.violations for r in ev.ledger_consistency(claims, attempts).collect()} == {"f": ["exhausted_with_open_routes"]}


def test_fallbacks_are_followed_once_in_scope(spark):
    now = F.lit(D(2024, 1, 30))
    rows = [("p", "index", "CN", None, 5, "unreachable"), ("q", "index", "CN", None, 1, "ok"), ("s", "filings", "CN", None, 9, "ok"), ("t", "filings", "global", "cars", 3, "ok"), ("u", "filings", "US", None, 9, "ok"), ("v", "quotes", "CN", None, 2, "ok")]
    routes = spark.createDataFrame([(*r, D(2024, 1, 29)) for r in rows], "route_id string, function string, geography string, industry string, authority int, last_status string, checked date")
    requests = spark.createDataFrame([("r", "index", "CN", "cars"), ("x", "quotes", "CN", "toys")], "request_id string, function string, geography string, industry string")
    falls = spark.createDataFrame([("p", "s"), ("p", "s"), ("p", "u"), ("s", "t"), ("t", "p"), ("u", "v"), ("v", "t")], "route_id string, fallback_id string")
    got = sorted((r.request_id, r.place, r.route_id, r.skip_reason) for r in ev.route_select(routes, requests, now, fallbacks=falls).collect())
    assert got == [("r", 1, "q", None), ("r", 2, "s", None), ("r", 3, "t", None), ("r", 4, "p", "recently_unreachable"), ("x", 1, "v", None)]


def test_bundles_name_missing_periods_and_unresolved_claims(spark):
    rows = [
        ("b", "share", "partial", True, [2021, 2022, 2023], [2021, 2023], "c1"), ("b", "rivals", "exhausted", True, [2023], None, "c2"),
        ("b", "size", "complete", True, [2023], [2023], "c3"), ("b", "driver", "not-applicable", False, None, None, "c4"), ("k", "size", "complete", True, [2023], [2023], "c5"),
    ]
    roles = spark.createDataFrame(rows, "bundle string, role string, state string, required boolean, required_periods array<int>, accepted_periods array<int>, claim_id string")
    got = {r.bundle: ([tuple(m) for m in r.missing_periods], r.unresolved_claim_ids, r.bundle_state) for r in ev.role_rollup(roles, "bundle").collect()}
    assert got == {"b": ([("rivals", 2023), ("share", 2022)], ["c1", "c2"], "publishable-with-gaps"), "k": ([], [], "complete")}


def test_stitch_needs_one_group_of_meeting_sources(spark):
    rows = [(c, s, p, v, u) for c, stated in {
        "pairs": [("A", 2000, 1.0, "one"), ("B", 2000, 1.0, "one"), ("C", 2010, 2.0, "one"), ("D", 2010, 2.0, "one")],
        "chain": [("A", 2000, 1.0, "one"), ("A", 2001, 2.0, "one"), ("B", 2001, 0.002, "thousand"), ("B", 2002, 0.003, "thousand"), ("C", 2002, 3.0, "one"), ("C", 2003, 4.0, "one")],
        "clash": [("A", 2000, 1.0, "one"), ("B", 2000, 1.0, "thousand")],
        "apart": [("A", 2000, 1.0, "one"), ("B", 2001, 1.0, "one")],
        "alone": [("A", 2000, 1.0, "one"), ("A", 2001, 1.5, "one")],
        "odd": [("A", 2000, 1.0, "dozen")],
    }.items() for s, p, v, u in stated]
    series = spark.createDataFrame(rows, "claim_id string, source_id string, period int, value double, unit string")
    units = spark.createDataFrame([("one", "one", 1.0), ("thousand", "one", 1000.0)], "unit string, canonical_unit string, factor double")
    got = sorted(tuple(r) for r in ev.series_stitch(series, units=units).collect())
    assert got == [("alone", 2000, 1.0, "A", "single"), ("alone", 2001, 1.5, "A", "single")] + [
        ("chain", 2000, 1.0, "A", "stitched"), ("chain", 2001, 2.0, "A", "stitched"), ("chain", 2002, 3.0, "B", "stitched"), ("chain", 2003, 4.0, "C", "stitched")
    ]
    long = spark.range(40).selectExpr("0 AS k", "explode(array(id, id + 1)) AS via", "id AS node")
    assert {r.root for r in ev.meeting_groups(long, "k", "node", "via").collect()} == {0}
    assert ev.series_stitch(series.limit(0)).count() == 0


def test_periods_of_every_frequency(spark):
    labels = ["1999", "1999Q4", "1999-Q4", "1999-12", "1999-13", "FY1999", None]
    rows = spark.createDataFrame([(x,) for x in labels], "period string").select("period", ev.period_frequency(F.col("period")).alias("f"), ev.period_number(F.col("period")).alias("n"))
    rows = rows.withColumn("back", ev.period_label(F.col("f"), F.col("n")))
    assert [tuple(r)[1:] for r in rows.collect()] == [("A", 1999, "1999"), ("Q", 7999, "1999Q4"), ("Q", 7999, "1999Q4"), ("M", 23999, "1999-12"), (None,) * 3, (None,) * 3, (None,) * 3]
    series = spark.createDataFrame([("a", "1999Q3"), ("a", "2000Q2"), ("b", "1999-11"), ("b", "2000-02"), ("c", "1999"), ("c", "1999Q1")], "k string, period string")
    assert sorted(tuple(r) for r in ev.series_continuity(series, ["k"]).collect()) == [("a", "1999Q4"), ("a", "2000Q1"), ("b", "1999-12"), ("b", "2000-01")]
    assert sorted(tuple(r) for r in ev.series_frequency(series, ["k"], "Q").collect()) == [("a", "Q", None), ("b", "M", "frequency"), ("c", None, "mixed")]


def test_exchange_dates_in_any_session_zone(spark):
    rows = [("2024-01-10T15:59:59Z", "SH"), ("2024-01-10T16:00:00Z", "HK"), ("2024-01-10T23:00:00Z", "XX"), (None, "SZ"), ("2024-01-10T16:30:00Z", None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            df = spark.createDataFrame(rows, "t string, venue string").withColumn("day", ev.exchange_date(F.col("t").cast("timestamp"), F.col("venue")))
            assert [None if r.day is None else r.day.day for r in df.collect()] == [10, 11, None, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
