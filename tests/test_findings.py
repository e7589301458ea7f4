"""Faults that showed on larger or odd tables only."""

from datetime import date as D
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_check import normal
from test_operators import frame, pairs_by_loop
from tidemark.operators import factor as fa
from tidemark.operators import screen as sc
import tidemark.plans.catalogue  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES


def test_pair_state_survives_scalings_below_the_smallest_double(spark):
    rng = np.random.default_rng(5)
    z = [(D(2015, 1, 2) + timedelta(days=7 * t), f"a{p}", f"h{p}", float(rng.normal() * 2)) for t in range(220) for p in range(12)]
    got = fa.pair_state(frame(spark, z, "friday date, symbol_a string, symbol_h string, zscore double"), 0.6, 0.2, 0.1, 0.001).collect()
    want = pairs_by_loop(z, 0.6, 0.2, 0.1, 0.001)
    assert {(r.date, r.symbol): round(r.weight, 12) for r in got} == {k: round(w, 12) for k, w in want.items()}


def test_equal_years_are_no_cut_however_their_payments_are_added(spark):
    rows = [("A", D(2018, 3, 1), "cash_dividend", 0.1), ("A", D(2018, 9, 1), "cash_dividend", 0.2), *[("A", D(y, 3, 1), "cash_dividend", 0.3) for y in range(2019, 2023)]]
    got = sc.dividend_grade(frame(spark, rows, "symbol string, ex_date date, kind string, amount double"), D(2022, 12, 31)).collect()
    assert [(r.paid_years, r.recent_cut) for r in got] == [(5, False)]


def test_a_mean_at_a_bound_is_not_above_it(spark):
    rows = [("A", D(2020, 3, 31), 0.1), ("A", D(2020, 6, 30), 0.2)]
    got = sc.trailing_mean(frame(spark, rows, "symbol string, report_date date, roe double"), D(2020, 12, 31), "roe", 3, "m").collect()
    assert [r.m for r in got] == [0.15] and (0.1 + 0.2) / 2 > 0.15


def against_sql(spark, tmp_path, name, **tables):
    """A registered query and its SQL over written tables (name=pandas frame)."""
    import duckdb

    con = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(tmp_path / f"{table}.parquet", coerce_timestamps="us")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(normal(x) for x in r) for r in cursor.fetchall()), key=str)
    return sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=str), want


def lines(rows):
    """A lineitem table of (order, part, supplier, quantity, price, ship date)."""
    import pandas as pd

    t = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    t = t.assign(l_linenumber=1, l_returnflag="N", l_linestatus="F", l_shipdate=pd.to_datetime(t.l_shipdate))
    return t.astype({"l_quantity": float, "l_extendedprice": float, "l_linenumber": "int32"})


def test_contract_statement_judges_the_pattern_not_a_marker(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "enforce_contract", lineitem=lines([(1, 1_000_000, 1, 5, 50, "1998-01-05"), (2, 7, 1, 5, 50, "1998-01-05")]))
    assert got == want == [("pattern:symbol", 1.0)]


def test_month_end_values_are_listed_once_and_not_shuffled(spark):
    from tidemark.operators import pit

    rng = np.random.default_rng(3)
    day = lambda lo, hi: D(2019, 1, 1) + timedelta(days=int(rng.integers(lo, hi)))
    rows = []
    for i in range(300):
        report, kind = D(2019, 1, 1) + timedelta(days=91 * int(rng.integers(0, 9))), str(rng.choice(["preliminary", "audited", "restated"]))
        rows.append((f"s{i % 7}", report, report + timedelta(days=int(rng.integers(1, 400))), day(0, 900), kind, i, *[None if rng.random() < 0.3 else float(i) for _ in range(2)]))
    facts = frame(spark, rows, "symbol string, report_date date, publication_date date, known_as_of date, statement_kind string, fact_id bigint, pe double, pb double")
    start, end = D(2019, 6, 1), D(2021, 12, 31)
    known = fa.known_at_month_ends(facts, start, end, ["pe", "pb"])
    every = pit.fundamentals_asof_month_ends(facts, start, end).withColumnRenamed("asof", "date")
    want = pit.latest_non_null(every, ["date", "symbol"], [F.col("report_date"), *pit.version_order(facts)], ["pe", "pb"])
    key = lambda r: (r.date, r.symbol, r.pe, r.pb)
    assert set(map(key, known.collect())) == set(map(key, want.collect()))
    assert known._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1


def test_pairs_leave_the_products_finished_and_only_where_both_have_a_date(spark):
    from tidemark.operators import weights as wt

    rows = [("a", D(2020, 1, 1), 0.1), ("a", D(2020, 1, 2), 0.2), ("b", D(2020, 1, 2), 0.3), ("c", D(2020, 1, 3), 0.4)]
    pairs = wt.pair_moments(frame(spark, rows, "symbol string, date date, ret double"), 1)
    assert {(r.i, r.j): r.n for r in pairs.collect()} == {("a", "a"): 2, ("a", "b"): 1, ("b", "b"): 1, ("c", "c"): 1}
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0] and "FlatMapGroupsInArrow" in plan


def test_risk_contribution_uses_returns_before_a_late_listing(spark, tmp_path):
    days = ["1998-01-01", "1998-01-02", "1998-01-03", "1998-01-04", "1998-01-05", "1998-01-06"]
    rows = [(k, 1, s, 1, 10 + (k * 7 + s * 3) % 5, d) for k, d in enumerate(days) for s in (1, 2)] + [(9, 1, 3, 1, 10, days[4]), (10, 1, 3, 1, 12, days[5])]
    got, want = against_sql(spark, tmp_path, "risk_contribution", lineitem=lines(rows))
    close = np.array([[10 + (k * 7 + s * 3) % 5 for s in (1, 2)] + [10 if k < 5 else 12] for k in range(6)], dtype=float)
    variance = np.diff(np.log(close), axis=0).mean(axis=1).var(ddof=1)
    assert got == want and all(variance == pytest.approx(r[3], abs=1e-6) for r in got)


def test_mean_returns_reach_back_two_years(spark, tmp_path):
    rows = [(k, 1, s, 1, p, d) for s in (1, 2) for k, (p, d) in enumerate([(10, "1997-01-02"), (11 + s, "1998-12-01"), (15, "1999-03-01")])]
    got, want = against_sql(spark, tmp_path, "hist_mean_returns", lineitem=lines(rows))
    assert got == want and [r[1] for r in got] == [pytest.approx(np.log(1.5) / 2, abs=1e-6)] * 2


def test_active_counts_without_meeting_days(spark):
    from tidemark.operators import joins

    rng, day = np.random.default_rng(8), lambda k: D(2020, 1, 1) + timedelta(days=int(k))
    rows = [("N" if k % 2 else "A", f"s{rng.integers(4)}", day(a := rng.integers(0, 60)), None if k % 29 == 0 else day(a + rng.integers(0, 9))) for k in range(80)]
    days = frame(spark, [(day(k),) for k in range(0, 70, 3)], "date date")
    out = joins.active_counts(days, frame(spark, rows, "g string, symbol string, a date, b date"), ["g"], "symbol", "date", "a", "b")
    want = {}
    for k in range(0, 70, 3):
        for g in "AN":
            if inside := [s for h, s, a, b in rows if h == g and a <= day(k) and (b is None or b > day(k))]:
                want[day(k), g] = (len(inside), len(set(inside)))
    assert {(r.date, r.g): (r.n, r.members) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")


def test_runs_share_bars_that_do_not_name_them(spark):
    from tidemark.operators import metrics as mt

    days = [D(2020, 1, 1) + timedelta(days=k) for k in range(9)]
    close = {(s, d): 10.0 + (3 * k + 5 * i) % 7 for i, s in enumerate("AB") for k, d in enumerate(days) if (i, k) != (1, 4)}
    bars = frame(spark, [(s, d, c) for (s, d), c in close.items()], "symbol string, date date, close double")
    held = {("x", days[1], "A"): 1.0, ("x", days[5], "A"): 0.5, ("x", days[5], "B"): 0.5, ("y", days[2], "B"): 1.0, ("y", days[6], "A"): 2.0}
    weights = frame(spark, [(*k, w) for k, w in held.items()], "run_id string, date date, symbol string, weight double")
    got = {(r.run_id, r.date): r.ret for r in mt.run_curves(bars, weights).collect()}
    want = {}
    for run in "xy":
        for d in days:
            before = [b for r, b, _ in held if r == run and b < d]
            for (r, b, s), w in held.items():
                if before and r == run and b == max(before) and (s, d) in close:
                    last = max((e for t, e in close if t == s and e < d), default=None)
                    want[run, d] = want.get((run, d), 0.0) + w * (close[s, d] / close[s, last] - 1 if last else 0.0)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_reversed_future_meets_itself_in_no_join(spark):
    from tidemark.operators import metrics as mt

    rows = frame(spark, [(s, D(2020, 1, d), 10.0 * i + d) for i, s in enumerate("AB") for d in (1, 2, 4, 7, 8)], "symbol string, date date, close double")
    out = mt.reverse_future(rows, D(2020, 1, 2), ["close"])
    assert {(r.symbol, r.date.day): r.close for r in out.collect()} == {
        (s, d): 10.0 * i + {1: 1, 2: 2, 4: 8, 7: 7, 8: 4}[d] for i, s in enumerate("AB") for d in (1, 2, 4, 7, 8)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_actions_and_bars_of_a_day_meet_on_one_axis(spark):
    from tidemark.operators import joins, timeseries as ts

    rng, day = np.random.default_rng(4), lambda k: D(2020, 1, 1) + timedelta(days=int(k))
    bars = {(s, day(k)): float(rng.integers(5, 20)) for s in "ABC" for k in range(30) if rng.random() < 0.7}
    acts = [(str(rng.choice(["A", "B", "C", "D"])), day(rng.integers(0, 30)), "cash_dividend", float(rng.integers(1, 4)), None) for _ in range(40)]
    b = frame(spark, [(d, s, c) for (s, d), c in bars.items()], "date date, symbol string, close double")
    a = frame(spark, [*acts, (None, day(3), "cash_dividend", 1.0, None)], "symbol string, ex_date date, kind string, amount double, ratio double")
    base = lambda s, d: max(((e, c) for (t, e), c in bars.items() if t == s and e < d), default=(None, None))[1]
    used = [(s, d, (base(s, d) - x) / base(s, d), 1 + x / base(s, d)) for s, d, _, x, _ in acts if base(s, d)]
    factors = ts.action_factors(a, b)
    assert sorted((r.symbol, r.ex_date, round(r.hfq_factor, 9)) for r in factors.collect()) == sorted((s, d, round(h, 9)) for s, d, h, _ in used)
    out = ts.adjust_prices(b, factors)
    got = {(r.symbol, r.date): (r.close_hfq, r.total_return) for r in out.collect()}
    for (s, d), c in bars.items():
        back = np.prod([h for t, e, h, _ in used if t == s and e > d])
        total = np.prod([x for t, e, _, x in used if t == s and e <= d])
        assert got[s, d] == (pytest.approx(c * back), pytest.approx(c * total))
    assert len(got) == len(bars)
    assert "UnboundedFollowing" not in out._jdf.queryExecution().optimizedPlan().toString()
    for strict in (False, True):
        days = a.select("symbol", "ex_date").distinct()
        want = {(s, d): max(((e, c) for (t, e), c in bars.items() if t == s and (e < d if strict else e <= d)), default=(None, None))[1] for s, d, *_ in acts}
        found = joins.asof_on_axis(days, b.withColumnRenamed("date", "on"), ["symbol"], "ex_date", "on", strict=strict)
        assert {(r.symbol, r.ex_date): r.close for r in found.collect()} == {**want, (None, day(3)): None}
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_dividends_look_back_without_copies_of_holdings(spark):
    from tidemark.operators import accounting as ac

    held = frame(spark, [("x", "A", D(2010, 1, 1), 5), ("x", "A", D(2020, 1, 3), 7), ("y", "A", D(2020, 1, 2), 3), ("y", "A", D(2020, 1, 9), 0), (None, "A", D(2020, 1, 1), 9)],
                 "run_id string, symbol string, date date, shares bigint")
    paid = frame(spark, [("A", D(2020, 1, d), "cash_dividend", 0.5) for d in (2, 3, 3, 12)] + [("B", D(2020, 1, 5), "cash_dividend", 1.0)],
                 "symbol string, ex_date date, kind string, amount double")
    out = ac.dividend_cash(held, paid, ["run_id", "symbol"])
    assert sorted((r.run_id, r.ex_date.day, r.shares, r.cash) for r in out.collect()) == [("x", 2, 5, 2.5), ("x", 3, 5, 5.0), ("x", 12, 7, 3.5), ("y", 3, 3, 3.0)]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_of_narrow_groups_take_one_shuffle_and_equal_those_of_wide_ones(spark, monkeypatch):
    from tidemark.operators import ranking

    rng = np.random.default_rng(6)
    value = lambda: None if rng.random() < 0.1 else float(rng.integers(-3, 4))
    rows = [(None if k % 17 == 0 else f"g{k % 3}", k, value(), value()) for k in range(200)]
    df = frame(spark, rows, "g string, id int, a double, b double")
    narrow = ranking.rank_averages(df, ["g"], {"a": "ra", "b": "rb"})
    plan = narrow._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 10)
    wide = ranking.rank_averages(df, ["g"], {"a": "ra", "b": "rb"})
    key = lambda r: (r.id, r.ra, r.rb)
    assert sorted(map(key, narrow.collect())) == sorted(map(key, wide.collect()))


def test_a_study_makes_the_asked_parts_only(spark):
    rows = [(D(2020, m, 28), f"s{i}", float((i * 7 + m) % 11)) for m in range(1, 7) for i in range(8)]
    signals = frame(spark, rows, "date date, symbol string, signal double")
    forward = signals.select("date", "symbol", F.lit(1).alias("horizon"), (F.col("signal") % 5).alias("fwd"))
    every = fa.factor_study(signals, forward, [1])
    assert set(every) == set(fa.STUDY) and list(fa.factor_study(signals, forward, [1], parts=["ic_summary"])) == ["ic_summary"]


def test_members_are_counted_per_year_not_listed_per_month_end(spark):
    from tidemark.operators import pit

    rng, day = np.random.default_rng(9), lambda k: D(2018, 11, 20) + timedelta(days=int(k))
    rows = [("N" if k % 3 else "A", f"s{rng.integers(4)}", day(a := rng.integers(0, 900)), None if k % 23 == 0 else day(a + rng.integers(0, 400 if k % 5 == 0 else 40))) for k in range(150)]
    rows += [("A", "s0", D(2020, 1, 31), D(2020, 2, 1)), ("A", "s0", D(2020, 2, 1), D(2020, 2, 29)), ("A", "s1", None, None)]
    start, end = D(2019, 1, 10), D(2021, 3, 15)
    out = pit.members_per_month(frame(spark, rows, "index_name string, symbol string, effective_from date, effective_to date"), start, end)
    want = {}
    for d in (D(y + m // 12, m % 12 + 1, 1) - timedelta(days=1) for y in range(2018, 2022) for m in range(1, 13)):
        for g, s, a, b in rows:
            if start <= d <= end and a and a <= d and (b is None or b > d):
                want[d, g, s] = want.get((d, g, s), 0) + 1
    assert {(r.date, r.index_name, r.symbol): r.n for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [index_name" in plan and plan.index("Generate inline") < plan.index("Aggregate [index_name")  # month ends are made from counts


def records_shuffled(spark):
    gw = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    empty = gw.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty, False, False, gw.new_array(gw.jvm.double, 0), empty)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def random_returns(spark, symbols, days=40):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((days, symbols)) < 0.5, rng.normal(size=(days, symbols)), np.nan)
    rows = [(f"s{i:02d}", D(2020, 1, 1) + timedelta(days=t), float(x[t, i])) for t in range(days) for i in range(symbols) if not np.isnan(x[t, i])]
    return frame(spark, rows, "symbol string, date date, ret double"), x


def test_vectors_are_shuffled_once_however_many_strips_they_stand_in(spark):
    from tidemark.operators import weights as wt

    returns, x = random_returns(spark, 24)
    for name in ("pair_moments", "pair_products"):
        written = []
        for blocks in (2, 12):
            before = records_shuffled(spark)
            got = {(r.i, r.j): r for r in getattr(wt, name)(returns, blocks).collect()}
            written.append(records_shuffled(spark) - before)
            assert len(got) == 24 * 25 // 2
            for (i, j), r in got.items():
                a, b = x[:, int(i[1:])], x[:, int(j[1:])]
                both = ~np.isnan(a) & ~np.isnan(b)
                assert i <= j and (r.sij, r.ti, r.tj) == pytest.approx((np.nansum(a * b), np.nansum(a), np.nansum(b)))
                if name == "pair_moments":
                    assert (r.n, r.si, r.sj) == pytest.approx((both.sum(), a[both].sum(), b[both].sum()))
        assert written[0] == written[1]


def test_a_symbol_that_never_moves_has_covariances(spark, tmp_path):
    days = ["1998-01-01", "1998-01-02", "1998-01-03", "1998-01-04", "1998-01-05", "1998-01-06"]
    rows = [(k, 1, s, 1, 10 + (k * 7 + s * 3) % 5, d) for k, d in enumerate(days) for s in (1, 2)] + [(9, 1, 3, 1, 10, days[2])]
    got, want = against_sql(spark, tmp_path, "ledoit_wolf_cov", lineitem=lines(rows))
    assert got == want and len(got) == 6
    for name in ("ledoit_wolf_shrinkage", "risk_contribution"):
        got, want = against_sql(spark, tmp_path, name, lineitem=lines(rows))
        assert got == want


def test_sample_covariances_make_their_bars_once_and_count_days_without_returns(spark, tmp_path):
    from tidemark.operators import weights as wt

    got, want = against_sql(spark, tmp_path, "sample_cov", lineitem=lines([(s + 7 * k, 1, s, 1, 10 + (k * s) % 7, str(D(1998, 1, 1) + timedelta(days=k))) for s in (1, 2) for k in range(62)]))
    assert got == want and len(got) == 3
    assert "FileScan" not in QUERIES["sample_cov"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    returns = frame(spark, [("a", D(2020, 1, 1), 0.1), ("a", D(2020, 1, 2), 0.3), ("a", D(2020, 1, 3), None)], "symbol string, date date, ret double")
    assert wt.sample_cov(returns, 3).first().cov == pytest.approx(0.02)
    with pytest.raises(Exception, match="at least 4 dates"):
        wt.sample_cov(returns, 4).collect()
