"""Operators on small literal frames, against brute force or hand-computed values."""

from datetime import date as D
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.symbols import from_vendor_symbol, to_vendor_symbol
from tidemark.operators import accounting as ac
from tidemark import session
from tidemark.operators import catalog as ca
from tidemark.operators import documents as dc
from tidemark.operators import evidence as ev
from tidemark.operators import factor as fa
from tidemark.operators import joins, metrics as mt, pit, ranking
from tidemark.operators import screen as sc
from tidemark.operators import timeseries as ts
from tidemark.operators import weights as wt
from tidemark.sources import contracts as ct
from tidemark.sources import readers as rd

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- point in time ---------------------------------------------------------------------------

FACTS = "symbol string, report_date date, publication_date date, known_as_of date, statement_kind string, fact_id bigint, pe double"


def facts(spark):
    q = D(2020, 3, 31)
    return frame(spark, [
        ("A", q, D(2020, 4, 30), D(2020, 4, 30), "preliminary", 1, 10.0),
        ("A", q, D(2020, 5, 30), D(2020, 5, 30), "audited", 2, 11.0),
        ("A", q, D(2020, 5, 30), D(2020, 5, 30), "restated", 3, 12.0),
        ("A", q, D(2020, 4, 1), D(2021, 1, 1), "restated", 4, 13.0),
    ], FACTS)


@pytest.mark.parametrize("asof,expected", [(D(2020, 4, 29), None), (D(2020, 4, 30), 1), (D(2020, 5, 30), 3), (D(2020, 12, 31), 3), (D(2021, 1, 1), 4)])
def test_fundamentals_asof_picks_latest_known_version(spark, asof, expected):
    got = [r.fact_id for r in pit.fundamentals_asof(facts(spark), asof).collect()]
    assert got == ([] if expected is None else [expected])


def test_version_ranges_agree_with_single_reads(spark):
    f = facts(spark)
    days = [D(2020, 4, 1) + timedelta(days=17 * i) for i in range(20)]
    many = pit.fundamentals_asof_many(f, frame(spark, [(d,) for d in days], "asof date"))
    got = {r["asof"]: r.fact_id for r in many.collect()}
    for d in days:
        one = [r.fact_id for r in pit.fundamentals_asof(f, d).collect()]
        assert got.get(d) == (one[0] if one else None)


def test_asof_after_end_is_leakage():
    with pytest.raises(pit.LeakageError):
        pit.check_date_range(D(2020, 1, 1), D(2020, 2, 1), D(2020, 2, 2))


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_equals_merge_asof(spark, strict):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "day": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, 60), "D"), "i": range(60)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 25), "rd": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, 25), "D")}).drop_duplicates()
    right["v"] = np.arange(len(right), dtype=float)
    want = pd.merge_asof(left.sort_values("day"), right.sort_values("rd"), left_on="day", right_on="rd", by="k", allow_exact_matches=not strict)
    l = spark.createDataFrame(left).withColumn("day", F.to_date("day"))
    r = spark.createDataFrame(right).withColumn("rd", F.to_date("rd"))
    got = joins.asof_join(l, r, ["k"], "day", "rd", strict=strict).toPandas().sort_values("i")
    pd.testing.assert_series_equal(got["v"].reset_index(drop=True), want.sort_values("i")["v"].reset_index(drop=True))


def test_membership_interval_is_half_open(spark):
    m = frame(spark, [("X", "A", D(2020, 1, 1), D(2020, 2, 1)), ("X", "B", D(2020, 1, 15), None)], "index_name string, symbol string, effective_from date, effective_to date")
    assert {r.symbol for r in pit.pit_constituents(m, D(2020, 1, 31)).collect()} == {"A", "B"}
    assert {r.symbol for r in pit.pit_constituents(m, D(2020, 2, 1)).collect()} == {"B"}


def test_uncovered_requests_does_not_join_fragments(spark):
    log = frame(spark, [("A", D(2020, 1, 1), D(2020, 1, 31)), ("A", D(2020, 2, 1), D(2020, 2, 28))], "symbol string, fetched_start date, fetched_end date")
    req = frame(spark, [(1, "A", D(2020, 1, 5), D(2020, 1, 20)), (2, "A", D(2020, 1, 20), D(2020, 2, 10))], "request_id int, symbol string, start date, end date")
    assert [r.request_id for r in pit.uncovered_requests(req, log).collect()] == [2]


# --- series ------------------------------------------------------------------------------------


def test_back_adjustment_and_total_return(spark):
    bars = frame(spark, [(D(2020, 1, d), "A", 10.0) for d in (1, 2, 3)], "date date, symbol string, close double")
    acts = frame(spark, [("A", D(2020, 1, 3), "cash_dividend", 1.0, None), ("A", D(2020, 1, 3), "split", None, 2.0)], "symbol string, ex_date date, kind string, amount double, ratio double")
    out = ts.adjust_prices(bars, ts.action_factors(acts, bars)).orderBy("date").collect()
    assert [round(r.close_hfq, 6) for r in out] == [4.5, 4.5, 10.0]
    assert [round(r.total_return, 6) for r in out] == [10.0, 10.0, 11.0]


def test_settlement_clamps_to_last_trading_day(spark):
    cal = frame(spark, [("SH", D(2020, 1, d), d not in (4, 5)) for d in range(1, 8)], "exchange string, date date, is_trading_day boolean")
    t = frame(spark, [("SH", D(2020, 1, 3)), ("SH", D(2020, 1, 7))], "exchange string, exec_date date")
    got = {r.exec_date: r.locked_until for r in ts.settlement_lock(t, cal).collect()}
    assert got == {D(2020, 1, 3): D(2020, 1, 6), D(2020, 1, 7): D(2020, 1, 7)}


# --- ranks -------------------------------------------------------------------------------------


@FEW
@given(st.lists(st.sampled_from([0.0, 0.0, 1.0, -5.0, 1e6, 2.5]), min_size=3, max_size=40))
def test_ranks_equal_pandas(spark, values):
    pdf = pd.DataFrame({"g": ["x"] * len(values), "symbol": [f"{i:06d}.SH" for i in range(len(values))], "v": values})
    df = spark.createDataFrame(pdf)
    got = ranking.rank_average(df, ["g"], "v").toPandas().sort_values("symbol")["rank"].to_list()
    assert got == pdf["v"].rank().to_list()
    place = ranking.position(df, ["g"], "v", "symbol").toPandas().sort_values("symbol")["position"].to_list()
    assert place == pdf["v"].rank(method="first").astype(int).to_list()


def test_quantile_bucket_equals_qcut(spark):
    pdf = pd.DataFrame({"date": [D(2020, 1, 1)] * 23, "symbol": [f"{i:06d}.SH" for i in range(23)], "signal": np.random.default_rng(1).normal(size=23)})
    got = fa.quantile_bucket(spark.createDataFrame(pdf), 5).toPandas().sort_values("symbol")["quantile"].to_list()
    want = (pd.qcut(pdf["signal"].rank(method="first"), 5, labels=False) + 1).to_list()
    assert got == want


# --- weights -----------------------------------------------------------------------------------


def cap_by_bisection(w, cap):
    """The scale at which min(cap, scale * w) sums to what w did, found by halving; all at the cap if that cannot be."""
    total = w.sum()
    if cap * (w > 0).sum() <= total:
        return np.where(w > 0, cap, w)
    lo, hi = 0.0, 1.0
    while np.minimum(cap, hi * w).sum() < total - 1e-15:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(cap, mid * w).sum() < total else (lo, mid)
    return np.minimum(cap, hi * w)


@FEW
@given(st.lists(st.floats(0.001, 1.0), min_size=3, max_size=30), st.sampled_from([0.05, 0.2, 0.5]), st.sampled_from([0.7, 1.0, 1.6]))
def test_cap_at_keeps_the_total_under_the_cap(spark, raw, cap, total):
    w = np.array(raw) / sum(raw) * total
    pdf = pd.DataFrame({"date": [D(2020, 1, 1)] * len(w), "symbol": [f"{i:04d}" for i in range(len(w))], "weight": w})
    got = wt.cap_at(spark.createDataFrame(pdf), cap).toPandas().sort_values("symbol")["weight"].to_numpy()
    assert np.allclose(got, cap_by_bisection(w, cap), atol=1e-9)


@pytest.mark.parametrize("crowd", ["outlier", "ties"])
def test_ranges_are_of_equal_depth(spark, crowd):
    n = 20_000
    value = np.arange(n, dtype=float) if crowd == "outlier" else np.where(np.arange(n) % 10 == 0, np.arange(n), 7.0).astype(float)
    value[-1] = 1e12
    pdf = pd.DataFrame({"date": [D(2020, 1, 1)] * n, "symbol": [f"{i:06d}" for i in range(n)], "value": value})
    df = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranking.ranged(df, ["date"], ["value", "symbol"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 2 * n / len(sizes)
    got = ranking.position(df, ["date"], "value", "symbol").toPandas().sort_values("position")
    want = pdf.sort_values(["value", "symbol"])
    assert got["symbol"].tolist() == want["symbol"].tolist() and got["position"].tolist() == list(range(1, n + 1))
    ranks = ranking.rank_average(df, ["date"], "value").toPandas().sort_values("symbol")["rank"].to_numpy()
    assert np.allclose(ranks, pdf["value"].rank().to_numpy())


def test_mean_returns_take_the_last_panel_dates(spark):
    rows = [("A", D(2020, 1, d), 0.1 * d) for d in range(1, 9)] + [("B", D(2020, 1, 1), 1.0)]
    got = {r.symbol: r.mu for r in wt.hist_mean_returns(frame(spark, rows, "symbol string, date date, ret double"), D(2020, 1, 8), 3).collect()}
    assert got == {"A": pytest.approx(0.6), "B": 0.0}


def test_two_subjects_of_one_event_match_each(spark):
    day = D(2020, 1, 5)
    events = frame(spark, [("e", "p", "r", day), ("e", "q", "r", day)], "record_id string, subject_id string, role string, occurrence_date date")
    roster = frame(spark, [("p", "r", D(2020, 1, 1), None, "s1"), ("q", "r", D(2020, 1, 1), None, "s2")], "person_id string, role string, tenure_start date, tenure_end date, segment_id string")
    assert sorted(tuple(r) for r in ev.tenure_match(events, roster).collect()) == [("e", "p", "matched", "s1"), ("e", "q", "matched", "s2")]


def test_event_window_needs_publication_inside_and_ignores_unknown_dates(spark):
    d = lambda n: D(2024, 1, n)
    rows = [("early", d(12), d(5), d(12), "closed"), ("open", d(12), d(5), d(12), "open"), ("unknown", d(12), d(12), None, "closed"), ("late", d(12), d(12), d(30), "open")]
    events = frame(spark, rows, "record_id string, occurrence_date date, publication_date date, effective_date date, status string")
    assert sorted(r.record_id for r in ev.event_window_filter(events, d(10), d(25)).collect()) == ["open", "unknown"]


def test_stitch_needs_overlap_and_gates_must_be_known(spark):
    rows = [("c", 1, 1.0, "a"), ("c", 2, 2.0, "a"), ("c", 2, 2.0, "b"), ("c", 3, 3.0, "b"), ("x", 1, 1.0, "a"), ("x", 5, 2.0, "b"), ("one", 1, 1.0, "a")]
    series = frame(spark, rows, "claim_id string, period int, value double, source_id string")
    assert sorted((r.claim_id, r.period) for r in ev.series_stitch(series).collect()) == [("c", 1), ("c", 2), ("c", 3), ("one", 1)]
    with pytest.raises(ValueError, match="unit"):
        ev.gate_failures(series, {"unit": F.lit(True)})


def test_comments_are_blanked_and_every_block_is_judged(spark):
    texts = ["accepted <!-- x\n -->claim stays", "keep\n\n/Users/a/b", "a <!-- b --> c"]
    got = [r.reader_text for r in dc.clean_for_reader(frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert "claim stays" in got[0] and got[1] == "keep" and got[2] == "a            c"


def test_cover_is_the_first_pages_and_runs_need_no_dense_numbers(spark):
    text = "\n" * 70 + "For the year ended 31 December 2019\n" + "\f" * 10 + "Audited statements\nfor the year ended 31 December 2019"
    assert dc.report_period_end(frame(spark, [(text,)], "text string")).first().period_end == D(2019, 12, 31)
    turns = frame(spark, [(1, 0, "u", "a"), (1, 2, "u", "b"), (1, 9000, "u", "c"), (1, 9001, "v", "d")], "conv_id int, turn long, role string, text string")
    assert sorted((r.first_turn, r.n_turns, r.text) for r in dc.consecutive_batches(turns).collect()) == [(0, 3, "a\nb\nc"), (9001, 1, "d")]


def test_unreadable_payloads_leave_a_row(spark):
    good = '{"totalAnnouncement": 1, "announcements": [{"secCode": "1", "announcementId": "7", "announcementTitle": "t", "announcementTime": 1}]}'
    a = ca.parse_announcements_a(frame(spark, [("g", good), ("b", "not json"), ("e", '{"announcements": []}')], "k string, payload string"))
    assert sorted((r.k, r.malformed) for r in a.collect()) == [("b", True), ("g", False)]
    with pytest.raises(Exception, match="malformed"):
        ca.require_well_formed(a).collect()
    hk = ca.parse_announcements_hk(frame(spark, [("b", "{}"), ("n", None)], "k string, payload string"))
    assert [r.malformed for r in hk.collect()] == [True, True]
    u = rd.parse_universe(frame(spark, [("m", '{"A": 1.5}'), ("x", "{broken"), ("l", '["B", "B"]'), ("e", "[]")], "id string, payload string"))
    assert sorted((r.id, r.symbol or "") for r in u.collect()) == [("l", "B"), ("m", "A"), ("x", "")]


def test_upserts_leave_no_staging_and_a_checkpoint_folder_must_be_shared(spark, tmp_path):
    rows = lambda *r: frame(spark, r, "k int, year int, v int")
    for batch in (rows((1, 2020, 1), (2, 2021, 2)), rows((1, 2020, 3))):
        rd.write_upsert(spark, f"{tmp_path}/t", batch, ["k", "year"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 3), (2, 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]

    class Remote:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Remote)


@pytest.mark.parametrize("p,n", [(4, 30), (25, 9)])
def test_risk_over_a_carried_panel(spark, p, n):
    """Bars with gaps against dense matrices, with more dates than symbols and with fewer."""
    rng = np.random.default_rng(p)
    close = np.exp(rng.normal(0, 0.2, (n + 1, p)).cumsum(0))
    traded = rng.random((n + 1, p)) < 0.6
    traded[0] = True
    rows = [(f"2020-01-{t + 1:02d}", f"s{i:02d}", float(close[t, i])) for t in range(n + 1) for i in range(p) if traded[t, i]]
    rows = [r for r in rows if r[0] <= "2020-01-31"]
    days = sorted({r[0] for r in rows})
    bars = spark.createDataFrame(rows, "date string, symbol string, close double").withColumn("date", F.to_date("date"))
    held, last = np.zeros((len(days), p)), np.zeros(p)
    for t, day in enumerate(days):
        for d, s, c in rows:
            if d == day:
                last[int(s[1:])] = c
        held[t] = last
    x = np.diff(np.log(held), axis=0)
    t = len(x)
    moves, size = wt.carried_panel(bars)
    assert tuple(size.first()) == (t, p)
    centred = x - x.mean(0)
    s = centred.T @ centred / t
    mu, squares = np.trace(s) / p, (centred**2).sum(1)
    beta, delta = ((squares**2).sum() / t - (s**2).sum()) / (p * t), ((s - mu * np.eye(p)) ** 2).sum() / p
    shrink = min(beta, delta) / delta
    got = wt.ledoit_wolf_shrinkage(moves, size=size).first()
    assert (got.n, got.p) == (t, p) and got.mu == pytest.approx(mu) and got.shrinkage == pytest.approx(shrink)
    cov = {(r.i, r.j): r.cov for r in wt.ledoit_wolf_cov(moves, size=size).collect()}
    want = (1 - shrink) * s + shrink * mu * np.eye(p)
    assert len(cov) == p * (p + 1) // 2 and all(v == pytest.approx(want[int(i[1:]), int(j[1:])]) for (i, j), v in cov.items())
    w = rng.random(p)
    weights = spark.createDataFrame([(f"s{i:02d}", float(w[i])) for i in range(p)], "symbol string, weight double")
    marginal = np.cov(x.T) @ w
    shares = {r.symbol: (r.contribution, r.variance) for r in wt.risk_contribution_of(weights, moves, size).collect()}
    assert all(shares[f"s{i:02d}"] == pytest.approx((w[i] * marginal[i] / (w @ marginal), w @ marginal)) for i in range(p))


def test_constraints_apply_by_priority(spark):
    weights = spark.createDataFrame([("2020-01-01", s, w) for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1))], "date string, symbol string, weight double").withColumn("date", F.to_date("date"))
    steps = [("max_gross", lambda w: wt.constraint_max_gross(w, limit=0.9)), ("max_positions", lambda w: wt.constraint_max_positions(w, n=2))]
    one, other = ({r.symbol: r.weight for r in wt.apply_constraints(weights, order)[0].collect()} for order in (steps, steps[::-1]))
    assert one == pytest.approx(other) and one["c"] == 0 and sum(one.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        wt.apply_constraints(weights, [("another", steps[0][1])])


def test_fewer_dates_than_symbols_pair_dates(spark):
    rows = spark.createDataFrame([(f"2020-01-0{d}", f"s{i}", float(i * d)) for d in (1, 2) for i in range(9)], "date string, symbol string, ret double").withColumn("date", F.to_date("date"))
    x = np.array([[i * d for i in range(9)] for d in (1, 2)], float)
    assert wt._squared_gram(rows, None).first().g == pytest.approx(((x @ x.T) ** 2).sum())


def test_sample_cov_is_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(size=(70, 5)), index=pd.date_range("2020-01-01", periods=70), columns=list("abcde"))
    wide.iloc[3:9, 1] = np.nan
    long = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    got = wt.sample_cov(spark.createDataFrame(long).withColumn("date", F.to_date("date")), 60, blocks=3).collect()
    want = wide.cov()
    assert len(got) == 15 and all(abs(r["cov"] - want.loc[r.i, r.j]) < 1e-12 for r in got)


def test_missing_estimate_is_an_error(spark):
    with pytest.raises(Exception, match="no estimate for B"):
        wt.user_returns(frame(spark, [("A",), ("B",)], "symbol string"), frame(spark, [("A", 0.1)], "symbol string, mu double")).collect()


# --- pairs trade -------------------------------------------------------------------------------


def pairs_by_loop(z, entry, exit_, leg, max_gross):
    open_pairs, out = {}, {}
    for day in sorted({d for d, *_ in z}):
        legs = {}
        for _, a, h, x in [r for r in z if r[0] == day]:
            was = (a, h) in open_pairs
            if x is None:
                emit = was
            elif was and abs(x) < exit_:
                open_pairs.pop((a, h))
                emit = False
            elif not was and x < -entry:
                open_pairs[(a, h)] = leg
                emit = True
            else:
                emit = was and -entry <= x < -exit_
            if emit:
                legs[a], legs[h] = open_pairs[(a, h)], -open_pairs[(a, h)]
        gross = sum(map(abs, legs.values()))
        if gross > max_gross:
            legs = {s: w * max_gross / gross for s, w in legs.items()}
            open_pairs = {p: w * max_gross / gross for p, w in open_pairs.items()}
        out |= {(day, s): w for s, w in legs.items()}
    return out


def test_pair_state_equals_sequential_loop(spark):
    rng = np.random.default_rng(11)
    z = [(D(2020, 1, 3) + timedelta(days=7 * t), f"a{p}", f"h{p}", None if rng.random() < 0.1 else float(rng.normal() * 2)) for t in range(40) for p in range(6)]
    got = fa.pair_state(frame(spark, z, "friday date, symbol_a string, symbol_h string, zscore double"), 1.5, 0.5, 0.1, 0.4).collect()
    want = pairs_by_loop(z, 1.5, 0.5, 0.1, 0.4)
    assert {(r.date, r.symbol): round(r.weight, 10) for r in got} == {k: round(w, 10) for k, w in want.items()}


# --- metrics -----------------------------------------------------------------------------------


def test_newey_west_equals_matrix_formula(spark):
    rng = np.random.default_rng(2)
    n = 120
    x = rng.normal(size=n) * 0.01
    y = 0.001 + 0.8 * x + rng.normal(size=n) * 0.005
    rows = [("r", D(2020, 1, 1) + timedelta(days=i), float(y[i]), float(x[i])) for i in range(n)]
    got = mt.newey_west(frame(spark, rows, "run_id string, date date, rp double, rb double"), ["run_id"]).collect()[0]
    X = np.column_stack([np.ones(n), x])
    b = np.linalg.solve(X.T @ X, X.T @ y)
    h = X * (y - X @ b)[:, None]
    lags = max(1, int(4 * (n / 100) ** (2 / 9)))
    S = h.T @ h + sum((1 - l / (lags + 1)) * (h[l:].T @ h[:-l] + h[:-l].T @ h[l:]) for l in range(1, lags + 1))
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.diag(inv @ S @ inv))
    assert np.allclose([got.alpha, got.beta, got.alpha_se, got.beta_se], [*b, *se], rtol=1e-9) and 0 <= got.alpha_pvalue <= 1


def test_drawdown_dates(spark):
    nav = [100.0, 120.0, 110.0, 90.0, 130.0]
    c = frame(spark, [("r", D(2020, 1, i + 1), v) for i, v in enumerate(nav)], "run_id string, date date, nav double")
    r = mt.drawdown(c, ["run_id"]).collect()[0]
    assert (r.max_drawdown, r.peak, r.trough, r.drawdown_days) == (-0.25, D(2020, 1, 2), D(2020, 1, 4), 2)


def test_shuffle_future_keeps_past_and_values(spark):
    rows = [(D(2020, 1, 1) + timedelta(days=i), "A", float(i)) for i in range(40)]
    df = frame(spark, rows, "date date, symbol string, close double")
    got = {r.date: r.close for r in mt.shuffle_future(df, D(2020, 1, 20), ["date", "symbol"], ["close"]).collect()}
    assert all(got[d] == c for d, _, c in rows if d <= D(2020, 1, 20))
    assert sorted(got.values()) == [c for *_, c in rows] and [got[d] for d, *_ in rows] != [c for *_, c in rows]


# --- screen, contracts, sources ------------------------------------------------------------------


def test_unknown_values_pass_only_negations(spark):
    df = frame(spark, [(1, 5.0), (2, None), (3, float("nan"))], "id int, pe double")
    ids = lambda cond: {r.id for r in sc.screen_predicates(df, {"pe": cond}).collect()}
    assert ids((">", 1)) == {1} and ids(("between", 1, 9)) == {1}
    assert ids(("!=", 4.0)) == {1, 2, 3} and ids(("not_in", [5.0])) == {2, 3}


@pytest.mark.parametrize("bad", [("~", 1), ("between", 5, 1), (">",)])
def test_bad_conditions_are_refused(bad):
    with pytest.raises(ValueError):
        sc.validate_conditions({"pe": bad})


def test_unknown_column_names_a_neighbour(spark):
    with pytest.raises(KeyError, match="pe"):
        sc.screen_predicates(frame(spark, [(1.0,)], "pe double"), {"pee": (">", 1)})


def test_contract_names_broken_rules(spark):
    df = frame(spark, [(D(2020, 1, 1), "600000.SH", 1.0), (D(2020, 1, 1), "600000.SH", None), (D(2020, 1, 1), "x", 1.0)], "date date, symbol string, weight double")
    with pytest.raises(ValueError, match="null:weight x1.*pattern:symbol x1.*duplicate:key x2"):
        ct.enforce_contract(df, ct.WEIGHTS)


@FEW
@given(st.from_regex(r"\A[0-9]{6}\Z"), st.sampled_from(["SH", "SZ"]))
def test_vendor_symbols_round_trip(spark, code, venue):
    df = frame(spark, [(f"{code}.{venue}",)], "s string")
    assert df.select(from_vendor_symbol(to_vendor_symbol(F.col("s")))).first()[0] == f"{code}.{venue}"


def test_write_upsert_twice_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "date date, symbol string, close double, year int"
    first = frame(spark, [(D(2020, 1, 1), "A", 1.0, 2020), (D(2021, 1, 1), "A", 2.0, 2021)], schema)
    batch = frame(spark, [(D(2020, 1, 1), "A", 9.0, 2020), (D(2020, 1, 2), "A", 3.0, 2020)], schema)
    for b in (first, batch, batch):
        rd.write_upsert(spark, path, b, ["date", "symbol"])
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [2.0, 3.0, 9.0]


# --- accounting, documents -----------------------------------------------------------------------


@FEW
@given(st.floats(100, 1e6), st.floats(0.5, 300))
def test_affordable_shares_is_the_largest_that_fits(spark, cash, price):
    df = frame(spark, [(cash, price, "600000.SH", "buy")], "cash double, price double, symbol string, side string")
    cost = lambda n: ac.total_cost(F.col("symbol"), F.col("side"), n * F.col("price")) + n * F.col("price")
    n = ac.affordable_shares(F.col("cash"), F.col("price"), F.col("symbol"), F.col("side"), F.lit(100))
    r = df.select(n.alias("n"), cost(n).alias("now"), cost(n + 100).alias("more")).first()
    assert (r.n == 0 or r.now <= cash + 1e-6) and r.more > cash - 1e-6


def test_reader_cleaning(spark):
    text = (
        "# T\n\n## Keep\n\nfine text\n\n## Drop\n<!-- reader-exclude-section -->\nhidden\n### Sub\nhidden too\n\n## After\n\n**置信度：** high\n"
        "shown <!-- note -->\n\n| a | ledger |\n| - | - |\n\nsee /home/me/x and more\n\nend\n"
    )
    out = dc.clean_for_reader(frame(spark, [(text,)], "text string")).first()
    assert out.reader_text == "# T\n\n## Keep\n\nfine text\n\n## After\n\nshown\n\nend" and out.machine_blocks == 2
    assert dc.leak_scan(frame(spark, [(out.reader_text,)], "text string")).first().leaks == []


def test_sections_keep_text_before_first_h3(spark):
    md = "intro\n## A\nalpha\n### B\nbeta\n## C\n"
    got = {r.section: r.body for r in dc.parse_sections(frame(spark, [(1, md)], "id int, text string")).collect()}
    assert got == {"A": "alpha", "A / B": "beta", "C": ""}


def test_long_conversations_are_chunked(spark):
    rows = [(1, t, "tool" if 3 <= t <= 30 else "user", str(t)) for t in range(40)]
    got = dc.consecutive_batches(frame(spark, rows, "conv_id int, turn bigint, role string, text string"), chunk=4).orderBy("first_turn").collect()
    assert [(r.first_turn, r.n_turns) for r in got] == [(0, 3), (3, 28), (31, 9)]
