"""Performance metrics per run, and the checks built on them. One row per run, all runs in one job.

A curve holds one row per (run, date), so windows per run hold one calendar.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.factor import lagged_products, normal_two_sided, numbered
from tidemark.operators.joins import interval_join
from tidemark.operators.ranking import position
from tidemark.session import settle

YEAR = 252


def cagr(nav: str = "nav", day: str = "date") -> Column:
    first, last = F.min_by(nav, day), F.max_by(nav, day)
    years = F.datediff(F.max(day), F.min(day)) / F.lit(365.25)
    return F.when((F.count(F.lit(1)) >= 2) & (first > 0) & (years > 0), F.pow(last / first, 1 / years) - 1).otherwise(0.0)


def total_return(nav: str = "nav", day: str = "date") -> Column:
    return F.max_by(nav, day) / F.min_by(nav, day) - 1


def annualized_vol(ret: Column, periods: int = YEAR) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))


def sharpe(ret: Column, rf: float = 0.0, periods: int = YEAR) -> Column:
    excess = ret - rf / periods
    sd = F.stddev_samp(excess)
    return F.when(sd < 1e-12, F.lit(0.0)).otherwise(F.avg(excess) / sd * F.sqrt(F.lit(float(periods))))


def sortino(ret: Column, rf: float = 0.0, periods: int = YEAR) -> Column:
    excess = ret - rf / periods
    down = F.stddev_samp(F.when(excess < 0, excess))
    return F.when(down > 0, F.avg(excess) / down * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def drawdown(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deepest fall from a running peak, its trough, the first date of the peak before it and the days between."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    falls = curve.withColumn("_peak", F.max("nav").over(w)).withColumn("_dd", (F.col("nav") - F.col("_peak")) / F.col("_peak"))
    # Rows under one running peak start on the day the peak was set.
    set_on = Window.partitionBy(*keys, "_peak")
    falls = falls.withColumn("_at", F.min("date").over(set_on))
    worst = falls.groupBy(*keys).agg(F.min_by(F.struct("_dd", "date", "_at"), F.struct("_dd", "date")).alias("_w"))
    down = F.col("_w._dd") < 0
    return worst.select(
        *keys, F.when(down, F.col("_w._dd")).otherwise(0.0).alias("max_drawdown"),
        F.when(down, F.col("_w.date")).alias("trough"), F.when(down, F.col("_w._at")).alias("peak"),
        F.when(down, F.datediff("_w.date", "_w._at")).otherwise(0).alias("drawdown_days"),
    )


def calmar(growth: Column, deepest: Column) -> Column:
    return F.when(deepest == 0, F.lit(float("inf"))).otherwise(growth / F.abs(deepest))


def log_curve(curve: DataFrame, keys: Sequence[str], out: str = "ret") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    before = F.lag("nav").over(w)
    return curve.withColumn(out, F.when((F.col("nav") > 0) & (before > 0), F.log(F.col("nav") / before)))


def align_returns(portfolio: DataFrame, benchmark: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common dates of run returns `rp` and benchmark returns `rb` (the benchmark has date only)."""
    p = portfolio.where(F.col("ret").isNotNull()).select(*keys, "date", F.col("ret").alias("rp"))
    b = benchmark.where(F.col("ret").isNotNull()).select("date", F.col("ret").alias("rb"))
    return p.join(b, "date")


def relative_metrics(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    diff = F.col("rp") - F.col("rb")
    out = aligned.groupBy(*keys).agg((F.avg(diff) * YEAR).alias("excess_return"), (F.stddev_samp(diff) * F.sqrt(F.lit(float(YEAR)))).alias("tracking_error"))
    te = F.col("tracking_error")
    return out.withColumn("information_ratio", F.when(te == 0, 0.0).otherwise(F.col("excess_return") / te))


def newey_west(aligned: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """Alpha and beta of rp on rb with Bartlett HAC errors, per key; needs `least` common returns."""
    rows = numbered(aligned, keys).where(F.col("_n") >= least)
    fit = rows.groupBy(*keys).agg(
        F.regr_slope("rp", "rb").alias("beta"), F.regr_intercept("rp", "rb").alias("alpha"), F.first("_n").alias("n"), F.first("_lags").alias("newey_west_lag"),
        F.sum("rb").alias("_sx"), F.sum(F.col("rb") * F.col("rb")).alias("_sxx"),
    )
    scored = rows.join(fit.select(*keys, "alpha", "beta"), list(keys)).withColumn("_u", F.col("rp") - F.col("alpha") - F.col("beta") * F.col("rb"))
    scored = settle(scored.withColumn("_v", F.col("_u") * F.col("rb")))
    own = scored.groupBy(*keys).agg(
        F.sum(F.col("_u") * F.col("_u")).alias("_g11"), F.sum(F.col("_u") * F.col("_v")).alias("_g12"), F.sum(F.col("_v") * F.col("_v")).alias("_g22")
    )
    out = fit.join(own, list(keys))
    lagged = {"_l11": ("_u", "_u"), "_l12": ("_u", "_v"), "_l21": ("_v", "_u"), "_l22": ("_v", "_v")}
    out = out.join(lagged_products(scored, keys, lagged), list(keys), "left")
    s11 = F.col("_g11") + 2 * F.col("_l11")
    s12 = F.col("_g12") + F.col("_l12") + F.col("_l21")
    s22 = F.col("_g22") + 2 * F.col("_l22")
    n, sx, sxx = F.col("n"), F.col("_sx"), F.col("_sxx")
    det = n * sxx - sx * sx
    a, b, d = sxx / det, -sx / det, n / det
    var_alpha = a * a * s11 + 2 * a * b * s12 + b * b * s22
    var_beta = b * b * s11 + 2 * b * d * s12 + d * d * s22
    out = out.withColumns({"alpha_se": F.sqrt(var_alpha), "beta_se": F.sqrt(var_beta)})
    out = out.withColumns({"alpha_t_stat": F.col("alpha") / F.col("alpha_se"), "beta_t_stat": F.col("beta") / F.col("beta_se")})
    return out.withColumn("alpha_pvalue", normal_two_sided("alpha_t_stat")).drop(*[c for c in out.columns if c.startswith("_")])


# --- activity ---------------------------------------------------------------------------------


def annualized_turnover(trades: DataFrame, curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    years = F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)
    nav = curve.groupBy(*keys).agg(F.avg("nav").alias("_nav"), years.alias("_years"))
    traded = trades.groupBy(*keys).agg(F.sum("notional").alias("_notional"))
    ok = (F.col("_nav") > 0) & (F.col("_years") > 0) & F.col("_notional").isNotNull()
    value = F.when(ok, F.col("_notional") / F.col("_nav") / F.col("_years")).otherwise(0.0)
    return nav.join(traded, list(keys), "left").select(*keys, value.alias("turnover"))


def avg_positions(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = positions.groupBy(*keys, "date").agg(F.count("symbol").alias("_n"))
    return per.groupBy(*keys).agg(F.avg("_n").alias("avg_positions"))


def avg_holding_period(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean days from first buy to last sale per symbol, over symbols with both in that order."""
    bought = F.min(F.when(F.col("side").isin("buy", "cover"), F.col("exec_date")))
    sold = F.max(F.when(F.col("side").isin("sell", "short"), F.col("exec_date")))
    per = trades.groupBy(*keys, "symbol").agg(F.datediff(sold, bought).alias("_days"))
    held = F.avg(F.when(F.col("_days") >= 0, F.col("_days").cast("double")))
    return per.groupBy(*keys).agg(F.coalesce(held, F.lit(0.0)).alias("holding_period"))


def avg_dividend_yield(income: DataFrame, curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    nav = curve.groupBy(*keys).agg(F.avg("nav").alias("_nav"), F.count(F.lit(1)).alias("_n"))
    paid = income.groupBy(*keys).agg(F.sum("dividend_income").alias("_paid"))
    ok = (F.col("_nav") > 0) & F.col("_paid").isNotNull()
    return nav.join(paid, list(keys), "left").select(*keys, F.when(ok, F.col("_paid") / F.col("_nav") / (F.col("_n") / YEAR)).otherwise(0.0).alias("dividend_yield"))


def metrics_bundle(
    curve: DataFrame, keys: Sequence[str], benchmark: DataFrame | None = None, trades: DataFrame | None = None,
    positions: DataFrame | None = None, income: DataFrame | None = None,
) -> DataFrame:
    """Return, risk, benchmark-relative, activity and income metrics of every run, one row each.

    A part whose table is not given is left out. A run without positions holds 0 of them, one without income yields 0.
    """
    rets = log_curve(curve, keys)
    r = F.col("ret")
    out = rets.groupBy(*keys).agg(
        cagr().alias("cagr"), total_return().alias("total_return"), annualized_vol(r).alias("annualized_vol"), sharpe(r).alias("sharpe"), sortino(r).alias("sortino"),
    ).join(drawdown(curve, keys).select(*keys, "max_drawdown", "drawdown_days"), list(keys))
    out = out.withColumn("calmar", calmar(F.col("cagr"), F.col("max_drawdown")))
    if benchmark is not None:
        aligned = align_returns(rets, log_curve(benchmark, []), keys)
        nw = newey_west(aligned, keys).drop("n")
        out = out.join(relative_metrics(aligned, keys), list(keys), "left").join(nw, list(keys), "left")
    if trades is not None:
        out = out.join(annualized_turnover(trades, curve, keys), list(keys), "left").join(avg_holding_period(trades, keys), list(keys), "left")
    if positions is not None:
        out = out.join(avg_positions(positions, keys), list(keys), "left").fillna(0.0, ["avg_positions"])
    if income is not None:
        out = out.join(avg_dividend_yield(income, curve, keys), list(keys), "left")
    return out


# --- verification -----------------------------------------------------------------------------


def walk_forward_splits(days: DataFrame, n_splits: int, mode: str = "expanding") -> DataFrame:
    """(split, is_start, is_end, oos_start, oos_end): n + 1 near-equal chunks of the trading days, the first
    chunks one day longer when the division leaves a rest."""
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    total = days.agg(F.count(F.lit(1))).scalar()
    w = Window.orderBy("date")
    placed = days.withColumn("_i", F.row_number().over(w) - 1).withColumn("_t", total)
    base, extra = F.floor(F.col("_t") / (n_splits + 1)), F.col("_t") % (n_splits + 1)
    head = extra * (base + 1)
    chunk = F.when(F.col("_i") < head, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - head) / base))
    chunks = placed.groupBy(chunk.cast("int").alias("_c")).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    order = Window.orderBy("_c")
    start = F.first("_from").over(order) if mode == "expanding" else F.lag("_from").over(order)
    return chunks.select(
        F.col("_c").alias("split"), start.alias("is_start"), F.lag("_to").over(order).alias("is_end"), F.col("_from").alias("oos_start"), F.col("_to").alias("oos_end"),
    ).where(F.col("split") > 0)


def curves_by_split(curve: DataFrame, splits: DataFrame, start: str = "oos_start", end: str = "oos_end") -> DataFrame:
    """Curve rows of each split's window, through the bucketed interval join."""
    ranges = splits.select("split", F.col(start).alias("_s"), F.date_add(end, 1).alias("_e"))
    return interval_join(curve, ranges, [], "date", "_s", "_e").drop("_s", "_e")


def combine_oos(per_split: DataFrame, keys: Sequence[str], metrics: Sequence[str], whole: Sequence[str] = ()) -> DataFrame:
    """Mean of the known metrics over splits; whole-number metrics are rounded half to even."""
    aggs = [F.avg(m).alias(m) for m in metrics] + [F.bround(F.avg(m), 0).cast("bigint").alias(m) for m in whole]
    return per_split.groupBy(*keys).agg(*aggs) if keys else per_split.agg(*aggs)


def sensitivity_grid(df: DataFrame, grid: dict[str, Sequence[object]], limit: int = 100) -> DataFrame:
    """Every row once per parameter combination: the grid is checked against `limit` and travels as an array."""
    size = 1
    for values in grid.values():
        size *= len(values)
    if size > limit:
        raise ValueError(f"grid of {size} combinations exceeds {limit}")
    out = df
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))
    return out.withColumn("run_id", F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in grid]))


def shuffle_future(rows: DataFrame, cutoff, keys: Sequence[str], values: Sequence[str], seed: int = 7) -> DataFrame:
    """Permute the value columns of rows after `cutoff`; keys stay. Row k in key order takes the values of
    row k in the order of a seeded hash, both numbered without a global sort in one task."""
    past = rows.where(F.col("date") <= F.lit(cutoff)).select(*keys, *values)
    later = rows.where(F.col("date") > F.lit(cutoff)).withColumn("_key", F.concat_ws("|", *keys)).withColumn("_all", F.lit(1))
    spots = position(later.withColumn("_v", F.xxhash64("_key").cast("double")), ["_all"], "_v", "_key", "_p")
    donors = position(later.withColumn("_v", F.xxhash64(F.lit(seed), "_key").cast("double")), ["_all"], "_v", "_key", "_p")
    moved = spots.select(*keys, "_p").join(donors.select("_p", *values), "_p").select(*keys, *values)
    return past.unionByName(moved)


def reverse_future(rows: DataFrame, cutoff, values: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each series' values after `cutoff` in reverse order of time; its dates, and all rows up to the cut, stay.

    Like `shuffle_future` a permutation of the future, by a rule that needs no seed: a run that reads no future cannot tell.
    """
    names = ["date", *values]
    future = rows.where(F.col("date") > F.lit(cutoff)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_f"))
    last = F.size("_f") - 1  # at most one calendar
    moved = F.transform("_f", lambda x, i: F.struct(x["date"].alias("date"), *[F.get("_f", last - i)[c].alias(c) for c in values]))
    reversed_ = future.select(*keys, F.inline(moved))
    return rows.where(F.col("date") <= F.lit(cutoff)).unionByName(reversed_)


def parameter_runs(rows: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """Every row once per run: `runs` has one row (run_id, parameters) each, at most `limit`, and its columns travel with the rows.

    Whatever follows groups by run_id too, so one plan builds the strategy of every run.
    """
    held = runs.limit(limit + 1).collect()  # bounded by the limit
    if len(held) > limit:
        raise ValueError(f"more than {limit} runs")
    if len({r.run_id for r in held}) < len(held):
        raise ValueError("run_id is repeated")
    every = F.array(*[F.struct(*[F.lit(r[c]).cast(runs.schema[c].dataType).alias(c) for c in runs.columns]) for r in held])
    return rows.withColumn("_run", F.explode(every)).select(*rows.columns, "_run.*") if held else rows.join(runs, F.lit(False))


def run_curves(bars: DataFrame, weights: DataFrame, keys: Sequence[str] = ("run_id",), price: str = "close") -> DataFrame:
    """Curve `keys, date, ret, nav` of weights over bars; nav is the log of what one unit became.

    Bars carry the keys in which they differ; runs over the same bars share their returns. A curve up to a date reads no later bar.
    """
    from tidemark.operators.accounting import weights_to_returns
    from tidemark.operators.timeseries import simple_returns

    shared = [k for k in keys if k in bars.columns]
    returns = simple_returns(bars, price, (*shared, "symbol")).select(*shared, "date", "symbol", "ret")
    held = weights_to_returns(weights, returns, keys)
    return held.withColumn("nav", F.sum(F.log1p("ret")).over(Window.partitionBy(*keys).orderBy("date")))


def shift_check(base: DataFrame, moved: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Sharpe of each run and of the same run with its weights a day early, which sees one day more: it should do no worse."""
    per = base.groupBy(*keys).agg(sharpe(F.col("ret")).alias("base")).join(moved.groupBy(*keys).agg(sharpe(F.col("ret")).alias("moved")), list(keys))
    return per.withColumn("passed", F.coalesce("moved", F.lit(0.0)) >= F.coalesce("base", F.lit(0.0)))


def leakage_check(base: DataFrame, shuffled: DataFrame, cutoff, tolerance: float = 1e-6) -> DataFrame:
    """Greatest difference of two runs' curves up to `cutoff` and whether it is within tolerance."""
    b = base.where(F.col("date") <= F.lit(cutoff)).select("run_id", "date", F.col("nav").alias("_a"))
    s = shuffled.where(F.col("date") <= F.lit(cutoff)).select("run_id", "date", F.col("nav").alias("_b"))
    gap = F.max(F.coalesce(F.abs(F.col("_a") - F.col("_b")), F.lit(float("inf"))))
    return b.join(s, ["run_id", "date"], "full_outer").groupBy("run_id").agg(gap.alias("max_diff")).withColumn("passed", F.col("max_diff") < tolerance)


def shift_dates_back(weights: DataFrame, calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weights moved to the previous trading day; a symbol landing twice on a day keeps the later weight."""
    prev = calendar.select("date", F.lag("date").over(Window.orderBy("date")).alias("_prev"))
    moved = weights.join(prev, "date").where(F.col("_prev").isNotNull())
    return moved.groupBy(*keys, F.col("_prev").alias("date"), "symbol").agg(F.max_by("weight", "date").alias("weight"))


def static_universe(members: DataFrame, days: DataFrame) -> DataFrame:
    """Members frozen at the end of a span over every date of a spine: the spine travels as one array per row."""
    spine = days.agg(F.sort_array(F.collect_list("date"))).scalar()
    return members.select("index_name", "symbol").distinct().withColumn("date", F.explode(spine))


def random_universes(members: DataFrame, samples: int, size: int, seed: int = 42) -> DataFrame:
    """Seeded samples of `size` historical members; Spark cuts each partition to `size` per sample first."""
    from tidemark.operators.ranking import top_k

    pool = members.select("symbol").distinct().withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return top_k(pool, ["sample_id"], size, [F.xxhash64(F.lit(seed), "sample_id", "symbol"), F.col("symbol")])


def survivorship_percentile(random_sharpes: DataFrame, pit_sharpe: Column) -> DataFrame:
    return random_sharpes.agg((F.avg((F.col("sharpe") <= pit_sharpe).cast("double")) * 100).alias("percentile"), F.count(F.lit(1)).alias("n"))


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def config_hash_of(settings: dict[str, Column]) -> Column:
    """`config_hash` of each row's settings: keys in order, null where a value is unknown.

    It equals the driver's hash for whole numbers, truth values, dates and ASCII text; floating numbers and other text are spelled
    differently by the two.
    """
    ordered = F.struct(*[settings[name].alias(name) for name in sorted(settings)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


