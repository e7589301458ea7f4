"""Cross-sectional research: information coefficients, quantile returns, signals of the stock strategies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import latest_by
from tidemark.operators.pit import latest_non_null, month_ends_between, version_order, version_ranges
from tidemark.session import settle
from tidemark.operators.ranking import position, rank_averages, with_group_stats


def demean_by_group(signals: DataFrame, sectors: DataFrame) -> DataFrame:
    """Signal minus the mean of its sector on its date; without a sector the result is NULL."""
    rows = signals.join(sectors.select("symbol", "sector_l1"), "symbol", "left")
    out = with_group_stats(rows, ["date", "sector_l1"], _mean=F.avg("signal"))
    return out.withColumn("signal", F.col("signal") - F.col("_mean")).drop("_mean")


def composite_rank(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean rank of earnings yield, book yield and dividend yield; incomplete rows drop out."""
    inverse = lambda c: F.when(F.col(c) > 0, 1 / F.col(c))
    rows = facts.withColumns({"_ey": inverse("pe"), "_by": inverse("pb"), "_dy": F.col("dividend_yield")}).dropna(
        subset=["_ey", "_by", "_dy"]
    )
    rows = settle(rows.select(*by, "symbol", "_ey", "_by", "_dy"))  # ranked three times, made once
    rows = rank_averages(rows, by, {c: f"{c}_rank" for c in ("_ey", "_by", "_dy")})
    mean = (F.col("_ey_rank") + F.col("_by_rank") + F.col("_dy_rank")) / 3
    return rows.select(*by, "symbol", mean.alias("signal"))


def quantile_bucket(signals: DataFrame, q: int, by: Sequence[str] = ("date",)) -> DataFrame:
    """Equal-frequency bucket 1..q of the rank within `by` (ties by symbol); groups smaller than q drop out."""
    sized = with_group_stats(signals.where(F.col("signal").isNotNull()), by, _size=F.count(F.lit(1))).where(F.col("_size") >= q)
    placed = position(sized, by, "signal", "symbol", "_pos")
    edge = F.ceil((F.col("_pos") - 1) * q / (F.col("_size") - 1))
    return placed.withColumn("quantile", F.greatest(F.lit(1), edge).cast("int")).drop("_pos", "_size")


def ic_by_date(signals: DataFrame, forward: DataFrame) -> DataFrame:
    """Spearman correlation per (date, horizon) of signal and forward return over known pairs."""
    by = ["date", "horizon"]
    pairs = settle(signals.where(F.col("signal").isNotNull()).join(forward, ["date", "symbol"]))
    ranked = rank_averages(pairs, by, {"signal": "_rs", "fwd": "_rf"})
    ic = F.corr("_rs", "_rf")
    return ranked.groupBy(*by).agg(F.when((F.count(F.lit(1)) >= 2) & ~F.isnan(ic), ic).alias("ic"))


def hac_lag(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))).cast("int")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def lagged_products(series: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Bartlett-weighted sums over lags of left[t] * right[t - l], per key, one column per (left, right) of `pairs`.

    `series` has (keys, _t, _lags): the observation number and the number of lags of its key. Each row
    lists the later rows it meets, so lags are an equi-join of at most `_lags` rows per row.
    """
    lefts, rights = ({p[i] for p in pairs.values()} for i in (0, 1))
    values = [F.col(c).alias(f"_y{c}") for c in sorted(rights)]
    later = series.select(*keys, *values, F.explode(F.sequence(F.lit(1), F.col("_lags"))).alias("_l"), F.col("_t"), "_lags")
    later = later.select(*keys, (F.col("_t") + F.col("_l")).alias("_t"), (1 - F.col("_l") / (F.col("_lags") + 1)).alias("_w"), *[f"_y{c}" for c in sorted(rights)])
    met = series.select(*keys, "_t", *[F.col(c).alias(f"_x{c}") for c in sorted(lefts)]).join(later, [*keys, "_t"])
    return met.groupBy(*keys).agg(*[F.sum(F.col("_w") * F.col(f"_x{x}") * F.col(f"_y{y}")).alias(n) for n, (x, y) in pairs.items()])


def numbered(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observation numbers and HAC lags per key; a key holds one observation per date."""
    w = Window.partitionBy(*keys).orderBy("date")
    sized = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return sized.withColumn("_t", F.row_number().over(w)).withColumn("_lags", hac_lag(F.col("_n")))


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean IC, HAC t statistic and p value, and IR per horizon."""
    per = Window.partitionBy("horizon")
    rows = numbered(ic.where(F.col("ic").isNotNull()), ["horizon"])
    rows = rows.withColumns({"_mean": F.avg("ic").over(per), "_sd": F.stddev_samp("ic").over(per)})
    rows = settle(rows.withColumn("_e", F.col("ic") - F.col("_mean")))
    base = rows.groupBy("horizon").agg(
        F.first("_n").alias("n"), F.first("_mean").alias("mean_ic"), F.first("_sd").alias("_sd"), F.sum(F.col("_e") * F.col("_e")).alias("_g0"),
    )
    out = base.join(lagged_products(rows, ["horizon"], {"_gamma": ("_e", "_e")}), "horizon", "left")
    variance = (F.col("_g0") + 2 * F.coalesce(F.col("_gamma"), F.lit(0.0))) / (F.col("n") * F.col("n"))
    t = F.when(variance > 0, F.col("mean_ic") / F.sqrt(variance))
    ir = F.when(F.col("_sd") > 0, F.col("mean_ic") / F.col("_sd")).otherwise(F.lit(0.0))
    return out.where("n >= 2").select("horizon", "n", "mean_ic", t.alias("nw_t_stat"), ir.alias("ir")).withColumn(
        "nw_p_value", normal_two_sided("nw_t_stat")
    )


def quantile_returns(signals: DataFrame, forward: DataFrame, q: int, horizon: int) -> DataFrame:
    """(date, quantile, ret) mean forward return of each bucket."""
    fwd = forward.where(F.col("horizon") == horizon).select("date", "symbol", "fwd")
    return quantile_bucket(signals, q).join(fwd, ["date", "symbol"], "left").groupBy("date", "quantile").agg(F.avg("fwd").alias("ret"))


def long_short(buckets: DataFrame, q: int) -> DataFrame:
    """One row per date: Q1..Qq and the spread of the last over the first."""
    cols = [F.max(F.when(F.col("quantile") == i, F.col("ret"))).alias(f"Q{i}") for i in range(1, q + 1)]
    return buckets.groupBy("date").agg(*cols).withColumn("long_short", F.col(f"Q{q}") - F.col("Q1"))


def quantile_curve(buckets: DataFrame) -> DataFrame:
    """Compounded value of 100 per bucket; one row per bucket and date."""
    w = Window.partitionBy("quantile").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.where(F.col("ret").isNotNull()).withColumn("nav", F.product(1 + F.col("ret")).over(w) * 100)


def block_bootstrap(series: DataFrame, n_resamples: int, block: int, seed: int = 42) -> DataFrame:
    """Mean, 95% interval and one-sided p value of the mean under block resampling.

    `series` has (date, value), one row per date. Block starts come from a seeded hash, so a retried task
    draws the same resample.
    """
    known = series.where(F.col("value").isNotNull())
    idx = known.select("value", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))
    n = known.agg(F.count(F.lit(1))).scalar()
    draws = (
        series.sparkSession.range(n_resamples).withColumn("_n", n).where(F.col("_n") >= block)
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)))
        .withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), "id", "_b"), F.col("_n") - block + 1))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
        .where(F.col("_b") * block + F.col("_o") < F.col("_n"))
        .select("id", (F.col("_s") + F.col("_o")).alias("idx"))
    )
    means = draws.join(idx, "idx").groupBy("id").agg(F.avg("value").alias("m"))
    out = means.agg(
        F.avg("m").alias("mean"), F.expr("percentile(m, 0.025)").alias("ci_low"), F.expr("percentile(m, 0.975)").alias("ci_high"),
        F.avg((F.col("m") <= 0).cast("double")).alias("_le"), F.avg((F.col("m") >= 0).cast("double")).alias("_ge"),
    )
    return out.withColumn("p_value", F.when(F.col("mean") > 0, F.col("_le")).otherwise(F.col("_ge"))).drop("_le", "_ge")


def curve_summary(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    from tidemark.operators.metrics import cagr, drawdown, sharpe

    stats = curve.groupBy(*keys).agg(cagr().alias("cagr"), sharpe(F.col("ret")).alias("sharpe"))
    return stats.join(drawdown(curve, keys).select(*keys, "max_drawdown"), list(keys))


STUDY = ("ic_by_horizon", "ic_summary", "ic_decay", "quantile_returns", "quantile_summary")


def factor_study(
    signals: DataFrame, forward: DataFrame, horizons: Sequence[int], sectors: DataFrame | None = None, q: int = 5, parts: Sequence[str] = STUDY
) -> dict[str, DataFrame]:
    """Parts of a study over all dates and horizons: IC table, summary, decay, buckets, curves. What no asked part needs is not made."""
    used = demean_by_group(signals, sectors).select("date", "symbol", "signal") if sectors is not None else signals
    out = {}
    if any(p.startswith("ic_") for p in parts):
        ic = settle(ic_by_date(used, forward))
        summary = ic_summary(ic)
        out |= {"ic_by_horizon": ic, "ic_summary": summary, "ic_decay": summary.select("horizon", "mean_ic")}
    if any(p.startswith("quantile_") for p in parts):
        buckets = settle(quantile_returns(used, forward, q, max(horizons)))
        out |= {"quantile_returns": long_short(buckets, q), "quantile_summary": curve_summary(quantile_curve(buckets), ["quantile"])}
    return {p: out[p] for p in parts}


# --- strategy signals -------------------------------------------------------------------------


def known_at_month_ends(facts: DataFrame, start: date, end: date, columns: Sequence[str]) -> DataFrame:
    """Per (date, symbol) the last known value of each column at every month end of a span.

    A column is carried until a newer report of the symbol is known: (report, version) order decides. A version lists its
    month ends only until a newer report is known for good with a value in every column, so a symbol lists each month end
    about once, not once per report. The facts are dealt by symbol once; the listed rows are not shuffled.
    """
    order = [F.col("report_date"), *version_order(facts)]
    needed = ["symbol", "report_date", "publication_date", "known_as_of", "statement_kind", *columns]
    rows = facts.select(*needed, *(["fact_id"] if "fact_id" in facts.columns else [])).repartition("symbol")
    ranges = version_ranges(rows)
    lasting = F.col("valid_to").isNull()
    for c in columns:
        lasting = lasting & F.col(c).isNotNull()
    newer = Window.partitionBy("symbol").orderBy(F.unix_date("report_date")).rangeBetween(1, Window.unboundedFollowing)
    until = F.least("valid_to", F.min(F.when(lasting, F.col("valid_from"))).over(newer))
    listed = ranges.withColumn("_until", until).withColumn("_lo", F.greatest(F.col("valid_from"), F.lit(start)))
    listed = listed.withColumn("_hi", F.least(F.date_sub("_until", 1), F.lit(end))).where(F.col("_lo") <= F.col("_hi"))
    known = listed.withColumn("date", F.explode(month_ends_between(F.col("_lo"), F.col("_hi"))))
    return latest_non_null(known, ["date", "symbol"], order, columns)


def value_signal(facts: DataFrame, universe: DataFrame, start: date, end: date) -> DataFrame:
    """Composite value rank of the index members (`universe` has date, symbol) at month ends.

    Facts of symbols that are never members fall out before they are laid out over the months.
    """
    members = settle(universe.select("date", "symbol").distinct())
    held = facts.join(members.select("symbol").distinct(), "symbol", "left_semi")
    known = known_at_month_ends(held, start, end, ["pe", "pb", "dividend_yield"])
    return composite_rank(known.join(members, ["date", "symbol"], "left_semi"), ["date"])


def dividend_continuity(actions: DataFrame, start: date, end: date, days: int = 1095, least: int = 3) -> DataFrame:
    """(as_of, symbol, n_paid) with at least `least` cash dividends in the trailing days, at month ends.

    A dividend lists the month ends it counts for.
    """
    cash = actions.where(F.col("kind") == "cash_dividend").select("symbol", "ex_date")
    lo, hi = F.greatest("ex_date", F.lit(start)), F.least(F.date_add("ex_date", days - 1), F.lit(end))
    return (
        cash.where(lo <= hi).select("symbol", F.explode(month_ends_between(lo, hi)).alias("as_of"))
        .groupBy("as_of", "symbol").agg(F.count(F.lit(1)).alias("n_paid")).where(F.col("n_paid") >= least)
    )


def dividend_yield_signal(facts: DataFrame, actions: DataFrame, start: date, end: date) -> DataFrame:
    payers = settle(dividend_continuity(actions, start, end).select(F.col("as_of").alias("date"), "symbol"))
    paid = facts.join(payers.select("symbol").distinct(), "symbol", "left_semi")
    known = known_at_month_ends(paid, start, end, ["dividend_yield"]).where(F.col("dividend_yield").isNotNull())
    return known.join(payers, ["date", "symbol"], "left_semi").select("date", "symbol", F.col("dividend_yield").alias("signal"))


def premium_zscore_signal(premium: DataFrame, rows: int = 60) -> DataFrame:
    """z of the premium of each pair on its last observation of every Friday week."""
    from tidemark.functions.dates import week_end_friday
    from tidemark.operators.timeseries import rolling_zscore

    keys = ["symbol_a", "symbol_h"]
    z = rolling_zscore(premium, "premium", keys, rows)
    weekly = z.withColumn("friday", week_end_friday(F.col("date")))
    return latest_by(weekly, [*keys, "friday"], [F.col("date")], ["zscore"])


def _scale_chain(pdf: pd.DataFrame, leg: float, max_gross: float) -> Iterator:
    """Cumulative gross scaling per date, as its logarithm, from counts of open pairs by entry date (one calendar of rows).

    The scaling since the start falls below the smallest double within a few hundred weeks of many pairs; its logarithm does
    not, and a weight needs the scaling since its entry alone.
    """
    chain, before = {}, 0.0
    for day, grp in pdf.groupby("friday", sort=True):
        entered = grp["entry"].map(lambda e, b=before: chain.get(e, b) if e != day else b)
        gross = 2 * leg * float((grp["n"] * np.exp(before - entered)).sum())
        scale = max_gross / gross if gross > max_gross else 1.0
        chain[day] = before
        before += math.log(scale)
        yield day, chain[day], scale


def pair_state(z: DataFrame, entry: float = 2.0, exit_: float = 0.5, leg: float = 0.1, max_gross: float = 1.0) -> DataFrame:
    """Weights of the pairs trade: enter at z < -entry, leave at |z| < exit, otherwise carry.

    Entering while open and leaving while closed change nothing, so the state is the last event of the
    pair. An open pair with z below -entry or above -exit stays open but has no weight that week. When the
    gross passes `max_gross` every open pair shrinks for good; that chain only needs the count of weighted
    pairs per (week, entry week), so it runs over one calendar of counts while the pairs stay distributed.
    """
    keys = ["symbol_a", "symbol_h"]
    w = Window.partitionBy(*keys).orderBy("friday")
    x = F.col("zscore")
    event = F.when(x < -entry, F.lit(True)).when(F.abs(x) < exit_, F.lit(False))
    state = z.withColumn("_event", event).withColumn("_open", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    state = state.withColumn("_was", F.coalesce(F.lag("_open").over(w), F.lit(False)))
    state = state.withColumn("entry", F.last(F.when(F.col("_open") & ~F.col("_was"), F.col("friday")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    weighted = (
        (x.isNull() & F.col("_was")) | (~F.col("_was") & (x < -entry)) | (F.col("_was") & (x >= -entry) & (x < -exit_))
    )
    rows = state.where(weighted).select(*keys, "friday", "entry")
    counts = rows.groupBy("friday", "entry").agg(F.count(F.lit(1)).alias("n"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_scale_chain(pdf, leg, max_gross)), columns=["friday", "log_before", "scale"])

    scales = counts.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(chain, "friday date, log_before double, scale double")
    at_entry = scales.select(F.col("friday").alias("entry"), F.col("log_before").alias("_b0"))
    weight = F.lit(leg) * F.exp(F.col("log_before") - F.col("_b0")) * F.col("scale")
    legs = rows.join(scales, "friday").join(at_entry, "entry").withColumn("_w", weight)
    both = F.explode(F.array(
        F.struct(F.col("symbol_a").alias("symbol"), F.col("_w").alias("weight")),
        F.struct(F.col("symbol_h").alias("symbol"), (-F.col("_w")).alias("weight")),
    ))
    return legs.select(F.col("friday").alias("date"), both.alias("_l")).select("date", "_l.*").groupBy("date", "symbol").agg(F.sum("weight").alias("weight"))


