"""Screening: null-aware predicates, columns derived on demand, valuation and dividend summaries."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import years_between
from tidemark.functions.numeric import clean_double, safe_ratio
from tidemark.operators.joins import latest_by
from tidemark.operators.pit import fundamentals_asof, pit_constituents, version_order

Condition = tuple
# The predicate operators.
OPERATORS = ("<", "<=", ">", ">=", "==", "!=", "between", "in", "not_in")


def validate_conditions(conditions: dict[str, Condition]) -> None:
    for name, cond in conditions.items():
        if not isinstance(cond, tuple) or len(cond) < 2:
            raise ValueError(f"condition on {name!r} must be (op, value) or ('between', lo, hi), got {cond!r}")
        if cond[0] not in OPERATORS:
            raise ValueError(f"unknown operator {cond[0]!r} on {name!r}")
        if cond[0] == "between" and (len(cond) != 3 or cond[1] > cond[2]):
            raise ValueError(f"between on {name!r} needs lo <= hi, got {cond[1:]!r}")


def check_columns(df: DataFrame, names: Sequence[str]) -> None:
    for name in names:
        if name not in df.columns:
            near = difflib.get_close_matches(name, df.columns, n=3)
            raise KeyError(f"column {name!r} not found; close names: {near}; available: {sorted(df.columns)}")


def predicate(name: str, cond: Condition) -> Column:
    """An unknown value fails every comparison except `!=` and `not_in`, which it passes."""
    c, op, value = F.col(name), cond[0], cond[1]
    test = {
        "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value,
        "==": lambda: c == value, "!=": lambda: c != value, "between": lambda: c.between(value, cond[2]),
        "in": lambda: c.isin(list(value)), "not_in": lambda: ~c.isin(list(value)),
    }[op]()
    return F.coalesce(test, F.lit(op in ("!=", "not_in")))


def screen_predicates(df: DataFrame, conditions: dict[str, Condition]) -> DataFrame:
    """Rows passing every condition; NaN in a double column counts as unknown."""
    validate_conditions(conditions)
    check_columns(df, list(conditions))
    doubles = {n for n, t in df.dtypes if t == "double"} & set(conditions)
    out = df.withColumns({n: clean_double(F.col(n)) for n in doubles}) if doubles else df
    for name, cond in conditions.items():
        out = out.where(predicate(name, cond))
    return out


# --- aggregates per symbol --------------------------------------------------------------------


def trailing(facts: DataFrame, asof: date, years: int, day: str = "report_date") -> DataFrame:
    return facts.where((F.col(day) >= F.add_months(F.lit(asof), -12 * years)) & (F.col(day) <= F.lit(asof)))


def trailing_mean(facts: DataFrame, asof: date, column: str, years: int, out: str) -> DataFrame:
    # The order of a float sum shows in its last digits; cut, equal means compare alike in any order.
    return trailing(facts, asof, years).groupBy("symbol").agg(F.round(F.avg(column), 12).alias(out))


def growth(first: Column, last: Column, years: Column, n: Column) -> Column:
    return F.when((n >= 2) & (first > 0) & (years > 0), F.pow(last / first, 1 / years) - 1)


def growth_cagr(facts: DataFrame, asof: date, column: str, years: int, out: str) -> DataFrame:
    """Growth between the first and last known value of a trailing span."""
    known = trailing(facts, asof, years).where(F.col(column).isNotNull())
    d = F.col("report_date")
    return known.groupBy("symbol").agg(
        growth(
            F.min_by(column, d), F.max_by(column, d), years_between(F.min(d), F.max(d)), F.count(F.lit(1))
        ).alias(out)
    )


def cash_amount(params: Column) -> Column:
    """Cash per share out of an action payload; anything unreadable is zero."""
    return F.coalesce(
        F.get_json_object(params, "$.amount_per_share").try_cast("double"), F.lit(0.0)
    )


def annual_dividends(actions: DataFrame) -> DataFrame:
    """(symbol, year, amount); `actions` has kind, ex_date, amount."""
    cash = actions.where(F.col("kind") == "cash_dividend")
    return cash.groupBy("symbol", F.year("ex_date").alias("year")).agg(F.sum("amount").alias("amount"))


def dividend_growth_cagr(actions: DataFrame, asof: date, years: int, out: str = "dividend_growth") -> DataFrame:
    yearly = annual_dividends(trailing(actions, asof, years, "ex_date"))
    y = F.col("year")
    return yearly.groupBy("symbol").agg(
        growth(F.min_by("amount", y), F.max_by("amount", y), (F.max(y) - F.min(y)).cast("double"), F.count(F.lit(1)))
        .alias(out)
    )


def dividend_grade(actions: DataFrame, asof: date, window_years: int = 10) -> DataFrame:
    """A to F by the number of paid years, cuts among the last five, gaps and growth.

    A symbol without any dividend has no row here; callers read that as F.
    """
    first_day = F.lit(date(asof.year - window_years + 1, 1, 1))
    yearly = annual_dividends(actions.where(F.col("ex_date").between(first_day, F.lit(asof))))
    yearly = yearly.withColumn("amount", F.round("amount", 9))  # equal years stay equal in whatever order their payments were added
    w = Window.partitionBy("symbol").orderBy("year")
    newest = Window.partitionBy("symbol").orderBy(F.desc("year"))
    y = F.col("year")
    seen = yearly.withColumn("_diff", F.col("amount") - F.lag("amount").over(w)).withColumn(
        "_recent", F.row_number().over(newest)
    )
    per = seen.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("paid_years"),
        # Five recent years have four changes.
        F.coalesce(F.bool_or((F.col("_recent") <= 4) & (F.col("_diff") < 0)), F.lit(False)).alias("recent_cut"),
        F.coalesce(F.bool_or(F.col("_diff") < 0), F.lit(False)).alias("_any_cut"),
        F.min_by("amount", y).alias("_a0"), F.max_by("amount", y).alias("_a1"),
    )
    n, cut = F.col("paid_years"), F.col("recent_cut")
    unbroken = (n == window_years) & ~F.col("_any_cut")
    rate = F.when(F.col("_a0") > 0, F.pow(F.col("_a1") / F.col("_a0"), F.lit(1 / (window_years - 1))) - 1)
    grade = (
        F.when(n < 3, "F").when(n <= 4, "E").when(n <= 6, "D")
        .when((n >= 10) & unbroken, F.when(rate >= 0.08, "A").otherwise("B"))
        .otherwise(F.when(cut, "D").otherwise("C"))
    )
    return per.select("symbol", "paid_years", "recent_cut", grade.alias("grade"))


def owner_earnings(facts: DataFrame) -> DataFrame:
    parts = ["net_income", "d_and_a", "capex", "working_capital_change"]
    value = F.col("net_income") + F.col("d_and_a") - F.col("capex") - F.col("working_capital_change")
    return facts.dropna(subset=parts).select("symbol", "report_date", value.alias("owner_earnings"))


def owner_earnings_yield(facts: DataFrame) -> DataFrame:
    """Latest owner earnings over latest market cap; a zero cap gives NULL."""
    oe = owner_earnings(facts).groupBy("symbol").agg(F.max_by("owner_earnings", "report_date").alias("_oe"))
    cap = facts.groupBy("symbol").agg(F.max_by("market_cap", "report_date").alias("_cap"))
    return cap.join(oe, "symbol", "left").select("symbol", safe_ratio(F.col("_oe"), F.col("_cap")).alias("owner_earnings_yield"))


def oe_summary(facts: DataFrame) -> DataFrame:
    oe = owner_earnings(facts)
    mean = F.avg("owner_earnings")
    return oe.groupBy("symbol").agg(
        F.max_by("owner_earnings", "report_date").alias("latest"), mean.alias("mean"),
        safe_ratio(F.stddev_samp("owner_earnings"), F.abs(mean)).alias("cv"),
    )


def valuation_bands(history: DataFrame, column: str, day: str = "report_date") -> DataFrame:
    """Interpolated 10/25/50/75/90 percentiles, current value, its percentile and the covered years.

    The share of values at or below the current one needs no sort: the current value joins back on symbol.
    """
    rows = history.where(F.col(column).isNotNull())
    per = rows.groupBy("symbol").agg(
        F.expr(f"percentile({column}, array(0.1, 0.25, 0.5, 0.75, 0.9))").alias("_p"),
        F.max_by(column, day).alias("current"),
        years_between(F.min(day), F.max(day)).alias("years"),
    )
    share = rows.join(per.select("symbol", "current"), "symbol").groupBy("symbol").agg(
        (F.avg((F.col(column) <= F.col("current")).cast("double")) * 100).alias("percentile")
    )
    names = ["p10", "p25", "p50", "p75", "p90"]
    return per.join(share, "symbol").select(
        "symbol", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)], "current", "percentile", "years"
    )


def metric_trajectory(facts: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long series (symbol, metric, report_date, value)."""
    return facts.unpivot(["symbol", "report_date"], list(metrics), "metric", "value").where(F.col("value").isNotNull())


# --- the screen -------------------------------------------------------------------------------


def derived_columns(facts: DataFrame, actions: DataFrame | None, asof: date) -> dict[str, Callable[[], DataFrame]]:
    """Builders of the derived columns, each called only when a condition names it."""
    def grade() -> DataFrame:
        return dividend_grade(actions, asof).select("symbol", F.col("grade").alias("dividend_consistency_grade"))

    return {
        "roe_3y_avg": lambda: trailing_mean(facts, asof, "roe", 3, "roe_3y_avg"),
        "roe_5y_avg": lambda: trailing_mean(facts, asof, "roe", 5, "roe_5y_avg"),
        "revenue_growth_3y_cagr": lambda: growth_cagr(facts, asof, "revenue", 3, "revenue_growth_3y_cagr"),
        "net_income_growth_3y_cagr": lambda: growth_cagr(facts, asof, "net_income", 3, "net_income_growth_3y_cagr"),
        "dividend_growth_5y_cagr": lambda: dividend_growth_cagr(actions, asof, 5, "dividend_growth_5y_cagr"),
        "dividend_consistency_grade": grade,
        "owner_earnings_yield": lambda: owner_earnings_yield(facts),
    }


def run_screen(
    conditions: dict[str, Condition],
    facts: DataFrame,
    sectors: DataFrame,
    asof: date,
    members: DataFrame | None = None,
    universe: str | None = None,
    actions: DataFrame | None = None,
    latest_only: bool = True,
) -> DataFrame:
    """Members of a universe at `asof` with the facts known then, screened; one lazy plan.

    `latest_only` keeps the newest report of each symbol, otherwise every known report is screened.
    """
    validate_conditions(conditions)
    known = fundamentals_asof(facts, asof)
    if members is not None:
        names = pit_constituents(members.where(F.col("index_name") == universe), asof).select("symbol")
        known = known.join(names, "symbol", "left_semi")
    base = latest_by(known, ["symbol"], [F.col("report_date"), *version_order(facts)]) if latest_only else known
    base = base.join(sectors.select("symbol", "sector_l1", "sector_l2"), "symbol", "left")
    for name, build in derived_columns(known, actions, asof).items():
        if name in conditions and name not in base.columns:
            base = base.join(build(), "symbol", "left")
            if name == "dividend_consistency_grade":
                base = base.fillna("F", [name])
    return screen_predicates(base, conditions)


def screen_counts(base: DataFrame, conditions: dict[str, Condition]) -> DataFrame:
    """n_input and n_passed in one aggregate."""
    passed = F.lit(True)
    for name, cond in conditions.items():
        passed = passed & predicate(name, cond)
    return base.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(passed).alias("n_passed"))


# --- defaults, snapshots ----------------------------------------------------------------------


def fundamentals_defaults(facts: DataFrame) -> DataFrame:
    """Fill absent columns: known when published, audited, and return on invested capital where positive."""
    out = facts
    if "known_as_of" not in out.columns:
        out = out.withColumn("known_as_of", F.col("publication_date"))
    if "statement_kind" not in out.columns:
        out = out.withColumn("statement_kind", F.lit("audited"))
    if "roic" not in out.columns:
        invested = F.col("total_equity") + F.col("total_debt")
        out = out.withColumn("roic", F.when(invested > 0, F.col("net_income") / invested))
    return out


def snapshot_diff(before: DataFrame, after: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Change of each metric for symbols present in both snapshots."""
    b = before.select("symbol", *[F.col(m).alias(f"_{m}") for m in metrics])
    return after.join(b, "symbol").select("symbol", *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in metrics])


def watchlist_snapshot(
    lists: DataFrame, bars: DataFrame, facts: DataFrame, sectors: DataFrame, asof: date
) -> DataFrame:
    """Metrics of every listed symbol at a date; `lists` has (watchlist_name, symbol), `bars` the back-adjusted close_hfq, which
    is the price."""
    price = bars.where(F.col("date") <= F.lit(asof)).groupBy("symbol").agg(F.max_by("close_hfq", "date").alias("price"))
    newest = latest_by(
        fundamentals_asof(facts, asof), ["symbol"], [F.col("report_date")],
        ["pe", "pb", "dividend_yield", "roe", "market_cap"],
    )
    rows = lists.join(price, "symbol", "left").join(newest, "symbol", "left")
    rows = rows.join(sectors.select("symbol", "sector_l1"), "symbol", "left")
    return rows.withColumn("snapshot_date", F.lit(asof))
