"""Series operators on daily bars: adjustment, returns, resampling, spines and gap filling.

Bars are unique per (date, symbol), so windows partitioned by symbol hold one calendar at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import period_end
from tidemark.functions.numeric import log_ratio
from tidemark.operators.joins import asof_join, asof_on_axis

UNBOUNDED = Window.unboundedPreceding


def by_symbol(*order: str):
    return Window.partitionBy("symbol").orderBy(*(order or ("date",)))


# --- returns and limits -----------------------------------------------------------------------


def prev_close(bars: DataFrame, price: str = "close") -> DataFrame:
    """Close of the previous bar; a first bar has its own close."""
    lagged = F.lag(price).over(by_symbol())
    return bars.withColumn("prev_close", F.coalesce(lagged, F.col(price)))


def daily_limits(bars: DataFrame) -> DataFrame:
    """Limit bands around the previous close and whether the bar touched them.

    Ticks are two decimals, rounded half up. Hong Kong has no limit; the sentinels say so.
    """
    w = by_symbol()
    known = F.lag("close").over(w).isNotNull()
    # Limit shares by board and status.
    pct = (
        F.when(F.col("symbol").rlike(r"^(300|688).*\.S[HZ]$"), F.lit(0.20))
        .when(F.col("is_st"), F.lit(0.05))
        .otherwise(F.lit(0.10))
    )
    unlimited = F.col("symbol").endswith(".HK")
    def tick(price: Column) -> Column:
        return F.round(price.cast("decimal(20,6)"), 2).cast("double")

    up = F.when(unlimited, F.lit(1e9)).otherwise(tick(F.col("prev_close") * (1 + pct)))
    down = F.when(unlimited, F.lit(0.0)).otherwise(tick(F.col("prev_close") * (1 - pct)))
    return (
        prev_close(bars)
        .withColumn("_known", known)
        .withColumn("limit_up", up)
        .withColumn("limit_down", down)
        .withColumn("hit_limit_up", F.col("_known") & (F.col("high") >= F.col("limit_up") - 0.01))
        .withColumn("hit_limit_down", F.col("_known") & (F.col("low") <= F.col("limit_down") + 0.01))
        .drop("_known")
    )


def simple_returns(bars: DataFrame, price: str = "close", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    before = F.lag(price).over(w)
    return bars.withColumn("ret", F.coalesce(F.col(price) / before - 1, F.lit(0.0)))


def log_returns(bars: DataFrame, price: str = "close", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return bars.withColumn("log_ret", log_ratio(F.col(price), F.lag(price).over(w)))


def panel_index(bars: DataFrame) -> DataFrame:
    """Dense index of the distinct dates of the whole panel (one row per date, calendar sized)."""
    days = bars.select("date").distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def forward_log_return(bars: DataFrame, horizons: Sequence[int], price: str = "close") -> DataFrame:
    """ln(p[t+h]/p[t]) over h dates of the panel calendar, for each horizon, as rows (date, symbol, horizon).

    Bars carry their panel index, so the bar exactly h panel days ahead is a range frame of one value over
    (symbol, idx): one shuffle by symbol for all horizons.
    """
    placed = bars.join(panel_index(bars), "date").select("symbol", "date", F.col("idx").cast("long").alias("idx"), price)
    along = Window.partitionBy("symbol").orderBy("idx")
    ahead = {h: log_ratio(F.max(price).over(along.rangeBetween(int(h), int(h))), F.col(price)) for h in horizons}
    rows = placed.select("date", "symbol", F.array(*[F.struct(F.lit(int(h)).alias("horizon"), c.alias("fwd")) for h, c in ahead.items()]).alias("_ahead"))
    return rows.select("date", "symbol", F.inline("_ahead")).where(F.col("fwd").isNotNull())


def rolling_zscore(df: DataFrame, value: str, keys: Sequence[str], rows: int = 60, out: str = "zscore") -> DataFrame:
    """Trailing z-score; NULL before max(10, rows/2) observations or when the spread vanishes."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(rows - 1), 0)
    n, mean, sd = F.count(value).over(w), F.avg(value).over(w), F.stddev_samp(value).over(w)
    usable = (n >= max(10, rows // 2)) & (sd >= 1e-10)
    return df.withColumn(out, F.when(usable, (F.col(value) - mean) / sd))


# --- corporate actions ------------------------------------------------------------------------


def action_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Back-adjustment and total-return factor of each action, priced on the close strictly before it.

    `actions` carries kind, ex_date, amount and ratio. Actions without a usable price or ratio drop out.
    """
    closes = bars.select("symbol", F.col("date").alias("_price_date"), F.col("close").alias("base_close"))
    days = asof_on_axis(actions.select("symbol", "ex_date").distinct(), closes, ["symbol"], "ex_date", "_price_date", strict=True)
    priced = actions.join(days.drop("_price_date"), ["symbol", "ex_date"], "left")  # an action without a symbol or day stays, unpriced
    kind, p, d, r = F.col("kind"), F.col("base_close"), F.col("amount"), F.col("ratio")
    usable = F.coalesce(p > 0, F.lit(False))
    back = (
        F.when((kind == "cash_dividend") & usable, (p - d) / p)
        .when((kind == "split") & usable & (r > 0), 1 / r)
        .when((kind == "reverse_split") & usable & (r > 0), r)
    )
    total = (
        F.when((kind == "cash_dividend") & usable, 1 + d / p)
        .when(kind.isin("split", "reverse_split") & usable & (r > 0), F.lit(1.0))
    )
    return priced.withColumn("hfq_factor", back).withColumn("tr_factor", total).where(
        F.col("hfq_factor").isNotNull()
    )


def adjust_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """close_hfq: close times the factors of all later actions; total_return: close times those so far.

    Factors of one day are multiplied first, then bars and action days share one date axis per symbol, dealt once.
    """
    daily = factors.groupBy("symbol", F.col("ex_date").alias("date")).agg(
        F.product("hfq_factor").alias("_h"), F.product("tr_factor").alias("_t")
    )
    axis = bars.withColumn("_bar", F.lit(True)).unionByName(daily.withColumn("_bar", F.lit(False)), allowMissingColumns=True)
    # Later factors are those before in reverse order: a frame that only grows, instead of one added up anew for every bar.
    later = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("_bar")).rowsBetween(UNBOUNDED, 0)
    so_far = by_symbol("date", "_bar").rowsBetween(UNBOUNDED, 0)
    return (
        axis.withColumn("close_hfq", F.col("close") * F.coalesce(F.product("_h").over(later), F.lit(1.0)))
        .withColumn("total_return", F.col("close") * F.coalesce(F.product("_t").over(so_far), F.lit(1.0)))
        .where(F.col("_bar"))
        .drop("_bar", "_h", "_t")
    )


# --- resampling and calendars -----------------------------------------------------------------


def resample_aggregates(columns: Sequence[str], day: str = "date") -> list[Column]:
    """How each bar column folds into a longer bar."""
    rules = {
        "open": lambda c: F.min_by(c, day),
        "high": F.max,
        "low": F.min,
        "volume": F.sum,
        "amount": F.sum,
        "turnover": F.avg,
        **{c: F.bool_or for c in ("is_suspended", "is_st", "hit_limit_up", "hit_limit_down")},
    }
    last = {"close", "close_hfq", "total_return", "limit_up", "limit_down"}
    return [
        (F.max_by(c, day) if c in last else rules[c](c)).alias(c) for c in columns if c in rules or c in last
    ]


def resample_ohlcv(bars: DataFrame, freq: str, fill_empty: bool = False) -> DataFrame:
    """Daily bars to W (Friday) / M / Q bars labelled by period end; `fill_empty` adds the empty periods."""
    if freq == "D":
        return bars
    out = bars.groupBy("symbol", period_end(F.col("date"), freq).alias("period")).agg(
        *resample_aggregates(bars.columns)
    )
    if fill_empty:
        step = {"W": "interval 7 days", "Q": "interval 3 months"}.get(freq, "interval 1 month")
        spans = out.groupBy("symbol").agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
        days = F.explode(F.sequence(F.col("_a"), F.col("_b"), F.expr(step)))
        spine = spans.select("symbol", period_end(days, freq).alias("period")) if freq == "W" else spans.select(
            "symbol", F.explode(F.sequence(F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr(step))).alias("_m")
        ).select("symbol", F.last_day("_m").alias("period"))
        out = spine.join(out, ["symbol", "period"], "left")
    return out.withColumnRenamed("period", "date")


def merge_calendars(*calendars: DataFrame) -> DataFrame:
    days = [c.where("is_trading_day").select("date") for c in calendars]
    out = days[0]
    for d in days[1:]:
        out = out.union(d)
    return out.distinct()


def period_end_trading_days(days: DataFrame, freq: str) -> DataFrame:
    """Last trading day of each period."""
    return days.groupBy(period_end(F.col("date"), freq).alias("period")).agg(F.max("date").alias("date"))


def calendar_index(calendar: DataFrame) -> DataFrame:
    """Trading days of each exchange numbered in order; calendar sized."""
    w = Window.partitionBy("exchange").orderBy("date")
    return calendar.where("is_trading_day").select(
        "exchange", "date", F.row_number().over(w).alias("idx")
    )


def nth_trading_day_after(df: DataFrame, calendar: DataFrame, day: str, n: Column, out: str) -> DataFrame:
    """The n-th trading day of the row's exchange after `day`, clamped to the last one; else `day` itself.

    The rank of `day` among trading days comes from an as-of join, the target day from an equi-join.
    """
    idx = calendar_index(calendar)
    last = idx.groupBy("exchange").agg(F.max("idx").alias("_last"), F.min("idx").alias("_one"))
    seen = idx.select("exchange", F.col("date").alias("_seen"), F.col("idx").alias("_at"))
    placed = asof_join(df, seen, ["exchange"], day, "_seen").join(F.broadcast(last), "exchange", "left")
    target = F.least(F.coalesce(F.col("_at"), F.lit(0)) + n, F.col("_last"))
    targets = idx.select("exchange", F.col("idx").alias("_target"), F.col("date").alias("_found"))
    return (
        placed.withColumn("_target", F.when(n == 0, F.lit(None)).otherwise(target))
        .join(targets, ["exchange", "_target"], "left")
        .withColumn(out, F.greatest(F.coalesce(F.col("_found"), F.col(day)), F.col(day)))
        .drop("_seen", "_at", "_last", "_one", "_target", "_found")
    )


def settlement_days(exchange: Column, override: int | None = None) -> Column:
    """Mainland shares unlock after one trading day, Hong Kong after two."""
    if override is not None:
        return F.lit(override)
    return F.when(exchange == "HK", 2).otherwise(1)


def settlement_lock(trades: DataFrame, calendar: DataFrame, override: int | None = None) -> DataFrame:
    n = settlement_days(F.col("exchange"), override)
    return nth_trading_day_after(trades, calendar, "exec_date", n, "locked_until")


def date_spine(spans: DataFrame, start: str, end: str, freq: str = "B", out: str = "date") -> DataFrame:
    """Dates between two columns of each row: business days (B), Fridays (W-FRI) or month ends (M)."""
    if freq == "M":
        months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
        spine = spans.withColumn(out, F.explode(F.transform(months, F.last_day)))
        return spine.where((F.col(out) >= F.col(start)) & (F.col(out) <= F.col(end)))
    days = F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))
    keep = (lambda d: F.weekday(d) == 4) if freq == "W-FRI" else (lambda d: F.weekday(d) < 5)
    return spans.withColumn(out, F.explode(F.filter(days, keep)))


def max_null_run(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Length of the longest run of NULLs per key: inside a run, row number minus null number is constant."""
    w = Window.partitionBy(*keys).orderBy("date")
    numbered = df.withColumn("_rn", F.row_number().over(w)).where(F.col(value).isNull())
    runs = numbered.withColumn("_run", F.col("_rn") - F.row_number().over(w)).groupBy(*keys, "_run").count()
    longest = runs.groupBy(*keys).agg(F.max("count").alias("max_null_run"))
    return df.select(*keys).distinct().join(longest, list(keys), "left").fillna(0, ["max_null_run"])


def benchmark_curve(curve: DataFrame, days: DataFrame, keys: Sequence[str], limit: int = 3) -> DataFrame:
    """Curve scaled to its first value on the trading days: forward filled over at most `limit` rows, then
    backward, then 1. `days` has (keys, date)."""
    base = curve.groupBy(*keys).agg(F.min_by("nav", "date").alias("_base"))
    scaled = curve.join(base, list(keys)).select(*keys, "date", (F.col("nav") / F.col("_base")).alias("_v"))
    aligned = days.join(scaled, [*keys, "date"], "left")
    w = Window.partitionBy(*keys).orderBy("date")
    aligned = aligned.withColumn("_f", F.last("_v", ignorenulls=True).over(w.rowsBetween(-limit, 0)))
    back = F.first("_f", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return aligned.withColumn("benchmark", F.coalesce(back, F.lit(1.0))).drop("_f").withColumnRenamed("_v", "raw")
