"""Point-in-time reads: bitemporal facts, memberships, currency conversion and latest versions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month_index
from tidemark.operators.joins import asof_join, first_by, interval_join, latest_by


class LeakageError(ValueError):
    """A read asks for knowledge from after its own end."""


def check_date_range(start: date, end: date, asof: date | None = None) -> None:
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    if asof is not None and asof > end:
        raise LeakageError(f"as-of {asof} is after end {end}")


def kind_rank(kind: Column) -> Column:
    """A restatement beats an audited statement beats a preliminary one."""
    return F.when(kind == "restated", 3).when(kind == "audited", 2).when(kind == "preliminary", 1).otherwise(0)


def visible_from(df: DataFrame) -> Column:
    return F.greatest("publication_date", "known_as_of")


def version_order(df: DataFrame) -> list[Column]:
    tie = [F.col("fact_id")] if "fact_id" in df.columns else []
    return [F.col("known_as_of"), kind_rank(F.col("statement_kind")), *tie]


def fundamentals_asof(facts: DataFrame, asof: date | Column) -> DataFrame:
    """Per (symbol, report_date) the version known at `asof`: a filtered partial aggregate, no sort."""
    at = F.lit(asof)
    known = facts.where((F.col("publication_date") <= at) & (F.col("known_as_of") <= at))
    return latest_by(known, ["symbol", "report_date"], version_order(facts)).select(*facts.columns)


def version_ranges(facts: DataFrame) -> DataFrame:
    """Each version with the days `[valid_from, valid_to)` on which it is the known one.

    A version holds from the day it is visible until the first visible version that outranks it, so a
    read at any number of dates is an interval join instead of one sort per date. The window is over
    the versions of one report of one symbol.
    """
    w = Window.partitionBy("symbol", "report_date").orderBy(*version_order(facts))
    stamped = facts.withColumn("valid_from", visible_from(facts))
    stamped = stamped.withColumn(
        "valid_to", F.min("valid_from").over(w.rowsBetween(1, Window.unboundedFollowing))
    )
    return stamped.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def month_ends_between(start: Column, end: Column) -> Column:
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda d: (d >= start) & (d <= end))


def fundamentals_asof_month_ends(facts: DataFrame, start: date, end: date) -> DataFrame:
    """Known versions at every month end of a span: each version lists its own month ends, no join at all."""
    ranges = version_ranges(facts)
    lo = F.greatest(F.col("valid_from"), F.lit(start))
    hi = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(end)), F.lit(end))
    return (
        ranges.where(lo <= hi)
        .withColumn("asof", F.explode(month_ends_between(lo, hi)))
        .drop("valid_from", "valid_to")
    )


def fundamentals_asof_many(facts: DataFrame, spine: DataFrame) -> DataFrame:
    """Known versions at arbitrary dates: `spine` has (asof)."""
    return interval_join(
        spine, version_ranges(facts), [], "asof", "valid_from", "valid_to"
    ).drop("valid_from", "valid_to")


def latest_non_null(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Last non-null value of each column on its own, as a partial aggregate."""
    best = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns
    ]
    return df.groupBy(*keys).agg(*best)


def pit_constituents(members: DataFrame, asof: date) -> DataFrame:
    at = F.lit(asof)
    return members.where(
        (F.col("effective_from") <= at) & (F.col("effective_to").isNull() | (F.col("effective_to") > at))
    )


def universe_over_time(members: DataFrame, start: date, end: date) -> DataFrame:
    """Members at every month end of a span: each interval lists the month ends it covers."""
    lo = F.greatest(F.col("effective_from"), F.lit(start))
    hi = F.least(F.coalesce(F.date_sub("effective_to", 1), F.lit(end)), F.lit(end))
    return members.where(lo <= hi).withColumn("date", F.explode(month_ends_between(lo, hi)))


def members_per_month(members: DataFrame, start: date, end: date, by: Sequence[str] = ("index_name", "symbol")) -> DataFrame:
    """`date, *by, n`: how many intervals of each group hold each month end of a span; month ends that none holds have no row.

    An interval is a range of months, and a group counts a whole year in one row of twelve counters: an interval is copied per year, not
    per month end, and what a task holds are groups and years instead of every group's month ends.
    """
    lo = F.greatest(F.col("effective_from"), F.lit(start))
    hi = F.least(F.coalesce(F.date_sub("effective_to", 1), F.lit(end)), F.lit(end))
    unfinished = F.when(hi < F.last_day(hi), 1).otherwise(0)  # its last month ends behind it
    held = members.where(F.col("effective_from").isNotNull() & (lo <= hi))
    spans = held.select(*by, month_index(lo).alias("_first"), (month_index(hi) - unfinished).alias("_last")).where("_first <= _last")
    years = spans.withColumn("_year", F.explode(F.sequence(F.floor(F.col("_first") / 12), F.floor(F.col("_last") / 12))))
    inside = [(F.col("_year") * 12 + m).between(F.col("_first"), F.col("_last")) for m in range(12)]
    counts = years.groupBy(*by, "_year").agg(*[F.count(F.when(known, 1)).alias(f"_n{m}") for m, known in enumerate(inside)])
    months = [F.struct(F.last_day(F.make_date(F.col("_year").cast("int"), F.lit(m + 1), F.lit(1))).alias("date"), F.col(f"_n{m}").alias("n")) for m in range(12)]
    return counts.select(*by, F.inline(F.array(*months))).where("n > 0").select("date", *by, "n")


def membership_history(snapshots: DataFrame) -> DataFrame:
    """Validity intervals from dated snapshots: a member stays until the first snapshot without it.

    `snapshots` has (index_name, date, symbol). Snapshot dates are numbered per index, and consecutive
    numbers of one member form a run.
    """
    dates = snapshots.select("index_name", "date").distinct()
    w = Window.partitionBy("index_name").orderBy("date")
    numbered = dates.withColumn("_i", F.row_number().over(w)).withColumn("_next", F.lead("date").over(w))
    member = Window.partitionBy("index_name", "symbol").orderBy("date")
    runs = (
        snapshots.select("index_name", "symbol", "date").distinct()
        .join(numbered, ["index_name", "date"])
        .withColumn("_run", F.col("_i") - F.row_number().over(member))
    )
    return runs.groupBy("index_name", "symbol", "_run").agg(
        F.min("date").alias("effective_from"),
        F.max_by(F.struct("_next"), "date").alias("_end"),
    ).select("index_name", "symbol", "effective_from", F.col("_end._next").alias("effective_to"))


def equal_weight_snapshot(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("index_name").agg(F.count(F.lit(1)).alias("_n"))
    return members.join(sizes, "index_name").withColumn("weight", 1 / F.col("_n")).drop("_n")


def pair_closes(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """Both legs of every pair on their common dates."""
    legs = pairs.where(F.col("h").isNotNull()).select(F.col("a").alias("symbol_a"), F.col("h").alias("symbol_h"))
    a = bars.select("date", F.col("symbol").alias("symbol_a"), F.col("close").alias("close_a"))
    h = bars.select("date", F.col("symbol").alias("symbol_h"), F.col("close").alias("close_h"))
    return legs.join(a, "symbol_a").join(h, ["symbol_h", "date"]).select(
        "date", "symbol_a", "symbol_h", "close_a", "close_h"
    )


def ah_premium(pairs: DataFrame, bars: DataFrame, fx: DataFrame) -> DataFrame:
    """Premium of the mainland leg over the converted Hong Kong leg, all pairs at once.

    `cny_per_hkd` always multiplies the Hong Kong price.
    """
    rates = fx.select(F.col("date").alias("fx_date"), "cny_per_hkd")
    legs = asof_join(pair_closes(pairs, bars), rates, [], "date", "fx_date", how="inner", horizon=bars.agg(F.max("date")).scalar())
    return legs.withColumn("premium", F.col("close_a") / (F.col("close_h") * F.col("cny_per_hkd")) - 1)


def uncovered_requests(requests: DataFrame, fetches: DataFrame) -> DataFrame:
    """Requests (symbol, start, end) that no single logged fetch contains.

    Some fetch contains a request exactly when the furthest end among fetches starting no later reaches
    it, so the test is an as-of lookup of a running maximum instead of a pairwise comparison.
    """
    starts = fetches.groupBy("symbol", F.col("fetched_start").alias("_from")).agg(F.max("fetched_end").alias("_to"))
    w = Window.partitionBy("symbol").orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
    reach = starts.withColumn("_reach", F.max("_to").over(w)).drop("_to")
    looked_up = asof_join(requests, reach, ["symbol"], "start", "_from")
    covered = F.coalesce(F.col("_reach") >= F.col("end"), F.lit(False))
    return looked_up.where(~covered).drop("_reach", "_from")


def latest_document(filings: DataFrame, kind: str, order: Column) -> DataFrame:
    rows = filings.where(F.col("kind") == kind).drop("text")
    return latest_by(rows, ["symbol"], [order, F.col("path")])


__all__ = [
    "LeakageError", "ah_premium", "asof_join", "check_date_range", "equal_weight_snapshot", "first_by",
    "fundamentals_asof", "fundamentals_asof_many", "fundamentals_asof_month_ends", "latest_document",
    "latest_non_null", "members_per_month", "membership_history", "month_index", "pair_closes", "pit_constituents",
    "uncovered_requests", "universe_over_time", "version_ranges",
]
