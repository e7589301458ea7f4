"""Calendar expressions on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    """Months since year 0, the bucket key of every time-bucketed join."""
    return F.year(day) * 12 + F.month(day) - 1


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def week_end_friday(day: Column) -> Column:
    """Friday closing the Saturday-to-Friday week of `day`."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def period_end(day: Column, freq: str) -> Column:
    """End label of the day / week (Friday) / month / quarter holding `day`; unknown codes mean month."""
    if freq == "D":
        return day
    if freq in ("W", "W-FRI"):
        return week_end_friday(day)
    if freq == "Q":
        return quarter_end(day)
    return F.last_day(day)


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)
