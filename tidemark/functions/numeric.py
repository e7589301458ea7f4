"""Numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(value: Column) -> Column:
    """NaN and NULL are one thing here: not known."""
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def log_ratio(end: Column, start: Column) -> Column:
    return F.when((end > 0) & (start > 0), F.log(end / start))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for reports, with negative zero folded into zero."""
    out = F.round(value, digits)
    return F.when(out == 0, F.lit(0.0)).otherwise(out)


def settled_round(value: Column, digits: int = 6) -> Column:
    """Rounded half up after noise of float sums, far below the last digit kept, is cut away: exact halves round alike in any order."""
    return F.round(value.cast(f"decimal(28,{digits + 2})"), digits).cast("double")
