"""Listing-symbol expressions: `CODE.VENUE` parsing and vendor spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Venues and their trading currency.
VENUE_CURRENCY = {"SH": "CNY", "SZ": "CNY", "HK": "HKD"}
# A listing symbol, and the narrower form signals and weights accept.
SYMBOL_PATTERN = r"^([0-9A-Za-z]+)\.(SH|SZ|HK)$"
STRICT_SYMBOL_PATTERN = r"^[0-9]{4,6}\.(SH|SZ|HK)$"


def code_of(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, SYMBOL_PATTERN, 1), F.lit(""))


def venue_of(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, SYMBOL_PATTERN, 2), F.lit(""))


def currency_of(symbol: Column) -> Column:
    venue = venue_of(symbol)
    return F.when(venue == "HK", F.lit("HKD")).when(venue.isNotNull(), F.lit("CNY"))


def is_strict_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(STRICT_SYMBOL_PATTERN), F.lit(False))


def parse_symbol(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Add code, exchange, currency and `parsed`; rows that do not parse keep NULLs so a caller can split them off."""
    symbol = F.col(column)
    return df.select(
        "*",
        code_of(symbol).alias("code"),
        venue_of(symbol).alias("exchange"),
        currency_of(symbol).alias("currency"),
        symbol.rlike(SYMBOL_PATTERN).alias("parsed"),
    )


def to_vendor_symbol(symbol: Column) -> Column:
    """`600519.SH` -> `sh.600519`."""
    return F.concat_ws(".", F.lower(venue_of(symbol)), code_of(symbol))


def from_vendor_symbol(vendor: Column) -> Column:
    """`sh.600519` -> `600519.SH`."""
    pattern = r"^(sh|sz)\.([0-9]{6})$"
    code = F.regexp_extract(vendor, pattern, 2)
    return F.when(
        vendor.rlike(pattern), F.concat_ws(".", code, F.upper(F.regexp_extract(vendor, pattern, 1)))
    )


def hk_vendor_code(symbol: Column) -> Column:
    """Hong Kong vendors want the code zero-padded to five digits."""
    code = code_of(symbol)
    return F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code)
