"""The seven sources as declarations: what each returns, how it is asked, and a check of what came back.

A reader `(spark, place) -> DataFrame` only names its rows. Its declaration gives it the shape that every source shares: inclusive
dates, canonical symbols, one pair, venue or index where the source is asked for one, and exactly the declared columns. The request
is a filter over the scan, so dates and short symbol lists reach the files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.symbols import SYMBOL_PATTERN
from tidemark.operators.pit import pit_constituents
from tidemark.sources import contracts as ct
from tidemark.sources.readers import KEYS, scan

_KINDS = ("cash_dividend", "stock_dividend", "rights_issue", "split", "reverse_split", "delisting")


@dataclass(frozen=True)
class Declared:
    contract: ct.Contract
    day: str | None = None  # bounded by the inclusive dates of a request
    symbols: bool = True  # asked for symbols
    of: str | None = None  # asked for one value of this column
    as_of: bool = False  # asked for the rows in force at a date


def _declare(name: str, ddl: str, required: Sequence[str] = (), allowed: dict[str, tuple[str, ...]] | None = None, **asked) -> Declared:
    schema = ct.schema_of(ddl)
    patterns = {"symbol": SYMBOL_PATTERN} if "symbol" in schema.names else {}
    counts = tuple(c for c in ("volume", "amount") if c in schema.names)
    return Declared(ct.Contract(schema, KEYS[name], (*KEYS[name], *required), allowed or {}, patterns, counts), **asked)


# Columns and allowed values of what each source returns.
SOURCES = {
    "prices": _declare("prices", "date date, symbol string, open double, high double, low double, close double, volume bigint, amount double", day="date"),
    "fundamentals": _declare(
        "fundamentals", "symbol string, report_date date, publication_date date, known_as_of date, statement_kind string, revenue double, "
        "net_income double, roe double, pe double, pb double, dividend_yield double, market_cap double",
        ["publication_date"], {"statement_kind": ("preliminary", "audited", "restated")}, day="report_date"),
    "fx": _declare("fx", "date date, pair string, cny_per_hkd double", ["cny_per_hkd"], {"pair": ("CNY_HKD",)}, day="date", symbols=False, of="pair"),
    "calendar": _declare("calendar", "exchange string, date date, is_trading_day boolean", ["is_trading_day"], {"exchange": ("SH", "SZ", "HK")}, day="date", symbols=False, of="exchange"),
    "sectors": _declare("sectors", "symbol string, sector_l1 string, sector_l2 string", ["sector_l1"]),
    "corporate_actions": _declare("corporate_actions", "symbol string, ex_date date, kind string, params_json string", ["params_json"], {"kind": _KINDS}, day="ex_date"),
    "constituents": _declare("constituents", "index_name string, symbol string, effective_from date, effective_to date", symbols=False, of="index_name", as_of=True),
}

Reader = Callable[[SparkSession, str], DataFrame]


def source(name: str) -> Callable[[Reader], Callable[..., DataFrame]]:
    """Declare a reader to be source `name`: what it gives is brought to the declared columns and asked by `request`."""
    declared = SOURCES[name]

    def wrap(reader: Reader) -> Callable[..., DataFrame]:
        def fetch(spark: SparkSession, place: str, **asked) -> DataFrame:
            return request(reader(spark, place), declared, **asked)

        fetch.declared = declared
        return fetch

    return wrap


def conform(rows: DataFrame, contract: ct.Contract) -> DataFrame:
    """The declared columns in their order and types; others are left out, a value that does not convert becomes null."""
    if missing := ct.missing_columns(rows, contract.schema.names):
        raise ValueError(f"the source lacks {missing}")
    cast = lambda f: F.col(f.name) if rows.schema[f.name].dataType == f.dataType else F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
    return rows.select(*[cast(f) for f in contract.schema])


def request(
    rows: DataFrame, declared: Declared, start: date | None = None, end: date | None = None,
    symbols: Sequence[str] | DataFrame | None = None, of: str | None = None, asof: date | None = None,
) -> DataFrame:
    """Rows of a source for a request; a request that the source is not asked by, or that lacks what it needs, is an error."""
    ranged = declared.day is not None
    if ((start is not None) != ranged or (end is not None) != ranged or (of is not None) != (declared.of is not None)
            or (asof is not None) != declared.as_of or (symbols is not None and not declared.symbols)):
        raise ValueError("the request does not fit what the source declares")
    out = conform(rows, declared.contract)
    if of is not None:
        out = out.where(F.col(declared.of) == of)
    if asof is not None:
        return pit_constituents(out, asof)
    if ranged:
        return scan(out, declared.day, start, end, symbols)
    if symbols is None:
        return out
    return out.join(symbols.select("symbol"), "symbol", "left_semi") if isinstance(symbols, DataFrame) else out.where(F.col("symbol").isin(list(symbols)))


def audit(name: str, rows: DataFrame) -> DataFrame:
    """(source, rule, n): the number of rows under `rows`, and every broken rule of the declaration with its count."""
    total = rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("rule"), "n")
    return total.unionByName(ct.violations(rows, SOURCES[name].contract)).select(F.lit(name).alias("source"), "rule", "n")
