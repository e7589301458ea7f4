"""Strategies as callables on tables: signals first, then weights; user estimators plug in the same way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import factor, weights
from tidemark.operators.pit import universe_over_time
from tidemark.sources.contracts import SIGNALS, WEIGHTS, missing_columns

Tables = dict[str, DataFrame]
# Estimators work on long frames: returns (date, symbol, ret) to (i, j, cov) or to (symbol, mu).
CovarianceEstimator = Callable[[DataFrame], DataFrame]
ReturnsEstimator = Callable[[DataFrame, date], DataFrame]


@runtime_checkable
class SignalStrategy(Protocol):
    def generate(self, tables: Tables, start: date, end: date) -> DataFrame: ...

    def to_weights(self, signals: DataFrame, tables: Tables) -> DataFrame: ...


@runtime_checkable
class WeightStrategy(Protocol):
    def generate(self, tables: Tables, start: date, end: date) -> DataFrame: ...


@dataclass(frozen=True)
class InlineSignals:
    """A frame (date, symbol, signal) used as a strategy; equal weights over its rows of a date."""

    frame: DataFrame

    def generate(self, tables: Tables, start: date, end: date) -> DataFrame:
        return self.frame.where(F.col("date").between(F.lit(start), F.lit(end)))

    def to_weights(self, signals: DataFrame, tables: Tables) -> DataFrame:
        return weights.weight_equal(signals).select("date", "symbol", "weight")


@dataclass(frozen=True)
class ValueStrategy:
    index_name: str
    quantile: float = 0.2
    max_weight: float = 0.05
    sector_neutral: bool = False

    def generate(self, tables: Tables, start: date, end: date) -> DataFrame:
        members = tables["constituents"].where(F.col("index_name") == self.index_name)
        return factor.value_signal(tables["fundamentals"], universe_over_time(members, start, end), start, end)

    def to_weights(self, signals: DataFrame, tables: Tables) -> DataFrame:
        sectors = tables["sectors"] if self.sector_neutral else None
        return weights.signal_to_weights(signals, self.quantile, self.max_weight, sectors)


@dataclass(frozen=True)
class DividendYieldStrategy:
    quantile: float = 0.2
    max_weight: float = 0.05

    def generate(self, tables: Tables, start: date, end: date) -> DataFrame:
        return factor.dividend_yield_signal(tables["fundamentals"], tables["corporate_actions"], start, end)

    def to_weights(self, signals: DataFrame, tables: Tables) -> DataFrame:
        return weights.signal_to_weights(signals, self.quantile, self.max_weight)


@dataclass(frozen=True)
class PremiumReversion:
    """The pairs trade on the dual-listing premium; it states weights directly."""

    entry: float = 2.0
    exit: float = 0.5
    leg: float = 0.1
    max_gross: float = 1.0
    rows: int = 60

    def generate(self, tables: Tables, start: date, end: date) -> DataFrame:
        from tidemark.operators.pit import ah_premium

        premium = ah_premium(tables["pairs"], tables["prices"], tables["fx"])
        z = factor.premium_zscore_signal(premium, self.rows).where(F.col("friday").between(F.lit(start), F.lit(end)))
        return factor.pair_state(z, self.entry, self.exit, self.leg, self.max_gross)


def resolve_weights(strategy: object, tables: Tables, start: date, end: date) -> DataFrame:
    """Weights of a frame, a signal strategy, a weight strategy, or a plain callable, tried in that order."""
    if isinstance(strategy, DataFrame):
        if not missing_columns(strategy, WEIGHTS.schema.names):
            return strategy.where(F.col("date").between(F.lit(start), F.lit(end)))
        lacking = missing_columns(strategy, SIGNALS.schema.names)
        if lacking:
            raise TypeError(f"a frame strategy needs signals or weights; it lacks {lacking}")
        strategy = InlineSignals(strategy)
    if isinstance(strategy, SignalStrategy):
        return strategy.to_weights(strategy.generate(tables, start, end), tables)
    if isinstance(strategy, WeightStrategy):
        return strategy.generate(tables, start, end)
    if callable(strategy):
        return strategy(tables, start, end)
    raise TypeError(f"{type(strategy).__name__} is not a strategy")
