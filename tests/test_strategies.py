"""End-to-end strategies on the synthetic market."""

from datetime import date as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators.strategies import DividendYieldStrategy, ValueStrategy, resolve_weights
from tidemark.sources.synthetic import synthetic_market

START, END = D(2019, 1, 1), D(2021, 12, 31)


@pytest.fixture(scope="module")
def market(spark):
    return synthetic_market(spark, [f"{600000 + i}.SH" for i in range(12)], START, END)


@pytest.mark.parametrize("strategy", [ValueStrategy("IDX", 0.5, 0.3), DividendYieldStrategy(0.5, 0.3)])
def test_weights_are_capped_and_sum_to_one(market, strategy):
    rows = resolve_weights(strategy, market, D(2020, 7, 1), END).groupBy("date").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect()
    assert rows and all(abs(r.s - 1) < 1e-9 and r.m <= 0.3 + 1e-9 for r in rows)


def test_later_facts_do_not_change_earlier_weights(market):
    cut = D(2020, 12, 31)
    known = {**market, "fundamentals": market["fundamentals"].where(F.col("known_as_of") <= F.lit(cut))}
    key = lambda t: {(r.date, r.symbol): round(r.weight, 12) for r in resolve_weights(ValueStrategy("IDX", 0.5, 0.3), t, D(2020, 1, 1), cut).collect()}
    assert key(market) == key(known)


def test_frames_and_callables_are_strategies(spark, market):
    w = spark.createDataFrame([(D(2020, 1, 1), "600000.SH", 1.0)], "date date, symbol string, weight double")
    assert resolve_weights(w, market, START, END).count() == 1
    assert resolve_weights(lambda t, s, e: w, market, START, END).count() == 1
    with pytest.raises(TypeError):
        resolve_weights(3, market, START, END)
