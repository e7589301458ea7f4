"""The seven declared sources: requests, columns, checks, and filters that reach the files."""

from datetime import date as D

import pytest

from tidemark.sources import declared as dl

PRICES = "date date, symbol string, open double, high double, low double, close double, volume bigint, amount double, extra int"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_source_is_declared():
    assert set(dl.SOURCES) == set(dl.KEYS)
    assert all(set(d.contract.keys) <= set(d.contract.schema.names) for d in dl.SOURCES.values())


def test_requests_reach_the_files_and_dates_are_inclusive(spark, tmp_path):
    rows = [(D(2020, 1, d), s, 1.0, 1.0, 1.0, 1.0, 5, 5.0, 0) for d in (1, 2, 3) for s in ("600000.SH", "000001.SZ")]
    spark.createDataFrame(rows, PRICES).write.parquet(f"{tmp_path}/p")
    fetch = dl.source("prices")(lambda spark, place: spark.read.parquet(f"{place}/p"))
    got = fetch(spark, str(tmp_path), start=D(2020, 1, 2), end=D(2020, 1, 3), symbols=["600000.SH"])
    assert got.columns == dl.SOURCES["prices"].contract.schema.names and sorted(r.date.day for r in got.collect()) == [2, 3]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = _plan(fetch(spark, str(tmp_path), start=D(2020, 1, 2), end=D(2020, 1, 3), symbols=["600000.SH"]))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(date,2020-01-02)" in plan and "EqualTo(symbol,600000.SH)" in plan and "extra" not in plan


@pytest.mark.parametrize("name,asked", [("prices", {}), ("fx", {"start": D(2020, 1, 1), "end": D(2020, 1, 2)}), ("sectors", {"asof": D(2020, 1, 1)}), ("constituents", {"of": "N"}), ("calendar", {"start": D(2020, 1, 1), "end": D(2020, 1, 2), "of": "HK", "symbols": ["A"]})])
def test_a_request_must_fit(spark, name, asked):
    with pytest.raises(ValueError, match="does not fit"):
        dl.request(spark.createDataFrame([], dl.SOURCES[name].contract.schema), dl.SOURCES[name], **asked)


def test_missing_columns_and_other_types(spark):
    with pytest.raises(ValueError, match="sector_l2"):
        dl.conform(spark.createDataFrame([("600000.SH", "a")], "symbol string, sector_l1 string"), dl.SOURCES["sectors"].contract)
    raw = spark.createDataFrame([("2020-01-01", "CNY_HKD", "0.9"), ("soon", "CNY_HKD", "x"), ("2020-01-01", "CNY_HKD", "0.8")], "date string, pair string, cny_per_hkd string")
    rows = dl.conform(raw, dl.SOURCES["fx"].contract)
    assert {(r.rule, r.n) for r in dl.audit("fx", rows).collect()} == {("rows", 3), ("null:date", 1), ("null:cny_per_hkd", 1), ("duplicate:key", 2)}


def test_members_in_force(spark):
    rows = [("N", "600000.SH", D(2020, 1, 1), D(2020, 2, 1)), ("N", "600001.SH", D(2020, 2, 1), None), ("N", "600002.SH", D(2020, 2, 2), None), ("M", "600003.SH", D(2019, 1, 1), None)]
    table = spark.createDataFrame(rows, dl.SOURCES["constituents"].contract.schema)
    assert [r.symbol for r in dl.request(table, dl.SOURCES["constituents"], of="N", asof=D(2020, 2, 1)).collect()] == ["600001.SH"]
    assert dl.request(table.limit(0), dl.SOURCES["constituents"], of="N", asof=D(2020, 2, 1)).count() == 0
