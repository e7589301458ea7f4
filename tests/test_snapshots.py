"""Versions of a table under readers, failures and two writers; late rows and restatements."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import snapshots as sn
from tidemark.sources.watchlists import write_watchlist
from tidemark.streaming import incremental as inc

SCHEMA = "k int, year int, v int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def held(df):
    return sorted((r.k, r.year, r.v) for r in df.collect())


def test_a_reader_keeps_its_version(spark, tmp_path):
    root = f"{tmp_path}/t"
    with pytest.raises(ValueError, match="no version"):
        sn.read(spark, root)
    assert sn.upsert(spark, root, rows(spark), ["k"], "year") is None
    assert sn.upsert(spark, root, rows(spark, (1, 2020, 1), (2, 2021, 2)), ["k"], "year") == 1
    before = sn.read(spark, root)
    assert sn.upsert(spark, root, rows(spark, (1, 2020, 9), (3, 2020, 3)), ["k"], "year") == 2
    assert held(before) == [(1, 2020, 1), (2, 2021, 2)] == held(sn.read(spark, root, 1))
    assert held(sn.read(spark, root)) == [(1, 2020, 9), (2, 2021, 2), (3, 2020, 3)]
    assert held(sn.read(spark, root, partitions=["2021"])) == [(2, 2021, 2)] and held(sn.read(spark, root, partitions=["1999"])) == []
    one, two = (sn._load(spark, root, n).folders for n in sn._manifests(spark, root))
    assert one["2021"] == two["2021"] and one["2020"] != two["2020"]
    assert sn.upsert(spark, root, rows(spark), ["k"], "year") == 2
    assert sn.expire(spark, root, keep=1) == 1 and held(sn.read(spark, root)) == [(1, 2020, 9), (2, 2021, 2), (3, 2020, 3)]
    assert len(list((tmp_path / "t" / "data").glob("*/_part=*"))) == 2


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = f"{tmp_path}/t"
    sn.upsert(spark, root, rows(spark, (1, 2020, 1)), ["k"], "year")
    broken = lambda old, new: new.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sn.merge(spark, root, rows(spark, (1, 2020, 2)), "year", broken)
    assert held(sn.read(spark, root)) == [(1, 2020, 1)] and len(list((tmp_path / "t" / "data").iterdir())) == 1
    with pytest.raises(ValueError, match="folder"):
        sn.upsert(spark, root, rows(spark, (1, None, 2)), ["k"], "year")
    with pytest.raises(ValueError, match="columns"):
        sn.upsert(spark, root, rows(spark, (1, 2020, 2)).drop("v"), ["k"], "year")


def test_two_writers_both_count(spark, tmp_path):
    root = f"{tmp_path}/t"
    sn.upsert(spark, root, rows(spark, (1, 2020, 1)), ["k"], "year")
    other = []

    def combine(old, new):
        if not other:  # another writer commits between this one's reading and its manifest
            other.append(sn.upsert(spark, root, rows(spark, (2, 2020, 2)), ["k"], "year"))
        return sn.upsert_by_key(old, new, ["k"])

    assert sn.merge(spark, root, rows(spark, (3, 2020, 3)), "year", combine) == 3 and other == [2]
    assert held(sn.read(spark, root)) == [(1, 2020, 1), (2, 2020, 2), (3, 2020, 3)]
    assert len(sn._manifests(spark, root)) == 3 and len(list((tmp_path / "t" / "data").iterdir())) == 3


def test_a_replayed_batch_counts_once(spark, tmp_path):
    root = f"{tmp_path}/t"
    for epoch in (0, 1, 1, 0):
        sn.merge(spark, root, rows(spark, (1, 2020, epoch)), "year", None, "w", epoch)
    assert held(sn.read(spark, root)) == [(1, 2020, 0), (1, 2020, 1)]


def test_late_rows_and_restatements(spark, tmp_path):
    schema = "ts timestamp, symbol string, seq bigint, price double, shares int, known_as_of date"
    at = lambda d, h=0: datetime(2020, 1, d, h)
    known = date(2020, 2, 1)
    deliveries = [
        [(at(1, 9), "A", 1, 10.0, 1, None), (at(1, 15), "A", 2, 12.0, 1, None), (at(9), "A", 3, 11.0, 1, None), (None, "A", 4, 1.0, 1, None)],
        [(at(1, 8), "A", 5, 7.0, 1, None), (at(1, 16), "A", 6, 20.0, 2, known), (at(8), "A", 7, 5.0, 1, None), (at(1, 7), None, 8, 1.0, 1, known)],
        [],
    ]
    inbox, table, late, state = (f"{tmp_path}/{x}" for x in ("inbox", "table", "late", "state"))
    for delivery in deliveries:
        spark.createDataFrame(delivery, schema).coalesce(1).write.mode("append").parquet(inbox)
        ticks = inc.read_files(spark, inbox, spark.createDataFrame([], schema).schema)
        inc.stream_parts(ticks, table, late, state, timedelta(days=2)).awaitTermination()
    bars = lambda asof=None: sorted((str(r.symbol), r.date.day, r.open, r.high, r.low, r.close, r.volume) for r in inc.bars_known(sn.read(spark, table), asof).collect())
    assert bars(date(2020, 1, 31)) == [("A", 1, 10.0, 12.0, 10.0, 12.0, 2), ("A", 8, 5.0, 5.0, 5.0, 5.0, 1), ("A", 9, 11.0, 11.0, 11.0, 11.0, 1)]
    assert bars()[0] == ("A", 1, 10.0, 20.0, 10.0, 20.0, 4) and bars()[-1] == ("None", 1, 1.0, 1.0, 1.0, 1.0, 1)
    missed = sn.read(spark, late)
    assert sorted((r.seq, r.watermark is None) for r in missed.collect()) == [(4, True), (5, False)]
    assert sorted((str(r.date), r.n_late) for r in inc.late_counts(missed).collect()) == [("2020-01-01", 1), ("None", 1)]


def test_a_stored_watchlist_is_replaced_only_by_force(spark, tmp_path):
    root, schema = f"{tmp_path}/w", "watchlist_name string, snapshot_date date, symbol string, price double"
    day = lambda d: date(2020, 1, d)
    make = lambda *r: spark.createDataFrame(list(r), schema)
    assert write_watchlist(spark, root, make(("a", day(1), "X", 1.0), ("a", day(1), "Y", 2.0))) == 1
    assert write_watchlist(spark, root, make(("b", day(1), "X", 1.0), ("a", day(2), "X", 1.5))) == 2
    with pytest.raises(ValueError, match="a of 2020-01-01"):
        write_watchlist(spark, root, make(("a", day(1), "X", 9.0), ("c", day(1), "X", 1.0)))
    assert sn.read(spark, root).count() == 4
    write_watchlist(spark, root, make(("a", day(1), "X", 9.0)), force=True)
    got = sorted((r.watchlist_name, r.snapshot_date.day, r.symbol, r.price) for r in sn.read(spark, root).collect())
    assert got == [("a", 1, "X", 9.0), ("a", 2, "X", 1.5), ("b", 1, "X", 1.0)]
