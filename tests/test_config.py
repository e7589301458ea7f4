"""The hash of a run's settings is the same on the driver and over columns."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import metrics as mt


def test_config_hash_over_columns(spark):
    rows = [("a", date(2020, 1, 2), 100, True), ("b", None, None, False)]
    df = spark.createDataFrame(rows, "run string, start date, lots int, long_only boolean")
    got = {r.run: r.h for r in df.select("run", mt.config_hash_of({c: F.col(c) for c in df.columns}).alias("h")).collect()}
    assert got == {r[0]: mt.config_hash(dict(zip(df.columns, r, strict=True))) for r in rows}
    swapped = df.select("run", mt.config_hash_of({c: F.col(c) for c in reversed(df.columns)}).alias("h")).collect()
    assert {r.run: r.h for r in swapped} == got and len(set(got.values())) == 2
