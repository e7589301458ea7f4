"""File names of broker reports and period ends of cover pages."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents as dc


@pytest.mark.parametrize(
    ("broker", "slug"),
    [("中信建投证券", "zhongxinjt"), (" 中国银河 ", "yinhe"), ("CLSA Ltd.", "clsaltd"), ("某券商", "unknown"), ("", "unknown"), (None, "unknown")],
)
def test_broker_slug(spark, broker, slug):
    rows = spark.createDataFrame([(broker,)], "broker string")
    assert rows.select(dc.broker_slug(F.col("broker"))).first()[0] == slug


def test_own_broker_table(spark):
    rows = spark.createDataFrame([("某券商",), ("海通证券",)], "broker string")
    assert [r[0] for r in rows.select(dc.broker_slug(F.col("broker"), {"某券商": "mou"})).collect()] == ["mou", "unknown"]
    assert [r[0] for r in rows.select(dc.broker_slug(F.col("broker"), {})).collect()] == ["unknown", "unknown"]


def test_report_filename(spark):
    rows = spark.createDataFrame([("海通证券", " 深度: a/b  c ", date(2024, 3, 1)), (None, "??", date(2024, 3, 2))], "b string, t string, d date")
    got = [r[0] for r in rows.select(dc.report_filename(F.col("b"), F.col("t"), F.col("d"))).collect()]
    assert got == ["haitong-深度-a-b-c-20240301.md", "unknown-untitled-20240302.md"]


@pytest.mark.parametrize(
    ("cover", "statement", "end"),
    [
        ("For the year ended 31 December 2019", "for the year ended 31 DECEMBER 2019", date(2019, 12, 31)),
        ("Year ended March 31, 2021", "for the year ended March 31 2021", date(2021, 3, 31)),
        ("截至 2022 年 6 月 30 日止年度", "截至2022年6月30日", date(2022, 6, 30)),
        ("for the years ended December 31, 2022 and 2023", "Years ended December 31,\n2022 2023", date(2023, 12, 31)),
        ("2020 Annual Report", "As of December 31,\n2019 2020\nYear ended June 30, 2018", date(2020, 12, 31)),
        ("Year ended 31 December 2019", "Year ended 31 December 2018", None),
        ("Year ended 31 December 2019\nYear ended 30 June 2019", "Year ended 31 December 2019\nYear ended 30 June 2019", None),
        ("Year ended 31 December 2019", "forecast for the year ended 31 December 2019", None),
        ("Year ended 31 February 2019", "Year ended 31 February 2019", None),
    ],
)
def test_period_end_forms(spark, cover, statement, end):
    text = cover + "\n\f" * 12 + "Consolidated Financial Statements\n" + statement
    assert dc.report_period_end(spark.createDataFrame([(text,)], "text string")).first().period_end == end


def test_period_end_without_text(spark):
    rows = spark.createDataFrame([(None,), ("",), ("Year ended 31 December 2019",)], "text string")
    assert [r.period_end for r in dc.report_period_end(rows).collect()] == [None, None, None]
