"""Annual catalogs: Hong Kong titles, explicit targets, notices for several years."""

import json
from datetime import date as D

from pyspark.sql import functions as F

from tidemark.operators import catalog as ca

ROWS = "issuer string, announcement_id string, announced date, announced_s long, title string, venue string, explicit_target_id string"


def catalog(spark, *rows):
    """(issuer, id, title, explicit target); a later row is a later announcement."""
    return spark.createDataFrame([(i, a, D(2023, 4, 1), 1000 * n, t, "HK" if i[0] == "h" else "CN", x) for n, (i, a, t, x) in enumerate(rows)], ROWS)


def status(rows, end_year=2023, years=5):
    return {(r.issuer, r.announcement_id): r.status for r in ca.annual_catalog_select(rows, D(2023, 12, 31), end_year, years).collect()}


def test_hong_kong_titles_have_rules_of_their_own(spark):
    rows = catalog(
        spark,
        ("h1", "1", "ANNUAL REPORT 2021", None), ("h1", "2", "Annual Report 2021/22", None), ("h1", "3", "REVISED ANNUAL REPORT 2021", None), ("h1", "4", "2022 INTERIM REPORT", None),
        ("h1", "5", "SUPPLEMENT TO ANNUAL REPORT 2022", None), ("h1", "6", "Annual Report 2024", None), ("h1", "7", "CANCELLATION OF SHARE OPTIONS", None), ("h1", "8", "Annual Report", None),
        ("h2", "1", "ANNUAL REPORT 2022", None), ("h2", "2", "REVISED ANNUAL REPORT 2022", None), ("h2", "3", "CANCELLATION OF ANNUAL REPORT 2022", None),
        ("h3", "1", "2022 年報", None), ("h3", "2", "CORRECTION ANNOUNCEMENT TO ANNUAL REPORT 2022", None),
        ("h4", "100", "REVISED ANNUAL REPORT 2022", None), ("h4", "102", "CORRECTION ANNOUNCEMENT TO ANNUAL REPORT 2022", None), ("h4", "103", "CORRECTION ANNOUNCEMENT TO ANNUAL REPORT", None),
    )
    assert status(rows) == {
        ("h1", "1"): "superseded", ("h1", "2"): "selected", ("h1", "3"): "selected", ("h1", "4"): "excluded", ("h1", "5"): "excluded", ("h1", "6"): "after_target_year",
        ("h1", "7"): "excluded", ("h1", "8"): "unresolved_fiscal_year", ("h2", "1"): "outside_window", ("h2", "2"): "cancelled", ("h2", "3"): "cancellation",
        ("h3", "1"): "selected", ("h3", "2"): "correction_notice", ("h4", "100"): "selected", ("h4", "102"): "correction_notice", ("h4", "103"): "unresolved_fiscal_year",
    }
    late = ca.correction_without_revision(rows.where("issuer <> 'h4'"), D(2023, 12, 31), 2023).collect()
    assert [(r.issuer, r.fiscal_year, r.notice_id) for r in late] == [("h3", 2022, "2")]
    years = spark.createDataFrame([("Annual Report 2024/25",), ("2024/26 Annual Report 2023",), ("腾讯2020年年度报告",), ("1999/00 Annual Report",), ("Some 1800 text",)], "title string")
    assert [r[0] for r in years.select(ca.fiscal_year_hk(F.col("title"))).collect()] == [2025, 2024, 2020, 2000, None]


def test_a_cancellation_acts_on_the_version_it_names(spark):
    rows = catalog(spark, ("a", "100", "某公司2022年年度报告", None), ("a", "200", "某公司2022年年度报告（更新后）", None), ("a", "300", "某公司2022年年度报告取消公告", "100"))
    assert status(rows) == {("a", "100"): "cancelled", ("a", "200"): "selected", ("a", "300"): "cancellation"}
    early = catalog(spark, ("a", "1", "关于取消2022年年度报告的公告", "2"), ("a", "2", "2022年年度报告", None))
    assert status(early)["a", "2"] == "selected"
    packed = spark.createDataFrame([("i", json.dumps({"announcements": [{"announcementId": "3", "announcementTitle": "t", "announcementTime": 1, "replacementOf": " 7 "}]}))], "issuer string, payload string")
    assert [(r.venue, r.explicit_target_id) for r in ca.parse_announcements_a(packed).collect()] == [("CN", "7")]


def test_a_notice_for_several_years_acts_on_each(spark):
    rows = catalog(
        spark,
        ("a", "1", "2020年年度报告", None), ("a", "2", "2021年年度报告", None), ("a", "3", "关于2020年、2021年前期会计差错更正的公告", None), ("a", "4", "2021年年度报告（更正后）", None),
        ("h", "1", "2020年年度報告", None), ("h", "2", "2021年年度報告", None), ("h", "3", "2020年年報及2021年年報更正公告", None), ("b", "1", "关于前期会计差错更正的公告", None),
    )
    bound = ca.bind_replacements(ca.classify(rows, D(2023, 12, 31), 2023)).collect()
    assert sorted((r.issuer, r.announcement_id, r.fiscal_year, r.target_id) for r in bound) == [
        ("a", "3", 2020, "1"), ("a", "3", 2021, "2"), ("a", "4", 2021, "2"), ("h", "3", 2020, "1"), ("h", "3", 2021, "2"),
    ]
    late = ca.correction_without_revision(rows, D(2023, 12, 31), 2023).collect()
    assert sorted((r.issuer, r.fiscal_year, r.notice_id) for r in late) == [("a", 2020, "3"), ("h", 2020, "3"), ("h", 2021, "3")]
    assert status(rows)["b", "1"] == "unresolved_fiscal_year"
