"""Announcement catalogs: classification, versions per fiscal year, cancellations and corrections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import latest_by
from tidemark.session import settle

# What titles of the annual-report catalogs mean, mainland ones first.
EXCLUDE_TITLE = r"摘要|英文版|英文稿|取消|已取消|补充公告|年度报告(?:的)?更正公告"
ANNUAL_TITLE = r"(\d{4})\s*年\s*年度?\s*报告"
ANNUAL_FULL_TITLE = r"^\s*.*?(\d{4})\s*年\s*年度?\s*报告(?:\s*全文)?(?:\s*[（(](?:更正后|更正版|修订版|更新后)[）)])?\s*$"
PROSPECTUS_TITLE = r"^招股说明书(?:（(?:修订稿|更新稿|更正版)）)?$"
CORRECTED_FULL = r"更正后|更正版|修订版|更新后"
CORRECTION_NOTICE = r"年度报告.*更正公告"
RESTATEMENT_NOTICE = r"前期会计差错更正|会计差错更正|追溯调整|财务报表重述|重述公告"
CANCELLATION = r"取消|已取消"
ANNUAL_CONTEXT = r"年度?\s*报告"
NOTICE_YEAR = r"(?<!\d)((?:19|20)\d{2})\s*年"
HK_EXCLUDE_TITLE = (
    r"(?i)summary|interim|quarterly|supplement|circular|announcement|notice|cancellation|cancelled|canceled|"
    r"response\s+to\s+(?:the\s+)?(?:quer(?:y|ies)|enquir(?:y|ies))|"
    r"reply\s+to\s+(?:the\s+)?(?:quer(?:y|ies)|enquir(?:y|ies))|"
    r"(?:quer(?:y|ies)|enquir(?:y|ies))\s+in\s+relation|"
    r"摘要|中期|季度|补充|通函|通知|公告|取消|已取消|问询|查询回复"
)
HK_YEAR = r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"
HK_YEAR_RANGE = r"(?<!\d)((?:19|20)\d{2})\s*/\s*(\d{2})(?!\d)"
HK_CANCELLATION = r"(?i)cancellation|cancelled|canceled|取消|已取消"
HK_CORRECTION_NOTICE = (
    r"(?i)(?:correction|clarification).*annual report|annual report.*(?:correction|clarification)|"
    r"(?:年度[报報]告|年[报報]).*更正公告|更正公告.*(?:年度[报報]告|年[报報])"
)
HK_REVISED_FULL = r"(?i)revised|corrected|restated|修[订訂]版|更正后|更正版"
HK_FULL_REPORT = r"(?i)annual report|年度[报報]告|年[报報]"
HK_YEARS = (1990, 2035)  # a number outside is no fiscal year

A_SCHEMA = (
    "struct<totalAnnouncement:int,announcements:array<struct<secCode:string,orgId:string,announcementId:string,"
    "announcementTitle:string,announcementTime:bigint,adjunctUrl:string,"
    "targetAnnouncementId:string,replacementOf:string,replacesAnnouncementId:string>>>"
)
HK_SCHEMA = (
    "array<struct<NEWS_ID:string,DATE_TIME:string,STOCK_CODE:string,TITLE:string,FILE_LINK:string,"
    "targetAnnouncementId:string,replacementOf:string,replacesAnnouncementId:string>>"
)


def _explicit_target() -> Column:
    """The id that a record says it replaces."""
    return F.coalesce(*(F.nullif(F.trim(f"a.{c}"), F.lit("")) for c in ("targetAnnouncementId", "replacementOf", "replacesAnnouncementId"))).alias("explicit_target_id")


def or_one_null(records: str) -> Column:
    """The records, or a single null one where they could not be read, so that no payload vanishes."""
    return F.coalesce(F.col(records), F.array(F.try_element_at(F.col(records), F.lit(1))))


def require_well_formed(records: DataFrame) -> DataFrame:
    """The strict reading: the first malformed record is an error when the plan runs."""
    return records.withColumn("malformed", F.when(F.col("malformed"), F.raise_error(F.lit("malformed announcement record")).cast("boolean")).otherwise(F.lit(False)))


def parse_announcements_a(df: DataFrame, column: str = "payload") -> DataFrame:
    """Mainland catalog JSON to rows; a record without an id, title or time has malformed = true, and so has the
    one row of a payload that cannot be read. A payload of no announcements has no row."""
    rest = [c for c in df.columns if c not in (column, "venue", "explicit_target_id")]
    rows = df.select(*rest, F.from_json(column, A_SCHEMA).alias("_p")).select(*rest, F.explode(or_one_null("_p.announcements")).alias("a"))
    when = F.timestamp_millis(F.col("a.announcementTime"))
    return rows.select(
        *rest, F.col("a.secCode").alias("code"), F.col("a.announcementId").alias("announcement_id"), F.col("a.announcementTitle").alias("title"),
        F.to_date(F.from_utc_timestamp(when, "Asia/Shanghai")).alias("announced"), F.col("a.adjunctUrl").alias("url"),
        (F.col("a.announcementId").isNull() | F.col("a.announcementTitle").isNull() | when.isNull()).alias("malformed"),
        F.lit("CN").alias("venue"), _explicit_target(),
    )


def parse_announcements_hk(df: DataFrame, column: str = "payload") -> DataFrame:
    """Hong Kong payloads hold a JSON array inside a JSON string; an unreadable one gives one malformed row."""
    rest = [c for c in df.columns if c not in (column, "venue", "explicit_target_id")]
    inner = F.from_json(F.get_json_object(column, "$.result"), HK_SCHEMA)
    when = F.try_to_timestamp(F.col("a.DATE_TIME"), F.lit("dd/MM/yyyy HH:mm"))
    return df.select(*rest, inner.alias("_inner")).select(*rest, F.explode(or_one_null("_inner")).alias("a")).select(
        *rest, F.col("a.STOCK_CODE").alias("code"), F.col("a.NEWS_ID").alias("announcement_id"), F.col("a.TITLE").alias("title"),
        F.to_date(when).alias("announced"), F.col("a.FILE_LINK").alias("url"), (F.col("a.NEWS_ID").isNull() | F.col("a.TITLE").isNull() | when.isNull()).alias("malformed"),
        F.lit("HK").alias("venue"), _explicit_target(),
    )


def fiscal_year(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, ANNUAL_TITLE, 1), F.lit("")).cast("int")


def fiscal_year_hk(title: Column) -> Column:
    """The end of a range such as 2024/25, else the year of a mainland title, else the first number that is a year."""
    start = F.nullif(F.regexp_extract(title, HK_YEAR_RANGE, 1), F.lit("")).cast("int")
    end = F.floor(start / 100).cast("int") * 100 + F.nullif(F.regexp_extract(title, HK_YEAR_RANGE, 2), F.lit("")).cast("int")
    end = F.when(end < start, end + 100).otherwise(end)
    first = F.nullif(F.regexp_extract(title, HK_YEAR, 1), F.lit("")).cast("int")
    return F.coalesce(F.when((end == start + 1) & end.between(*HK_YEARS), end), fiscal_year(title), F.when(first.between(*HK_YEARS), first))


def sort_key() -> Column:
    """Announcement order: time, official id (numbers before other ids), revision."""
    number = F.col("announcement_id").rlike(r"^\d+$")
    official = F.when(number, F.concat(F.lit("0:"), F.lpad("announcement_id", 30, "0"))).otherwise(F.concat(F.lit("1:"), F.col("announcement_id")))
    return F.struct(F.col("announced_s").alias("at"), official.alias("official"), _revised().cast("int").alias("revision"))


def _revised() -> Column:
    return F.col("title").rlike(CORRECTED_FULL) | F.col("title").rlike(HK_REVISED_FULL)


def classify(catalog: DataFrame, cutoff: date, end_year: int) -> DataFrame:
    """Add fiscal_year, affected_years, revised, key and the first class that applies, by the title rules of the venue.

    `catalog` may have `venue` (HK; all else is mainland) and `explicit_target_id`. affected_years are all the years that a
    correction or restatement notice names, else the fiscal year alone; fiscal_year is null if a mainland notice names several.
    """
    for column, value in (("venue", F.lit("CN")), ("explicit_target_id", F.lit(None).cast("string"))):
        if column not in catalog.columns:
            catalog = catalog.withColumn(column, value)
    t, hk = F.col("title"), F.col("venue").eqNullSafe("HK")
    by_venue = lambda there, here: F.when(hk, there).otherwise(here)
    cancelled = by_venue(t.rlike(HK_CANCELLATION) & t.rlike(HK_FULL_REPORT), t.rlike(CANCELLATION) & t.rlike(ANNUAL_CONTEXT))
    correction = by_venue(t.rlike(HK_CORRECTION_NOTICE), t.rlike(CORRECTION_NOTICE) | t.rlike(RESTATEMENT_NOTICE))
    excluded = by_venue(t.rlike(HK_EXCLUDE_TITLE) | ~t.rlike(HK_FULL_REPORT), t.rlike(EXCLUDE_TITLE) | ~t.rlike(ANNUAL_FULL_TITLE))
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(NOTICE_YEAR), F.lit(1)).cast("array<int>")))
    several = by_venue(t.rlike(HK_CORRECTION_NOTICE), t.rlike(RESTATEMENT_NOTICE) & fiscal_year(t).isNull())
    only = F.when(several & (F.size(named) == 1), F.try_element_at(named, F.lit(1)))
    years = catalog.withColumn("fiscal_year", by_venue(fiscal_year_hk(t), F.coalesce(fiscal_year(t), only)))
    year = F.col("fiscal_year")
    affected = F.when(several & (F.size(named) > 0), named).otherwise(F.array_compact(F.array(year)))
    unresolved = F.size("affected_years") == 0
    kind = (
        F.when(F.col("announced") > F.lit(cutoff), "after_cutoff")
        .when((cancelled | correction) & unresolved, "unresolved_fiscal_year")
        .when(cancelled, "cancellation").when(correction, "correction_notice")
        .when(excluded, "excluded")
        .when(year > end_year, "after_target_year").when(year.isNull(), "unresolved_fiscal_year").otherwise("candidate")
    )
    return years.withColumn("affected_years", affected).withColumns({"class": kind, "revised": _revised(), "key": sort_key()})


def _per_year(classified: DataFrame) -> DataFrame:
    """A row for each fiscal year that an announcement is about."""
    return classified.withColumn("fiscal_year", F.explode("affected_years"))


def bind_replacements(classified: DataFrame) -> DataFrame:
    """Notices and revised reports, once for each year they affect, with the id they replace: the one they name, else the
    report before them in that fiscal year.

    A cancellation without a predecessor is the anchor of the chain until the first report. The window is
    over the announcements of one issuer and fiscal year.
    """
    w = Window.partitionBy("issuer", "fiscal_year").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    holds = ~F.col("class").isin("cancellation", "correction_notice", "excluded", "after_cutoff")
    last = F.last(F.when(holds, F.col("announcement_id")), ignorenulls=True).over(w)
    anchor = F.first(F.when(F.col("class") == "cancellation", F.col("announcement_id")), ignorenulls=True).over(w)
    dated = _per_year(classified).withColumn("target_id", F.coalesce("explicit_target_id", last, anchor))
    return dated.where(F.col("class").isin("cancellation", "correction_notice") | F.col("revised"))


def _cancelled(classified: DataFrame) -> DataFrame:
    """Cancelled candidates, and whether a cancellation of theirs comes after them."""
    keys = ["issuer", "fiscal_year", "announcement_id"]
    notices = bind_replacements(classified).where(F.col("class") == "cancellation")
    targets = notices.groupBy("issuer", "fiscal_year", F.col("target_id").alias("announcement_id")).agg(F.max("key").alias("_nk"))
    return classified.where(F.col("class") == "candidate").join(targets, keys).select(*keys, (F.col("_nk") > F.col("key")).alias("late"))


def cancelled_reports(classified: DataFrame) -> DataFrame:
    """(issuer, fiscal_year, announcement_id) of the candidates a cancellation targets."""
    return _cancelled(classified).drop("late")


def latest_candidates(classified: DataFrame) -> DataFrame:
    """Latest full report per issuer and fiscal year."""
    return latest_by(classified.where(F.col("class") == "candidate"), ["issuer", "fiscal_year"], [F.col("key")], ["announcement_id", "key", "revised"])


def annual_catalog_select(catalog: DataFrame, cutoff: date, end_year: int, years: int) -> DataFrame:
    """Every announcement with its status: the latest report of the latest `years` fiscal years is selected,
    a latest report cancelled after it came removes its year, the rest are superseded or outside the window."""
    rows = settle(classify(catalog, cutoff, end_year))
    dead = _cancelled(rows).withColumn("_dead", F.lit(True))
    latest = latest_candidates(rows).select("issuer", "fiscal_year", F.col("announcement_id").alias("_latest"))
    alive = latest.join(dead.where("late").select("issuer", "fiscal_year", F.col("announcement_id").alias("_latest")), ["issuer", "fiscal_year", "_latest"], "left_anti")
    w = Window.partitionBy("issuer").orderBy(F.desc("fiscal_year"))
    chosen = alive.withColumn("_rank", F.row_number().over(w))
    out = rows.join(dead, ["issuer", "fiscal_year", "announcement_id"], "left").join(chosen, ["issuer", "fiscal_year"], "left")
    mine = F.col("announcement_id") == F.col("_latest")
    status = (
        F.when(F.col("class") != "candidate", F.col("class")).when(mine & (F.col("_rank") <= years), "selected").when(F.col("_dead"), "cancelled")
        .when(F.col("_latest").isNotNull() & ~mine, "superseded").otherwise("outside_window")
    )
    return out.select("issuer", "announcement_id", "fiscal_year", "title", status.alias("status"))


def correction_without_revision(catalog: DataFrame, cutoff: date, end_year: int) -> DataFrame:
    """Fiscal years whose latest correction notice follows the selected report and no revised report follows it
    (a revised report just before it, adjacent id and within five minutes, counts as following)."""
    rows = settle(classify(catalog, cutoff, end_year))
    keys = ["issuer", "fiscal_year"]
    notice = latest_by(_per_year(rows.where(F.col("class") == "correction_notice")), keys, [F.col("key")], ["announcement_id", "key", "announced_s"])
    notice = notice.withColumnsRenamed({"announcement_id": "notice_id", "key": "_nk", "announced_s": "_ns"})
    late = notice.join(latest_candidates(rows).select(*keys, F.col("key").alias("_sk")), keys).where(F.col("_nk") > F.col("_sk"))
    corrected = F.when(F.col("venue").eqNullSafe("HK"), F.col("title").rlike(HK_REVISED_FULL)).otherwise(F.col("title").rlike(CORRECTED_FULL))
    revised = rows.where((F.col("class") == "candidate") & corrected).select(*keys, "key", "announced_s", "announcement_id")
    gap = F.col("notice_id").try_cast("decimal(30,0)") - F.col("announcement_id").try_cast("decimal(30,0)")
    batch = (gap == 1) & (F.col("_ns") - F.col("announced_s")).between(0, 300)
    answered = late.join(revised, keys).where((F.col("key") > F.col("_nk")) | F.coalesce(batch, F.lit(False)))
    return late.join(answered.select(*keys), keys, "left_anti").select(*keys, "notice_id")


def prospectus_select(catalog: DataFrame, cutoff: date) -> DataFrame:
    rows = catalog.where(F.col("title").rlike(PROSPECTUS_TITLE) & (F.col("announced") <= F.lit(cutoff)))
    return rows.orderBy(F.desc("announced_s"), F.desc("announcement_id"))


def latest_compatible_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per input fingerprint an unfinished run before a completed one, then the newest."""
    priority = F.when(F.col("status") == "running", 2).when(F.col("status") == "completed", 1).otherwise(0)
    return latest_by(runs, keys, [priority, F.col("created"), F.col("version")])


def snapshot_drift(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose stored row is missing, new, or hashes differently, with what differs."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        digest = F.sha2(F.to_json(F.struct(*columns)), 256)
        return df.select(*keys, digest.alias(f"_h{tag}"), F.struct(*columns).alias(f"_v{tag}"))

    both = side(stored, "s").join(side(fresh, "f"), keys, "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_vs.{c}").eqNullSafe(F.col(f"_vf.{c}")), F.lit(c)) for c in columns]))
    reason = F.when(F.col("_hs").isNull(), F.array(F.lit("added"))).when(F.col("_hf").isNull(), F.array(F.lit("removed"))).otherwise(names)
    return both.where(~F.col("_hs").eqNullSafe(F.col("_hf"))).select(*keys, reason.alias("drift"))


def ttl_precedence(observations: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Per key a fresh cached observation, else the reviewed snapshot, else the profile default.

    `observations` has layer, observed, ttl_days; stale and future cache rows do not count.
    """
    live = (F.col("layer") != "cache") | ((F.col("observed") <= now) & (F.datediff(now, "observed") <= F.col("ttl_days")))
    rank = F.when(F.col("layer") == "cache", 3).when(F.col("layer") == "snapshot", 2).otherwise(1)
    return latest_by(observations.where(live), keys, [rank, F.col("observed"), F.col("value")], ["layer", "observed", "value"])
