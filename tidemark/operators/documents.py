"""Filings and profiles: line search, sections, reader cleaning, grading rows, page classes.

A document is one row and stays one row: lines are arrays handled by higher-order functions, so
searching or cleaning a corpus needs no shuffle and no group can outgrow its document.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import latest_by
from tidemark.operators.pit import fundamentals_asof, version_order
from tidemark.operators.screen import annual_dividends, metric_trajectory, trailing, valuation_bands

CONTEXT = 3
LINE_LIMIT = 500


def lines_of(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def truncate_text(df: DataFrame, limit: int, column: str = "text") -> DataFrame:
    long = F.length(column) > limit
    cut = F.concat(F.substring(column, 1, limit), F.lit("\n[truncated]"))
    return df.withColumn("truncated", long).withColumn(column, F.when(long, cut).otherwise(F.col(column)))


# --- search -----------------------------------------------------------------------------------


def search_lines(
    filings: DataFrame, needle: str, regex: bool = False, kinds: Sequence[str] | None = None,
    symbols: DataFrame | None = None, per_file: int | None = None,
) -> DataFrame:
    """Matching lines with their number and three lines of context on each side.

    A needle is found in the whole text first, so documents without it never build their line array.
    `per_file` keeps the first hits of each file when the caller wants a report rather than all hits.
    """
    if not needle:
        raise ValueError("query must not be empty")
    rows = filings if kinds is None else filings.where(F.col("kind").isin(list(kinds)))
    if symbols is not None:
        rows = rows.join(symbols.select("symbol"), "symbol", "left_semi")
    if not regex:
        rows = rows.where(F.contains("text", F.lit(needle)))

    def hit(line: Column) -> Column:
        return line.rlike(needle) if regex else F.contains(line, F.lit(needle))

    numbered = F.transform(F.col("_lines"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hits = F.transform(F.filter(numbered, lambda h: hit(h.getField("line"))), lambda h: h.withField("line", F.regexp_replace(h.getField("line"), r"^\s+|\s+$", "")))
    if per_file is not None:
        hits = F.slice(hits, 1, per_file)
    first = F.greatest(F.col("line_no") - CONTEXT, F.lit(1))
    size = F.least(F.col("line_no") + CONTEXT, F.size("_lines")) - first + 1
    line = F.when(F.length("line") > LINE_LIMIT, F.concat(F.substring("line", 1, LINE_LIMIT), F.lit("…"))).otherwise(F.col("line"))
    keep = [c for c in rows.columns if c != "text"]
    return (
        rows.withColumn("_lines", lines_of(F.col("text")))
        .select(*keep, "_lines", F.inline(hits))
        .withColumn("context", F.array_join(F.slice("_lines", first, size), "\n"))
        .withColumn("line", line)
        .drop("_lines")
    )


def search_order(hits: DataFrame) -> DataFrame:
    """Symbol, annual before prospectus before research, newest first, then line."""
    kind = F.when(F.col("kind") == "annual", 0).when(F.col("kind") == "ipo", 1).otherwise(2)
    return hits.orderBy("symbol", kind, F.desc_nulls_last("year"), F.desc_nulls_last("date"), "path", "line_no")


# --- sections ---------------------------------------------------------------------------------


def parse_sections(df: DataFrame, column: str = "text") -> DataFrame:
    """(…, section, body) per Markdown H2 and "H2 / H3"; an H2 keeps the text before its first H3."""
    numbered = F.transform(F.col("_lines"), lambda x, i: F.struct((i + 1).alias("at"), x.alias("line")))
    heads = F.filter(numbered, lambda h: h.getField("line").rlike("^#{2,3} "))

    def title(h: Column) -> Column:
        return F.trim(F.regexp_replace(h.getField("line"), "^#{2,3} ", ""))

    def section(h: Column, j: Column) -> Column:
        is_h2 = h.getField("line").startswith("## ")
        parents = F.filter(F.slice(F.col("_heads"), 1, j + 1), lambda p: p.getField("line").startswith("## "))
        parent = F.try_element_at(parents, F.lit(-1))
        name = F.when(is_h2, title(h)).when(parent.isNotNull(), F.concat(title(parent), F.lit(" / "), title(h)))
        following = F.coalesce(F.try_element_at(F.col("_heads"), j + 2).getField("at"), F.size("_lines") + 1)
        body = F.slice(F.col("_lines"), h.getField("at") + 1, following - h.getField("at") - 1)
        return F.struct(j.alias("section_no"), name.alias("section"), F.trim(F.array_join(body, "\n"), F.lit(" \n")).alias("body"))

    rest = [c for c in df.columns if c != column]
    return (
        df.withColumn("_lines", lines_of(F.col(column))).withColumn("_heads", heads)
        .select(*rest, F.inline(F.transform("_heads", section))).where(F.col("section").isNotNull())
    )


def sections_map(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sections of each document as a map; a repeated name keeps its last body."""
    last = latest_by(parse_sections(df), [*keys, "section"], [F.col("section_no")], ["body"])
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("sections"))


def get_section(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Body of one section, or NULL with the names that exist."""
    return sections_map(df, keys).select(
        *keys, F.try_element_at("sections", F.lit(name)).alias("body"), F.array_sort(F.map_keys("sections")).alias("available")
    )


# --- reader cleaning --------------------------------------------------------------------------

# What marks text written for machines.
COMMENT = r"(?s)<!--.*?-->"
READER_METADATA = r"^\s*\*\*(引用|置信度|管理层口径校核|估值阻断|管理层否决)[:：]\*\*(.*)$"
INTERNAL_GATE = r"(?:估值阻断|管理层否决)[:：]"
FINGERPRINT = r"(?i)(?<![0-9a-f])[0-9a-f]{40,64}(?![0-9a-f])"
ABSOLUTE_PATH = r"(?:/Users/|/home/)[^\s`|]+"
MACHINE_KEY = (
    r"(?i)\b(?:schema_version|claim_states|route_status|ledger_path|"
    r"market_definition_fingerprint|series_fingerprint)\b"
)
MACHINE_PARAGRAPH = (
    r"(?i)(?:原口径指纹|主口径指纹|路由终态|恢复账本|角色状态|claim状态|role状态|bundle状态|ledger\s+path)"
)
WORKFLOW_STATE = (
    r"(?i)(?:(?:accepted|partial|blocked|exhausted).{0,30}(?:claim|role|route|状态|路由)"
    r"|(?:claim|role|route|状态|路由).{0,30}(?:accepted|partial|blocked|exhausted))"
)
CITATION_LIST = r"机器引用清单"
LEAK_PATTERNS = (
    COMMENT, FINGERPRINT, ABSOLUTE_PATH, MACHINE_KEY, MACHINE_PARAGRAPH, WORKFLOW_STATE, INTERNAL_GATE, CITATION_LIST,
)
MACHINE_TABLE_TERMS = (
    "原口径指纹", "主口径指纹", "路由终态", "下一步所需证据", "schema版本", "schema version", "claim状态", "role状态", "ledger",
)
EXCERPT = 96
# Fixed value: the comment that keeps a section from readers.
EXCLUDE_MARKER = "<!-- reader-exclude-section -->"
# A marked section: its heading, the marker, and all lines up to a heading of its level or above.
EXCLUDED_SECTION = r"(?m)^(#{2,6})[^\S\n]+\S[^\n]*\n(?:[^\S\n]*\n)*[^\S\n]*" + EXCLUDE_MARKER + r"[^\n]*(?:\n(?!#{2,6}\s+\S)[^\n]*|\n(?=\1#+\s+\S)[^\n]*)*"


def leak_scan(df: DataFrame, column: str = "text") -> DataFrame:
    """First match of every leak pattern, as an array of short excerpts."""
    def first(pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(F.col(column), pattern, 0), F.lit(""))
        return F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, EXCERPT)

    return df.withColumn("leaks", F.array_compact(F.array(*[first(p) for p in LEAK_PATTERNS])))


def is_machine_paragraph(block: Column) -> Column:
    out = F.lit(False)
    for pattern in (FINGERPRINT, ABSOLUTE_PATH, MACHINE_KEY, MACHINE_PARAGRAPH, WORKFLOW_STATE):
        out = out | block.rlike(pattern)
    return out


def is_machine_table(block: Column) -> Column:
    out = block.rlike(FINGERPRINT)
    for term in MACHINE_TABLE_TERMS:
        out = out | F.contains(F.lower(block), F.lit(term))
    return block.rlike(r"^\s*\|") & out


def blank_comments(text: Column) -> Column:
    """Comments as spaces at their length, line feeds kept: words on both sides stay apart and on their lines."""
    found = F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0))
    between = F.split(text, COMMENT, -1)
    blanks = F.transform(found, lambda c: F.regexp_replace(c, r"[^\n]", " "))
    return F.when(
        F.contains(text, F.lit("<!--")), F.array_join(F.flatten(F.transform(between, lambda p, i: F.array_compact(F.array(p, F.try_element_at(blanks, i + 1))))), "")
    ).otherwise(text)


def clean_for_reader(df: DataFrame, column: str = "text") -> DataFrame:
    """Text without comments, reader metadata, machine tables and machine paragraphs, and the removal counts.

    The text becomes blocks: tables are set apart from prose, blocks are parted by blank lines, and the
    surviving blocks are joined with one blank line between them.
    """
    body = F.regexp_replace(F.col(column), EXCLUDED_SECTION, "\n")
    body = blank_comments(body)
    body = F.regexp_replace(body, "(?m)" + READER_METADATA, "")
    body = F.regexp_replace(body, r"(?m)^((?:[^\S\n]*\|.*\|[^\S\n]*(?:\n|\z))+)", "\n$1\n")
    parts = F.filter(F.split(body, r"\n[^\S\n]*(?:\n[^\S\n]*)+"), lambda b: F.trim(b, F.lit(" \n\t")) != "")
    judged = F.filter("_blocks", lambda b: ~(is_machine_table(b) | is_machine_paragraph(b)))
    tidy = F.transform("_kept", lambda b: F.regexp_replace(b, r"(?m)[^\S\n]+$|^\n+|\n+$", ""))
    return (
        df.withColumn("_blocks", parts)
        .withColumn("_kept", judged)
        .withColumn("comments", F.regexp_count(F.col(column), F.lit(COMMENT)))
        .withColumn("machine_blocks", F.size("_blocks") - F.size("_kept"))
        .withColumn("reader_text", F.array_join(tidy, "\n\n"))
        .drop("_blocks", "_kept")
    )


# --- corpus summaries -------------------------------------------------------------------------


def filing_counts(filings: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return filings.groupBy("symbol").agg(
        F.count_if(kind == "annual").alias("n_annual"),
        F.max(F.when(kind == "annual", F.col("year"))).alias("latest_annual_year"),
        F.coalesce(F.bool_or(kind == "ipo"), F.lit(False)).alias("has_ipo"),
        F.count_if(kind == "research").alias("n_research"),
        F.max(F.when(kind == "research", F.col("date"))).alias("latest_research"),
    )


def corpus_summary(filings: DataFrame, profiles: DataFrame, today: date) -> DataFrame:
    """Coverage of every symbol either store knows."""
    seen = profiles.groupBy("symbol").agg(F.max("date").alias("profile_date"))
    out = filing_counts(filings).join(seen, "symbol", "full_outer")
    return (
        out.fillna(0, ["n_annual", "n_research"]).fillna(False, ["has_ipo"])
        .withColumn("has_profile", F.col("profile_date").isNotNull())
        .withColumn("profile_age_days", F.datediff(F.lit(today), "profile_date"))
        .withColumn("staleness_years", F.lit(today.year) - F.col("latest_annual_year"))
    )


def enrich_with_filings(df: DataFrame, filings: DataFrame, profiles: DataFrame, today: date) -> DataFrame:
    out = df.join(corpus_summary(filings, profiles, today), "symbol", "left")
    return out.fillna(0, ["n_annual", "n_research"]).fillna(False, ["has_ipo", "has_profile"])


def dossier(
    facts: DataFrame, sectors: DataFrame, actions: DataFrame, filings: DataFrame, profiles: DataFrame, asof: date
) -> DataFrame:
    """One row per symbol: newest report, metric series, bands, dividends and documents; one job for all."""
    known = fundamentals_asof(facts, asof)
    newest = latest_by(known, ["symbol"], [F.col("report_date"), *version_order(facts)])
    series = known.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("report_date", "pe", "pb", "roe"))).alias("series"))
    bands = valuation_bands(known, "pe")
    bands = bands.select("symbol", F.struct(*[c for c in bands.columns if c != "symbol"]).alias("pe_bands"))
    paid = annual_dividends(trailing(actions, asof, 10, "ex_date")).groupBy("symbol").agg(F.count(F.lit(1)).alias("paid_years"))
    out = newest.join(sectors, "symbol", "left")
    for part in (series, bands, paid, corpus_summary(filings, profiles, asof)):
        out = out.join(part, "symbol", "left")
    return out.fillna(0, ["paid_years", "n_annual", "n_research"])


# --- grading, reports, pages ------------------------------------------------------------------


def content_dedup(df: DataFrame, id_column: str, column: str = "text") -> DataFrame:
    """Ids carried by different contents (collisions), from the content hash."""
    hashed = df.select(F.col(id_column), F.sha2(F.col(column), 256).alias("content_sha256")).distinct()
    return hashed.groupBy(id_column).agg(F.count(F.lit(1)).alias("n_contents")).where("n_contents > 1")


GRADE_SCHEMA = "moat_grade string, mgmt_grade string, redflag_count string, confidence string, rationale string"
# The letters a grade may take.
GRADE_LETTERS = ("A", "B", "C", "D", "F")


def grade_validate(df: DataFrame, column: str = "response") -> DataFrame:
    """Parse the JSON object inside each answer and name the first broken rule (NULL when valid)."""
    body = F.nullif(F.regexp_extract(F.col(column), r"(?s)\{.*\}", 0), F.lit(""))
    out = df.withColumn("_g", F.from_json(body, GRADE_SCHEMA)).select(*df.columns, body.isNull().alias("_none"), "_g.*")
    flags, conf = F.col("redflag_count").try_cast("int"), F.col("confidence").try_cast("double")
    whole = F.col("redflag_count").rlike(r"^\d+$")
    missing = F.lit(False)
    for c in ("moat_grade", "mgmt_grade", "redflag_count", "confidence", "rationale"):
        missing = missing | F.col(c).isNull()
    error = (
        F.when(F.col("_none"), "no_json").when(missing, "missing_field")
        .when(~F.col("moat_grade").isin(*GRADE_LETTERS) | ~F.col("mgmt_grade").isin(*GRADE_LETTERS), "grade_letter")
        .when(~whole, "redflag_count").when(conf.isNull() | ~conf.between(0, 1), "confidence")
    )
    return out.withColumn("error", error).withColumn("redflag_count", flags).withColumn("confidence", conf).drop("_none")


def grade_cache_lookup(documents: DataFrame, cache: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reused grades, work list) by content hash."""
    hashed = documents.withColumn("content_sha256", F.sha2("text", 256))
    if force:
        return hashed.limit(0).join(cache, "content_sha256"), hashed
    return hashed.join(cache, "content_sha256"), hashed.join(cache, "content_sha256", "left_anti")


# What names a deep or first-coverage report.
DEPTH_KEYWORDS = r"深度|首次|覆盖|重大"


def depth_reports(reports: DataFrame, asof: date, depth: str = DEPTH_KEYWORDS) -> DataFrame:
    named = F.coalesce(F.col("attach_type"), F.lit("")).rlike(depth) | F.coalesce(F.col("title"), F.lit("")).rlike(depth)
    return reports.where(named & (F.col("date") <= F.lit(asof))).orderBy(F.desc("date"), "title")


# File-name forms of brokers whose names are Chinese.
BROKER_SLUGS = {
    "中金公司": "zhongjin", "中国国际金融": "zhongjin", "中信证券": "zhongxin", "中信建投": "zhongxinjt", "中信建投证券": "zhongxinjt",
    "华泰证券": "huatai", "华创证券": "huachuang", "华西证券": "huaxi", "国盛证券": "guosheng", "天风证券": "tianfeng",
    "东吴证券": "dongwu", "东北证券": "dongbei", "东兴证券": "dongxing", "中泰证券": "zhongtai", "国金证券": "guojin",
    "招商证券": "zhaoshang", "国信证券": "guoxin", "国海证券": "guohai", "国元证券": "guoyuan", "国联证券": "guolian",
    "国投证券": "guotou", "光大证券": "guangda", "海通证券": "haitong", "方正证券": "fangzheng", "长江证券": "changjiang",
    "广发证券": "guangfa", "申万宏源": "shenwanhy", "开源证券": "kaiyuan", "民生证券": "minsheng", "兴业证券": "xingye",
    "西南证券": "xinan", "西部证券": "xibu", "山西证券": "shanxi", "上海证券": "shanghai", "财通证券": "caitong",
    "财信证券": "caixin", "平安证券": "pingan", "信达证券": "xinda", "浙商证券": "zheshang", "银河证券": "yinhe",
    "中国银河": "yinhe", "中银证券": "zhongyin", "中原证券": "zhongyuan",
}


def broker_slug(broker: Column, slugs: Mapping[str, str] = BROKER_SLUGS) -> Column:
    """The broker in a file name: its listed form, else its ASCII letters and digits in lower case, else `unknown` (also for NULL).

    A Chinese name outside `slugs` has no letters left and is `unknown`: pass a wider table for more of them.
    """
    name = F.trim(F.coalesce(broker, F.lit("")))
    listed = F.create_map(*(F.lit(x) for pair in slugs.items() for x in pair)) if slugs else F.lit(None).cast("map<string,string>")
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(listed, name), F.nullif(plain, F.lit("")), F.lit("unknown"))


def report_filename(broker: Column, title: Column, day: Column, limit: int = 80) -> Column:
    """`<broker>-<title>-YYYYMMDD.md` with unsafe characters and blanks folded into single dashes."""
    safe = F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\s]+', "-"), "-+", "-")
    safe = F.regexp_replace(F.substring(F.trim(safe, F.lit("-")), 1, limit), "-+$", "")
    name = F.when(safe == "", F.lit("untitled")).otherwise(safe)
    return F.concat(F.concat_ws("-", broker_slug(broker), name, F.date_format(day, "yyyyMMdd")), F.lit(".md"))


# Page phrases by class, tried in this order.
PAGE_CLASSES = (
    ("anti_bot", r"(?i)verify you are human|security check|captcha|安全检测"),
    ("login_required", r"(?i)please sign in|login required|请先?登录"),
    ("paywalled", r"(?i)become a member|subscribe now|subscription required"),
    ("broken_link", r"(?i)page not found|<h1>404"),
)


def classify_pages(pages: DataFrame, status: Column, expected: Column) -> DataFrame:
    """Class of a fetched page: refusals by status, then by phrase, then whether it shows what was expected."""
    out = F.when(status.isin(404, 410), "broken_link").when(status == 401, "login_required").when(status.isin(403, 429), "anti_bot")
    for name, pattern in PAGE_CLASSES:
        out = out.when(F.col("html").rlike(pattern), name)
    found = F.coalesce(F.contains(F.lower("html"), F.lower(expected)), F.lit(False))
    return pages.withColumn("page_class", out.when(found, "reachable").otherwise("unverified"))


def consecutive_batches(turns: DataFrame, chunk: int = 4096) -> DataFrame:
    """Runs of neighbouring turns with one role, as (conv_id, first_turn, role, n_turns, text).

    A turn starts a run when the turn before it in order, whatever its number, has another role; the start
    of a run reaches its rows by a carry over bounded chunks of turns, so a very long conversation is split.
    """
    # The turn before in order: inside its chunk a window, at a chunk's first turn the last one of the chunk before.
    chunked = turns.withColumn("_chunk", F.floor(F.col("turn") / chunk))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("turn")
    ends = chunked.groupBy("conv_id", "_chunk").agg(F.max_by("role", "turn").alias("_last"))
    ends = ends.select("conv_id", "_chunk", F.lag("_last").over(Window.partitionBy("conv_id").orderBy("_chunk")).alias("_last"))
    seen = chunked.withColumn("_prev", F.lag("role").over(inside)).join(ends, ["conv_id", "_chunk"])
    previous = F.coalesce("_prev", "_last")
    marked = seen.withColumn("_start", F.when(previous.isNull() | (previous != F.col("role")), F.col("turn"))).drop("_prev", "_last")
    carried = carry_forward(marked, ["conv_id"], "_chunk", "turn", "_start")
    return carried.groupBy("conv_id", F.col("_start").alias("first_turn"), "role").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t.getField("text")), "\n").alias("text"),
    )


def carry_forward(df: DataFrame, keys: Sequence[str], chunk: str, order: str, value: str) -> DataFrame:
    """Last non-null `value` at or before each row, computed per chunk plus one carried value per chunk."""
    w = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*keys, chunk).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, chunk, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (
        df.withColumn(value, F.last(value, ignorenulls=True).over(w)).join(carried, [*keys, chunk])
        .withColumn(value, F.coalesce(value, "_carry")).drop("_carry")
    )


# --- period ends and fiscal years -------------------------------------------------------------

# Accepted fiscal years and the date forms of a cover page.
YEAR_BOUNDS = (1990, 2035)
YEAR_RANGE = r"(?<!\d)((?:19|20)\d{2})\s*/\s*(\d{2})(?!\d)"
YEAR_PLAIN = r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DAY_MONTH = rf"(?i)(?:year|period)\s+ended\s+(\d{{1,2}}\s+(?:{MONTHS})\s+(?:19|20)\d{{2}})"
MONTH_DAY = rf"(?i)(?:year|period)\s+ended\s+((?:{MONTHS})\s+\d{{1,2}},?\s+(?:19|20)\d{{2}})"
CHINESE_DAY = r"截至\s*((?:19|20)\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2})\s*日"
SEVERAL_YEARS = rf"(?i)years\s+ended\s+((?:{MONTHS})\s+\d{{1,2}}),?\s+((?:19|20)\d{{2}}(?:(?:\s*,\s*(?:and\s+)?|\s+(?:and|&)\s+)(?:19|20)\d{{2}})+)\s*$"
YEAR_BELOW = rf"(?i)(?:as\s+of|years?\s+ended)\s+((?:{MONTHS})\s+\d{{1,2}}),?\s*$"
COVER_YEAR = r"(?i)\b(?:(?:19|20)\d{2}\s+annual\s+report|annual\s+report\s+(?:19|20)\d{2})\b"
STATEMENT = "(?i)audited|consolidated financial statements|consolidated statement of financial position|consolidated balance sheet|綜合財務報表|综合财务报表|綜合財務狀況表|综合财务状况表|經審核財務報表|经审核财务报表"
OTHER_CONTEXT = "(?i)forecast|projection|budget|pro forma|comparative|预测|預測|预算|預算"


def fiscal_year_extract(title: Column) -> Column:
    """`2024/25` means its ending year; otherwise the first four-digit year, inside the accepted bounds."""
    start = F.nullif(F.regexp_extract(title, YEAR_RANGE, 1), F.lit("")).cast("int")
    end2 = F.nullif(F.regexp_extract(title, YEAR_RANGE, 2), F.lit("")).cast("int")
    ending = F.floor(start / 100).cast("int") * 100 + end2
    ending = F.when(ending < start, ending + 100).otherwise(ending)
    plain = F.nullif(F.regexp_extract(title, YEAR_PLAIN, 1), F.lit("")).cast("int")
    year = F.coalesce(ending, plain)
    return F.when(year.between(*YEAR_BOUNDS), year)


COVER_PAGES = 10


def _period_ends(lines: Column, here: Callable[[Column], Column] | None = None) -> Column:
    """Distinct dates that lines name as a period's end, but for lines of another context; `here` says by its index whether a line counts.

    Of several years after one day, in the line or in the two lines below a day without one, the newest counts.
    """

    def newest(day: Column, years: Column) -> Column:
        return F.concat_ws(" ", day, F.array_max(F.regexp_extract_all(years, F.lit(YEAR_PLAIN), F.lit(1))))

    def month_first(found: Column) -> Column:
        return F.transform(found, lambda d: F.try_to_date(F.initcap(F.regexp_replace(d, r"[,\s]+", " ")), "MMMM d yyyy"))

    def named(line: Column, i: Column) -> Column:
        listed, alone = F.regexp_extract(line, SEVERAL_YEARS, 1), F.regexp_extract(line, YEAR_BELOW, 1)
        below = F.array_join(F.slice(lines, i + 2, 2), " ")
        day_first = F.transform(F.regexp_extract_all(line, F.lit(DAY_MONTH), F.lit(1)), lambda d: F.try_to_date(F.initcap(F.regexp_replace(d, r"\s+", " ")), "d MMMM yyyy"))
        chinese = F.transform(F.regexp_extract_all(line, F.lit(CHINESE_DAY), F.lit(1)), lambda d: F.try_to_date(F.regexp_replace(d, r"\D+", "-"), "yyyy-M-d"))
        single = F.concat(day_first, month_first(F.regexp_extract_all(line, F.lit(MONTH_DAY), F.lit(1))), chinese, month_first(F.array(newest(alone, below))))
        found = F.when(listed != "", month_first(F.array(newest(listed, F.regexp_extract(line, SEVERAL_YEARS, 2))))).otherwise(single)
        counts = line.rlike("(?i)ended|as\\s+of|截至") & ~line.rlike(OTHER_CONTEXT)
        return F.when(counts if here is None else counts & here(i), found).otherwise(F.array().cast("array<date>"))

    return F.array_distinct(F.filter(F.flatten(F.transform(lines, named)), lambda d: d.isNotNull()))


def report_period_end(df: DataFrame, cover_pages: int = COVER_PAGES, marker: str = STATEMENT, column: str = "text") -> DataFrame:
    """Period end of extracted text: the only date of the cover, its first pages (parted by form feeds), that also stands at or within three
    lines after a statement's marker. Failing that, the only date of the statements in the one year that the cover names for its report.
    None or several, or no text, give NULL.
    """
    cover = F.array_join(F.slice(F.split(F.col(column), "\f"), 1, cover_pages), "\n")
    lines = F.col("_lines")
    marked = _period_ends(lines, lambda i: F.exists(F.slice(lines, F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4))), lambda y: y.rlike(marker)))
    found = df.withColumn("_cover", cover).withColumn("_lines", lines_of(F.col(column))).withColumn("_marked", marked)
    found = found.withColumn("_head", lines_of(F.col("_cover"))).withColumn("_both", F.array_intersect(_period_ends(F.col("_head")), F.col("_marked")))
    years = F.array_distinct(F.transform(F.regexp_extract_all("_cover", F.lit(COVER_YEAR), F.lit(0)), lambda y: F.regexp_extract(y, YEAR_PLAIN, 1).cast("int")))
    found = found.withColumn("_years", years).withColumn("_of_year", F.filter("_marked", lambda d: F.year(d) == F.try_element_at("_years", F.lit(1))))
    only = F.when(F.size("_both") == 1, F.try_element_at("_both", F.lit(1))).when((F.size("_years") == 1) & (F.size("_of_year") == 1), F.try_element_at("_of_year", F.lit(1)))
    return found.withColumn("period_end", only).drop("_cover", "_lines", "_marked", "_head", "_both", "_years", "_of_year")
