"""Queries over documents, conversations and pages."""

from __future__ import annotations

from datetime import date as D

from pyspark.sql import functions as F

from tidemark.operators import documents as dc
from tidemark.plans import views as v
from tidemark.plans.registry import query

SQL_HITS = """l AS (SELECT doc_id, symbol, kind, string_split(text, chr(10)) AS ls FROM v_filing),
    n AS (SELECT doc_id, symbol, kind, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM l),
    hits AS (SELECT doc_id, symbol, kind, line_no, ls[line_no] AS full_line, array_to_string(ls[greatest(line_no - 3, 1):least(line_no + 3, len(ls))], chr(10)) AS context FROM n WHERE {cond})"""
CUT = "CASE WHEN length(full_line) > 500 THEN substr(full_line, 1, 500) || '…' ELSE full_line END AS line"


@query("search_lines", "WITH " + SQL_HITS.format(cond="contains(ls[line_no], 'token')") + f" SELECT doc_id, symbol, kind, line_no, {CUT}, context FROM hits")
def search_lines(spark, sf):
    return dc.search_order(dc.search_lines(v.v_filing(spark, sf), "token")).select("doc_id", "symbol", "kind", "line_no", "line", "context")


@query("search_lines_regex", "WITH " + SQL_HITS.format(cond="kind IN ('annual', 'ipo') AND regexp_matches(ls[line_no], '[0-9]{4,}')") + f" SELECT doc_id, line_no, {CUT} FROM hits")
def search_lines_regex(spark, sf):
    return dc.search_lines(v.v_filing(spark, sf), "[0-9]{4,}", regex=True, kinds=["annual", "ipo"]).select("doc_id", "line_no", "line")


@query("context_lines", "WITH " + SQL_HITS.format(cond="contains(ls[line_no], '@')") + " SELECT doc_id, line_no, context FROM hits")
def context_lines(spark, sf):
    return dc.search_lines(v.v_filing(spark, sf), "@").select("doc_id", "line_no", "context")


@query("hits_limit_per_file", "WITH " + SQL_HITS.format(cond="contains(ls[line_no], 'an')") + " SELECT doc_id, line_no FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 2")
def hits_limit_per_file(spark, sf):
    return dc.search_lines(v.v_filing(spark, sf), "an", per_file=2).select("doc_id", "line_no")


@query("limit_hits", "WITH " + SQL_HITS.format(cond="contains(ls[line_no], 'an')") + " SELECT symbol, kind, doc_id, line_no FROM hits ORDER BY symbol, kind, doc_id, line_no LIMIT 50")
def limit_hits(spark, sf):
    return dc.search_lines(v.v_filing(spark, sf), "an").select("symbol", "kind", "doc_id", "line_no").orderBy("symbol", "kind", "doc_id", "line_no").limit(50)


SQL_MD = "md AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^([A-F])', '## \\1', 'g'), '(?m)^([G-K])', '### \\1', 'g') AS text FROM documents)"
SQL_SECTIONS = SQL_MD + """, l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM md), n AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
    g AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') OR starts_with(line, '### ') THEN 1 ELSE 0 END) OVER w AS grp,
      last_value(CASE WHEN starts_with(line, '## ') THEN trim(substr(line, 4)) END IGNORE NULLS) OVER w AS h2 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT doc_id, grp - 1 AS section_no, first(line ORDER BY i) AS head, first(h2 ORDER BY i) AS h2, string_agg(line, chr(10) ORDER BY i) AS whole FROM g WHERE grp > 0 GROUP BY 1, 2),
    sections AS (SELECT doc_id, section_no::INTEGER AS section_no, CASE WHEN starts_with(head, '## ') THEN h2 ELSE h2 || ' / ' || trim(substr(head, 5)) END AS section,
      trim(substr(whole, length(head) + 2), ' ' || chr(10)) AS body FROM s WHERE h2 IS NOT NULL)"""


def _markdown(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", "(?m)^([A-F])", "## $1"), "(?m)^([G-K])", "### $1")
    return v.table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query("parse_sections", f"WITH {SQL_SECTIONS} SELECT doc_id, section_no, section, body FROM sections")
def parse_sections(spark, sf):
    return dc.parse_sections(_markdown(spark, sf)).select("doc_id", "section_no", "section", "body")


SECTION_NAME = "Anble anes."  # a heading that many documents share


@query("get_section", f"""WITH {SQL_SECTIONS}, k AS (SELECT doc_id, section, last(body ORDER BY section_no) AS body FROM sections GROUP BY 1, 2)
    SELECT doc_id, max(body) FILTER (section = '{SECTION_NAME}') AS body, list_sort(list(section)) AS available FROM k GROUP BY 1""")
def get_section(spark, sf):
    return dc.get_section(_markdown(spark, sf), ["doc_id"], SECTION_NAME).where(F.size("available") > 0)


@query("clean_for_reader")
def clean_for_reader(spark, sf):
    return dc.clean_for_reader(v.table(spark, sf, "documents")).select("doc_id", "comments", "machine_blocks", "reader_text")


@query("leak_scan", """WITH m AS (SELECT doc_id, regexp_extract(text, '(?i)(^|[^0-9a-f])([0-9a-f]{40,64})($|[^0-9a-f])', 2) AS a, regexp_extract(text, '(/Users/|/home/)[^\\s`|]+') AS b FROM documents)
    SELECT doc_id, [x FOR x IN [a, b] IF x <> ''] AS leaks FROM m WHERE a <> '' OR b <> ''""")
def leak_scan(spark, sf):
    return dc.leak_scan(v.table(spark, sf, "documents")).select("doc_id", "leaks").where(F.size("leaks") > 0)


@query("content_dedup", "SELECT source || '/' || lang AS doc_key, count(DISTINCT sha256(text)) AS n_contents FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def content_dedup(spark, sf):
    d = v.table(spark, sf, "documents").withColumn("doc_key", F.concat_ws("/", "source", "lang"))
    return dc.content_dedup(d, "doc_key")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_hash(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@query("grade_validate", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no_json' WHEN doc_id % 5 = 1 THEN 'missing_field' WHEN doc_id % 7 = 6 THEN 'grade_letter' WHEN toxic = 1 THEN 'redflag_count' WHEN doc_id % 11 = 0 THEN 'confidence' END AS error FROM labels""")
def grade_validate(spark, sf):
    d = F.col("doc_id")
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCDFBE"]), (d % 7 + 1).cast("int"))
    body = F.struct(
        letter.alias("moat_grade"), F.lit("A").alias("mgmt_grade"), (-3 * F.col("toxic") + F.col("quality") * (1 - F.col("toxic"))).alias("redflag_count"),
        F.when(d % 11 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(d % 5 != 1, F.lit("because")).alias("rationale"))
    answer = F.when(d % 5 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("Here: "), F.to_json(body), F.lit(" done")))
    return dc.grade_validate(v.table(spark, sf, "labels").select("doc_id", answer.alias("response"))).select("doc_id", "error")


@query("grade_cache_lookup", """WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id)) SELECT doc_id, sha256(text) IN (SELECT h FROM c) AS reused FROM documents""")
def grade_cache_lookup(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.join(v.table(spark, sf, "labels"), "doc_id").select(F.sha2("text", 256).alias("content_sha256")).distinct()
    hit, work = dc.grade_cache_lookup(docs, cache)
    return hit.select("doc_id", F.lit(True).alias("reused")).unionByName(work.select("doc_id", F.lit(False).alias("reused")))


@query("depth_reports", "SELECT announcement_id, title, announced AS date FROM v_catalog WHERE regexp_matches(title, '修订|更正') AND announced <= DATE '1999-06-30'")
def depth_reports(spark, sf):
    reports = v.v_catalog(spark, sf).select("announcement_id", "title", F.col("announced").alias("date"), F.lit(None).cast("string").alias("attach_type"))
    return dc.depth_reports(reports, D(1999, 6, 30), "修订|更正").select("announcement_id", "title", "date")


@query("report_filename", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'zhongxinjt' WHEN 1 THEN 'haitong' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' ELSE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') END
      || '-' || regexp_replace(p_name, '\\s+', '-', 'g') || '-' || strftime(DATE '2020-01-01' + p_size, '%Y%m%d') || '.md' AS filename FROM part""")
def report_filename(spark, sf):
    day, nth = F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")), F.col("p_partkey") % 7
    broker = F.when(nth == 0, "中信建投证券").when(nth == 1, " 海通证券 ").when(nth == 2, "某券商").when(nth > 3, F.col("p_brand"))
    return v.table(spark, sf, "part").select("p_partkey", dc.report_filename(broker, F.col("p_name"), day).alias("filename"))


@query("classify_pages", """SELECT page_id, CASE WHEN page_id % 50 = 7 THEN 'broken_link' WHEN page_id % 50 = 8 THEN 'anti_bot' WHEN regexp_matches(html, '(?i)verify you are human|security check|captcha|安全检测') THEN 'anti_bot'
      WHEN regexp_matches(html, '(?i)please sign in|login required|请先?登录') THEN 'login_required' WHEN regexp_matches(html, '(?i)become a member|subscribe now|subscription required') THEN 'paywalled'
      WHEN regexp_matches(html, '(?i)page not found|<h1>404') THEN 'broken_link' WHEN contains(html, 'lang="en"') THEN 'reachable' ELSE 'unverified' END AS page_class FROM pages""")
def classify_pages(spark, sf):
    p = F.col("page_id")
    status = F.when(p % 50 == 7, 404).when(p % 50 == 8, 403).otherwise(200)
    return dc.classify_pages(v.v_page(spark, sf), status, F.lit('lang="en"')).select("page_id", "page_class")


@query("consecutive_batches", """WITH m AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS s FROM v_turn WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM m) SELECT conv_id, min(turn) AS first_turn, role, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, r, role""")
def consecutive_batches(spark, sf):
    return dc.consecutive_batches(v.v_turn(spark, sf))


@query("fiscal_year_extract", """SELECT announcement_id, CASE WHEN regexp_matches(title, '[0-9]{4}') THEN CAST(regexp_extract(title, '([0-9]{4})', 1) AS INTEGER) + CASE WHEN CAST(announcement_id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END END AS fiscal_year FROM v_catalog""")
def fiscal_year_extract(spark, sf):
    c = v.v_catalog(spark, sf)
    y = F.nullif(F.regexp_extract("title", r"(\d{4})", 1), F.lit("")).cast("int")
    ranged = F.concat(F.lit("Annual report "), y.cast("string"), F.lit("/"), F.substring((y + 1).cast("string"), 3, 2))
    title = F.when((F.col("announcement_id").cast("bigint") % 2 == 0) & y.isNotNull(), ranged).otherwise(F.col("title"))
    return c.select("announcement_id", dc.fiscal_year_extract(title).alias("fiscal_year"))


@query("report_period_end", """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN make_date(2010 + doc_id % 13, 12, 31) WHEN 1 THEN make_date(2010 + doc_id % 13, 3, 31) WHEN 2 THEN make_date(2010 + doc_id % 13, 6, 30)
    WHEN 3 THEN make_date(2010 + doc_id % 13, 12, 31) WHEN 4 THEN make_date(2010 + doc_id % 13, 12, 31) END AS period_end FROM documents""")
def report_period_end(spark, sf):
    d = F.col("doc_id")
    y, before = (2010 + d % 13).cast("string"), (2009 + d % 13).cast("string")
    # By turns: a day first, a month first, Chinese, several years with the years below, a year on the cover alone; another date, another context, no statement.
    forms = (
        (("Annual report\nFor the year ended 31 December ", y), ("Audited statements\n\nfor the year ended 31 December ", y)),
        (("Year ended March 31, ", y), ("Consolidated balance sheets\nfor the YEAR ENDED MARCH 31 ", y)),
        (("截至 ", y, " 年 6 月 30 日止年度"), ("综合财务报表\n截至", y, "年6月30日")),
        (("for the years ended December 31, ", before, " and ", y), ("Audited statements\nAs of December 31,\n", before, " ", y)),
        ((y, " Annual Report"), ("Audited statements\nyear ended 31 December ", y)),
        (("For the year ended 31 December ", y), ("Audited statements\nfor the year ended 30 June 2001",)),
        (("For the year ended 31 December ", y), ("Audited statements\nforecast for the year ended 31 December ", y)),
        (("For the year ended 31 December ", y), ("\n",)),
    )
    head, tail = (F.array(*(F.concat(*(F.lit(x) for x in form[i])) for form in forms))[d % 8] for i in (0, 1))
    text = F.concat(head, F.lit("\n\f" * 10), F.col("text"), F.lit("\n"), tail)
    return dc.report_period_end(v.table(spark, sf, "documents").select("doc_id", text.alias("text"))).select("doc_id", "period_end")
