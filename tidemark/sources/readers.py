"""Scans, upserts and vendor normalisation. Every reader is `(spark, ...) -> DataFrame` with inclusive dates."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import latest_by
from tidemark.operators.pit import check_date_range

IN_LIST_LIMIT = 200
# The key of every stored table.
KEYS = {
    "prices": ("date", "symbol"),
    "fundamentals": ("symbol", "report_date", "known_as_of", "statement_kind"),
    "constituents": ("index_name", "symbol", "effective_from"),
    "calendar": ("exchange", "date"),
    "fx": ("pair", "date"),
    "sectors": ("symbol",),
    "corporate_actions": ("symbol", "ex_date", "kind"),
}


def scan(
    df: DataFrame, day: str, start: date, end: date, symbols: Sequence[str] | DataFrame | None = None, key: str = "symbol"
) -> DataFrame:
    """Date-range scan, optionally for some symbols: short lists are pushed to the scan, long ones semi-joined."""
    check_date_range(start, end)
    out = df.where(F.col(day).between(F.lit(start), F.lit(end)))
    if symbols is None:
        return out
    if isinstance(symbols, DataFrame):
        return out.join(symbols.select(key), key, "left_semi")
    if len(symbols) <= IN_LIST_LIMIT:
        return out.where(F.col(key).isin(list(symbols)))
    wanted = df.sparkSession.createDataFrame([(s,) for s in symbols], f"{key} string")
    return out.join(wanted, key, "left_semi")


def scan_fx(fx: DataFrame, pair: str, start: date, end: date) -> DataFrame:
    if pair != "CNY_HKD":
        raise ValueError(f"unsupported currency pair {pair!r}")
    return scan(fx.where(F.col("pair") == pair), "date", start, end)


def price_coverage(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def upsert_by_key(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`base` with the rows whose key is in `batch` replaced; columns are matched by name."""
    return base.join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)


def insert_or_ignore(base: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Append only unseen keys; inside a batch the greatest `order` wins."""
    fresh = latest_by(batch, keys, order).select(*batch.columns).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh)


def write_upsert(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], partition: str = "year"
) -> None:
    """Upsert a batch into parquet partitioned by `partition`, rewriting only the partitions it touches.

    The merged rows go to a staging folder of their own first, since a partition cannot be read while it is
    replaced. `partition` must be a function of the keys, or a key would stay in the partition it left.
    """
    try:
        base = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        batch.write.partitionBy(partition).mode("append").parquet(path)
        return
    touched = base.join(batch.select(partition).distinct(), partition, "left_semi")
    staging = f"{path.rstrip('/')}__staging-{uuid.uuid4()}"
    upsert_by_key(touched.select(*batch.columns), batch, keys).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.partitionBy(partition).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# --- vendor rows ------------------------------------------------------------------------------


def normalize_vendor_a(raw: DataFrame) -> DataFrame:
    """All-string vendor bars to typed bars: missing volume is zero, any status but '1' is a suspension."""
    return raw.select(
        F.expr("try_cast(date AS date)").alias("date"),
        F.col("symbol"),
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.expr("try_cast(volume AS double)"), F.lit(0.0)).cast("bigint").alias("volume"),
        F.expr("try_cast(amount AS double)").alias("amount"),
        F.expr("try_cast(turn AS double)").alias("turnover"),
        (F.coalesce(F.col("tradestatus"), F.lit("")) != "1").alias("is_suspended"),
        (F.coalesce(F.col("isST"), F.lit("")) == "1").alias("is_st"),
    )


# Headers of the Hong Kong vendor.
HK_HEADERS = {
    "日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close",
    "成交量": "volume", "成交额": "amount", "换手率": "turnover",
}


def normalize_vendor_hk(raw: DataFrame) -> DataFrame:
    """Chinese headers to contract names; turnover comes in percent, flags default to false."""
    out = raw.withColumnsRenamed(HK_HEADERS)
    return out.select(
        F.expr("try_cast(date AS date)").alias("date"),
        "symbol",
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(F.col("volume").cast("bigint"), F.lit(0)).alias("volume"),
        F.col("amount").cast("double").alias("amount"),
        (F.col("turnover").cast("double") / 100).alias("turnover"),
        F.lit(False).alias("is_suspended"),
        F.lit(False).alias("is_st"),
    )


def normalize_fx_fix(raw: DataFrame) -> DataFrame:
    """The official fix quotes 100 HKD; the table keeps CNY per HKD."""
    return raw.select("date", F.lit("CNY_HKD").alias("pair"), (F.col("fix_per_100") / 100).alias("cny_per_hkd"))


def extract_dividends(raw: DataFrame, start: date, end: date) -> DataFrame:
    """Vendor dividend strings to action rows; blank dates, non-numbers, non-positive cash and other dates drop."""
    cash = F.expr("try_cast(cash AS double)")
    day = F.expr("try_cast(ex_date AS date)")
    return raw.where((cash > 0) & day.between(F.lit(start), F.lit(end))).select(
        "symbol",
        day.alias("ex_date"),
        F.lit("cash_dividend").alias("kind"),
        F.to_json(F.struct(cash.alias("amount_per_share"))).alias("params_json"),
    )


# --- files ------------------------------------------------------------------------------------


def index_filings(files: DataFrame) -> DataFrame:
    """(path[, text]) to filing rows from the path alone: `<symbol>/年报-YYYY.md`, `<symbol>/招股说明书.md`,
    `<symbol>/research/*YYYYMMDD.md`; other paths are not filings."""
    p = F.col("path")
    name = F.element_at(F.split(p, "/"), -1)
    annual = F.regexp_extract(name, r"^年报-(\d{4})\.md$", 1)
    report = F.regexp_extract(p, r"/research/[^/]*?(\d{8})\.md$", 1)
    kind = (
        F.when(annual != "", F.lit("annual"))
        .when(name.rlike(r"^招股说明书.*\.md$"), F.lit("ipo"))
        .when(report != "", F.lit("research"))
    )
    return files.select(
        F.regexp_extract(p, r"([0-9A-Za-z]+\.(?:SH|SZ|HK))/", 1).alias("symbol"),
        kind.alias("kind"),
        F.expr("try_cast(" + "nullif(regexp_extract(element_at(split(path, '/'), -1), '^年报-([0-9]{4})[.]md$', 1), '') AS int)").alias("year"),
        F.regexp_replace(name, r"\.md$", "").alias("title"),
        F.try_to_date(F.nullif(report, F.lit("")), "yyyyMMdd").alias("date"),
        "path",
    ).where(F.col("kind").isNotNull() & (F.col("symbol") != ""))


def index_profiles(files: DataFrame) -> DataFrame:
    """`<symbol>-YYYY-MM-DD.md`; evaluation files are not profiles."""
    pattern = r"([0-9A-Za-z]+\.(?:SH|SZ|HK))-(\d{4}-\d{2}-\d{2})\.md$"
    p = F.col("path")
    return files.where(p.rlike(pattern) & ~p.endswith("-evaluation.md")).select(
        F.regexp_extract(p, pattern, 1).alias("symbol"),
        F.try_to_date(F.regexp_extract(p, pattern, 2)).alias("date"),
        "path",
    )


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Markdown tree as (path, text), one row per file."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


TURN_SCHEMA = T.StructType([
    T.StructField("_meta", T.StringType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def parse_turns(lines: DataFrame) -> DataFrame:
    """JSONL lines (`line`, keys kept) to turns; the header line and blank lines are not turns."""
    rest = [c for c in lines.columns if c != "line"]
    parsed = lines.where(F.trim("line") != "").select(*rest, F.from_json("line", TURN_SCHEMA).alias("t"))
    return parsed.where(F.col("t._meta").isNull()).select(*rest, "t.turn", "t.role", "t.text")


def parse_universe(payloads: DataFrame) -> DataFrame:
    """(id, payload): a JSON map of signals, a JSON list or lines of symbols, to (id, symbol, signal). A payload that
    cannot be read gives one row with a null symbol, an empty one none."""
    p = F.trim("payload")
    as_map = F.from_json(p, "map<string,double>")
    listed = F.when(p.startswith("["), F.from_json(p, "array<string>")).otherwise(
        F.filter(F.transform(F.split(p, r"\n"), lambda s: F.trim(s)), lambda s: s != "")
    )
    unit = F.map_from_arrays(F.array_distinct(listed), F.transform(F.array_distinct(listed), lambda _: F.lit(1.0)))
    read = payloads.select("id", F.when(p.startswith("{"), as_map).otherwise(unit).alias("_read"))
    rows = read.select("id", F.col("_read").isNull().alias("_broken"), F.explode_outer("_read").alias("symbol", "signal"))
    return rows.where(F.col("symbol").isNotNull() | F.col("_broken")).drop("_broken")


def export_records(df: DataFrame, keys: Sequence[str], name: str = "record") -> DataFrame:
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))
