"""A deterministic test market, drawn from seeded hashes. Only tests use it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.timeseries import date_spine


def unit(seed: int, *columns: str) -> Column:
    """Uniform number in [0, 1) from a hash of the row's keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_003)) / 1_000_003


def synthetic_market(spark: SparkSession, symbols: list[str], start: date, end: date, seed: int = 42) -> dict[str, DataFrame]:
    """Weekday calendar, random-walk bars, preliminary and audited quarterly facts, dividends."""
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string").withColumns({"_a": F.lit(start), "_b": F.lit(end)})
    grid = date_spine(names, "_a", "_b", "B").select("symbol", "date")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    close = 20 * F.exp(F.sum((unit(seed, "symbol", "date") - 0.5) * 0.04).over(w))
    bars = grid.withColumn("close", close).withColumn("volume", (1000 + unit(seed + 1, "symbol", "date") * 9000).cast("bigint"))
    bars = bars.select("date", "symbol", (F.col("close") * 0.999).alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", "volume", (F.col("close") * F.col("volume")).alias("amount"))
    quarters = names.select("symbol", F.explode(F.sequence(F.trunc("_a", "quarter"), F.col("_b"), F.expr("interval 3 months"))).alias("_q"))
    versions = F.explode(F.array(F.struct(F.lit("preliminary").alias("kind"), F.lit(30).alias("lag")), F.struct(F.lit("audited").alias("kind"), F.lit(60).alias("lag"))))
    quarters = quarters.select("symbol", F.date_sub("_q", 1).alias("report_date"), versions.alias("_v"))
    published = F.date_add("report_date", F.col("_v.lag"))
    u = unit(seed + 2, "symbol", "report_date")
    facts = quarters.select("symbol", "report_date", published.alias("publication_date"), published.alias("known_as_of"), F.col("_v.kind").alias("statement_kind"),
                            (5 + u * 30).alias("pe"), (0.5 + u * 4).alias("pb"), (unit(seed + 3, "symbol", "report_date") * 0.06).alias("dividend_yield"))
    actions = names.select("symbol", F.explode(F.sequence("_a", "_b", F.expr("interval 6 months"))).alias("ex_date")).select(
        "symbol", "ex_date", F.lit("cash_dividend").alias("kind"), (0.1 + unit(seed + 4, "symbol", "ex_date")).alias("amount"))
    members = names.select(F.lit("IDX").alias("index_name"), "symbol", F.col("_a").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    sectors = names.select("symbol", F.concat(F.lit("S"), F.pmod(F.xxhash64("symbol"), F.lit(3)).cast("string")).alias("sector_l1"), F.lit("x").alias("sector_l2"))
    return {"prices": bars, "fundamentals": facts, "corporate_actions": actions, "constituents": members, "sectors": sectors}
