"""Table contracts and their enforcement: one aggregate counts every kind of violation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.symbols import STRICT_SYMBOL_PATTERN, SYMBOL_PATTERN

# A source is a reader `(spark, start, end, ...) -> DataFrame` of one of these contracts: dates are
# inclusive and symbols canonical.
Source = Callable[..., DataFrame]


@dataclass(frozen=True)
class Contract:
    schema: T.StructType
    keys: tuple[str, ...]
    required: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    non_negative: tuple[str, ...] = ()


def schema_of(ddl: str) -> T.StructType:
    kinds = {"date": T.DateType(), "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
    fields = (item.split() for item in ddl.split(","))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Columns, keys and allowed values of the stored tables.
PRICES = Contract(
    schema_of(
        "date date, symbol string, open double, high double, low double, close double, close_hfq double, "
        "total_return double, volume bigint, amount double, turnover double, is_suspended boolean, is_st boolean, "
        "limit_up double, limit_down double, hit_limit_up boolean, hit_limit_down boolean"
    ),
    ("date", "symbol"), ("date", "symbol"), patterns={"symbol": SYMBOL_PATTERN}, non_negative=("volume",),
)
FUNDAMENTALS_KEYS = Contract(
    schema_of(
        "symbol string, report_date date, publication_date date, known_as_of date, statement_kind string, "
        "revenue double, net_income double, roe double, pe double, pb double, dividend_yield double, market_cap double"
    ),
    ("symbol", "report_date", "known_as_of", "statement_kind"),
    ("symbol", "report_date", "publication_date", "known_as_of", "statement_kind"),
    allowed={"statement_kind": ("preliminary", "audited", "restated")},
)
CALENDAR = Contract(
    schema_of("exchange string, date date, is_trading_day boolean"), ("exchange", "date"),
    ("exchange", "date", "is_trading_day"), allowed={"exchange": ("SH", "SZ", "HK")},
)
CORPORATE_ACTIONS = Contract(
    schema_of("symbol string, ex_date date, kind string, params_json string"), ("symbol", "ex_date", "kind"),
    ("symbol", "ex_date", "kind", "params_json"),
    allowed={"kind": ("cash_dividend", "stock_dividend", "rights_issue", "split", "reverse_split", "delisting")},
)
SIGNALS = Contract(
    schema_of("date date, symbol string, signal double"), ("date", "symbol"), ("date", "symbol"),
    patterns={"symbol": STRICT_SYMBOL_PATTERN},
)
WEIGHTS = Contract(
    schema_of("date date, symbol string, weight double"), ("date", "symbol"), ("date", "symbol", "weight"),
    patterns={"symbol": STRICT_SYMBOL_PATTERN},
)


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Exactly the contract's columns in its order and types; a value that does not convert becomes NULL."""
    unknown = sorted(set(df.columns) - set(contract.schema.names))
    missing = sorted(set(contract.schema.names) - set(df.columns))
    if unknown or missing:
        raise ValueError(f"columns do not match the contract: unknown {unknown}, missing {missing}")
    return df.select(*[
        F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in contract.schema
    ])


def row_rules(contract: Contract) -> dict[str, Column]:
    """Name of each per-row rule and the condition that breaks it."""
    rules = {f"null:{c}": F.col(c).isNull() for c in contract.required}
    rules |= {f"value:{c}": ~F.col(c).isin(list(ok)) for c, ok in contract.allowed.items()}
    rules |= {f"pattern:{c}": ~F.col(c).rlike(p) for c, p in contract.patterns.items()}
    rules |= {f"negative:{c}": F.col(c) < 0 for c in contract.non_negative}
    return rules


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, n) for every broken rule, duplicates of the key included; empty when the table is sound."""
    rules = row_rules(contract)
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules]))
    per_rule = counts.select(pairs.alias("r")).select("r.rule", "r.n")
    copies = df.groupBy(*contract.keys).count().where("count > 1")
    duplicates = copies.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("duplicate:key").alias("rule"), "n")
    return per_rule.unionByName(duplicates).where("n > 0")


def enforce_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """The coerced table, or an error naming the broken rules (one job over the table)."""
    out = coerce(df, contract)
    broken = violations(out, contract).collect()
    if broken:
        raise ValueError("contract broken: " + ", ".join(f"{r.rule} x{r.n}" for r in broken))
    return out


def split_rejects(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their broken rules)."""
    rules = row_rules(contract)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]
