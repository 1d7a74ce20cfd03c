"""Data contract of the aligned silver table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.functions.columns import require_columns


@dataclass(frozen=True)
class Rule:
    column: str
    type: str
    nullable: bool = True
    finite: bool = False
    non_negative: bool = False


# The silver table's contract.
SILVER_CONTRACT = (
    Rule("date", "date", nullable=False),
    Rule("region_id", "string", nullable=False),
    Rule("region_weight", "string"),
    Rule("temp_anom", "double", nullable=False, finite=True),
    Rule("precip_anom", "double", nullable=False, finite=True),
    Rule("ndvi", "double"),
    Rule("enso", "double"),
    Rule("prod_estimate", "double"),
    Rule("stocks", "double"),
    Rule("price_spot", "double", nullable=False),
    Rule("price_front_fut", "double", nullable=False),
    Rule("realized_vol_30d", "double", nullable=False, non_negative=True),
)


class ContractError(ValueError):
    """The table breaks its contract."""


def _violations(rule: Rule) -> dict[str, Column]:
    """Row conditions that break one column's rules."""
    raw = F.col(rule.column)
    value = raw.try_cast(rule.type)
    missing = value.isNull() | F.isnan(value) if rule.type == "double" else value.isNull()
    broken = {"type": raw.isNotNull() & value.isNull()}
    if not rule.nullable:
        broken["not_null"] = raw.isNull() | (raw.isNotNull() & missing & ~broken["type"])
    if rule.finite:
        broken["finite"] = ~missing & (F.abs(value) == F.lit(float("inf")))
    if rule.non_negative:
        broken["non_negative"] = ~missing & (value < 0)
    return broken


def contract_report(df: DataFrame, contract: tuple[Rule, ...] = SILVER_CONTRACT) -> DataFrame:
    """One row per column and rule with the number of failing rows, counted in a single pass."""
    require_columns(df.columns, [r.column for r in contract])
    checks = [(r.column, name, cond) for r in contract for name, cond in _violations(r).items()]
    counted = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)])
    rows = [
        F.struct(F.lit(column).alias("column"), F.lit(name).alias("rule"), F.col(f"c{i}").alias("failures"))
        for i, (column, name, _) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*rows)))


def coerce(df: DataFrame, contract: tuple[Rule, ...] = SILVER_CONTRACT) -> DataFrame:
    """Cast the contract's columns; text that does not fit becomes NULL.  Other columns stay."""
    types = {r.column: r.type for r in contract}
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def conforming(df: DataFrame, contract: tuple[Rule, ...] = SILVER_CONTRACT) -> DataFrame:
    """Rows that break no rule, coerced."""
    require_columns(df.columns, [r.column for r in contract])
    broken = [c for r in contract for c in _violations(r).values()]
    return coerce(df.where(~reduce(lambda a, b: a | b, broken)), contract)


def validate(df: DataFrame, contract: tuple[Rule, ...] = SILVER_CONTRACT) -> DataFrame:
    """Coerced table, or ContractError naming the broken rules.  The report has one row per rule."""
    failed = [r for r in contract_report(df, contract).collect() if r["failures"]]
    if failed:
        raise ContractError(", ".join(f"{r['column']}.{r['rule']}: {r['failures']}" for r in failed))
    return coerce(df, contract)
