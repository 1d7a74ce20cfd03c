"""Daily rows to a gap-free Friday-weekly panel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropwind.functions.calendar import week_label
from cropwind.functions.columns import as_names


def _last_value(name: str, date: str) -> Column:
    """Latest non-NULL value of the week."""
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(date)))


def weekly_panel(
    daily: DataFrame,
    keys: str | Iterable[str],
    how: Mapping[str, str],
    date: str = "date",
    fill_gaps: bool = True,
) -> DataFrame:
    """Aggregate daily rows per key and week.

    ``how`` maps each value column to ``mean``, ``sum`` or ``last``.  NULLs are skipped;
    a week without values gives a NULL mean or last and a zero sum.  With ``fill_gaps``
    every week between a key's first and last one is present.
    """
    keys = as_names(keys)
    build = {
        "mean": lambda c: F.avg(c),
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
        "last": lambda c: _last_value(c, date),
    }
    unknown = sorted(set(how.values()) - set(build))
    if unknown:
        raise ValueError(f"unknown aggregation {unknown}; use one of {sorted(build)}")
    # The label goes in under a temporary name: 'last' still needs the day itself.
    weekly = (
        daily.where(F.col(date).isNotNull())
        .withColumn("_week", week_label(date))
        .groupBy(*keys, "_week")
        .agg(*[build[kind](name).alias(name) for name, kind in how.items()])
        .withColumnRenamed("_week", date)
        .select(date, *keys, *how)
    )
    if not fill_gaps:
        return weekly
    return fill_week_gaps(weekly, keys, zero=[c for c, kind in how.items() if kind == "sum"], date=date)


def fill_week_gaps(
    weekly: DataFrame, keys: str | Iterable[str], zero: Iterable[str] = (), date: str = "date"
) -> DataFrame:
    """Insert the missing weeks of each key: ``zero`` columns get 0.0, all others NULL.

    The input must hold one row per key and week, so a window group is as long as the
    calendar (784 rows for 15 years), whatever the number of raw rows behind it.  Each row
    spans the weeks up to the next one, which needs no calendar table and no join.
    """
    keys, zero = as_names(keys), set(zero)
    values = [c for c in weekly.columns if c not in keys and c != date]
    ordered = Window.partitionBy(*keys).orderBy(date)
    last_covered = F.coalesce(F.date_sub(F.lead(date).over(ordered), 7), F.col(date))
    spread = weekly.withColumn("_end", last_covered).withColumn(
        "_week", F.explode(F.sequence(F.col(date), F.col("_end"), F.expr("interval 7 days")))
    )
    own = F.col("_week") == F.col(date)
    return spread.select(
        F.col("_week").alias(date),
        *keys,
        *[F.when(own, F.col(c)).otherwise(F.lit(0.0) if c in zero else F.lit(None)).alias(c) for c in values],
    ).select(*weekly.columns)


def weekly_weather(daily: DataFrame, keys: str | Iterable[str] = "region_id", fill_gaps: bool = True) -> DataFrame:
    """Weekly mean temperature and total precipitation."""
    return weekly_panel(daily, keys, {"temp": "mean", "precip": "sum"}, fill_gaps=fill_gaps)


def weekly_supply(
    daily: DataFrame, keys: str | Iterable[str] = "region_id", data_source: str = "landed", fill_gaps: bool = True
) -> DataFrame:
    """Weekly mean production estimate and stocks."""
    panel = weekly_panel(daily, keys, {"prod_estimate": "mean", "stocks": "mean"}, fill_gaps=fill_gaps)
    return panel.withColumn("data_source", F.lit(data_source))
