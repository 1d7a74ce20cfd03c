"""Returns, realised volatility and the weekly market table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cropwind.functions.columns import as_names, require_columns
from cropwind.functions.numeric import annualised, log_ratio, relative_change
from cropwind.operators.weekly import weekly_panel

VOL_ROWS = 30
VOL_MIN_RETURNS = 10


def in_order(keys: str | Iterable[str], date: str = "date") -> WindowSpec:
    """Row order of each series.

    Used only on frames with one row per key and date, so a group is bounded by the
    calendar: 5,479 daily or 784 weekly rows in 15 years.
    """
    return Window.partitionBy(*as_names(keys)).orderBy(date)


def daily_returns(daily: DataFrame, keys: str | Iterable[str] = "commodity", close: str = "close") -> DataFrame:
    """Add ``returns``: change on the last known close, so a NULL close counts as unchanged."""
    order = in_order(keys)
    known = daily.withColumn("_known", F.last(close, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    change = relative_change(F.col("_known"), F.lag("_known").over(order))
    return known.withColumn("returns", change).drop("_known")


def realized_vol(
    daily: DataFrame,
    keys: str | Iterable[str] = "commodity",
    rows: int = VOL_ROWS,
    min_returns: int = VOL_MIN_RETURNS,
    output: str = "realized_vol_30d",
) -> DataFrame:
    """Add the annualised sample deviation of ``returns`` over the last ``rows`` rows."""
    frame = in_order(keys).rowsBetween(-(rows - 1), 0)
    enough = F.count("returns").over(frame) >= min_returns
    return daily.withColumn(output, F.when(enough, annualised(F.stddev_samp("returns").over(frame))))


def weekly_market(
    daily: DataFrame, keys: str | Iterable[str] = "commodity", data_source: str = "landed", fill_gaps: bool = True
) -> DataFrame:
    """Daily closes to the weekly market table; the front future is the spot price."""
    keys = as_names(keys)
    priced = realized_vol(daily_returns(daily, keys), keys)
    weekly = weekly_panel(priced, keys, {"close": "last", "realized_vol_30d": "last"}, fill_gaps=fill_gaps)
    return weekly.select(
        "date",
        *keys,
        F.col("close").alias("price_spot"),
        F.col("close").alias("price_front_fut"),
        "realized_vol_30d",
        F.lit(data_source).alias("data_source"),
    )


def price_column(columns: Iterable[str], preferred: Iterable[str] = ("price_spot", "price_front_fut")) -> str:
    """First preferred price column that exists (by name, not row by row)."""
    columns = list(columns)
    for name in preferred:
        if name in columns:
            return name
    raise KeyError(f"none of {list(preferred)} found; available: {columns}")


def log_returns(df: DataFrame, price: str, keys: str | Iterable[str] = "commodity", output: str = "y") -> DataFrame:
    """Add the weekly log return; a NULL or non-positive price blanks its own and the next week."""
    require_columns(df.columns, [price])
    return df.withColumn(output, log_ratio(F.col(price), F.lag(price).over(in_order(keys))))
