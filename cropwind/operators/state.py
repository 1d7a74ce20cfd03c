"""Small state tables by which new weeks and days of a series are scored without its history.

A state holds one row per series: mergeable moments (count, mean, sum of squared deviations, extremes) for
z-scores, or the last daily rows for returns and volatility.  Merging the state of an increment takes one
grouped aggregate of two small tables; the rows behind the old state are not read again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.functions.columns import as_names
from cropwind.functions.numeric import relative_change
from cropwind.operators.market import VOL_MIN_RETURNS, VOL_ROWS, in_order, realized_vol

_PARTS = ("n", "mean", "m2", "low", "high")


def moments(df: DataFrame, values: Iterable[str], keys: str | Iterable[str]) -> DataFrame:
    """One row per series with a struct ``<value>`` of count, mean, squared deviations and extremes.

    NULL values are not counted; a series without any value has count 0 and NULL parts.
    """
    spread = lambda v: F.var_pop(v) * F.count(v)
    return df.groupBy(*as_names(keys)).agg(*[
        F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), spread(v).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high")).alias(v)
        for v in values
    ])


def _merged(a: Column, b: Column) -> Column:
    """Moments of both parts together; deviations are added around the new mean, which does not cancel."""
    n_a, n_b = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
    n, apart = n_a + n_b, b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        (a["mean"] + apart * n_b / n).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * (n_a * n_b / n)).alias("m2"),
        F.least(a["low"], b["low"]).alias("low"),
        F.greatest(a["high"], b["high"]).alias("high"),
    )
    return F.when(n_b == 0, F.coalesce(a, b)).when(n_a == 0, b).otherwise(both)


def merge_moments(old: DataFrame, new: DataFrame, values: Iterable[str], keys: str | Iterable[str]) -> DataFrame:
    """State of the rows of both states, which must not share rows; the order does not matter."""
    keys, values = as_names(keys), list(values)
    sides = old.select(*keys, *values, F.lit(0).alias("_side")).unionByName(new.select(*keys, *values, F.lit(1).alias("_side")))
    # One row a key and side, so the maximum is that row; NULL keys are a series like any other.
    side = lambda v, i: F.max(F.when(F.col("_side") == i, F.col(v))).alias(f"_{v}_{i}")
    paired = sides.groupBy(*keys).agg(*[side(v, i) for v in values for i in (0, 1)])
    return paired.select(*keys, *[_merged(F.col(f"_{v}_0"), F.col(f"_{v}_1")).alias(v) for v in values])


def zscore_from_state(df: DataFrame, state: DataFrame, values: Iterable[str], keys: str | Iterable[str]) -> DataFrame:
    """Add ``<value>_anom`` as :func:`cropwind.operators.anomalies.region_zscore` does, from a state.

    A constant series, or one without values, gets 0.0; a NULL value in a varying series stays NULL.
    """
    keys, values = as_names(keys), list(values)
    known = state.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(v).alias(f"_of_{v}") for v in values])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    scored = df.join(known, same, "left")

    def anomaly(v: str) -> Column:
        of = F.col(f"_of_{v}")
        deviation = F.sqrt(of["m2"] / of["n"])
        flat = deviation.isNull() | (of["low"] == of["high"]) | (deviation == 0)
        return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col(v) - of["mean"], deviation)).alias(f"{v}_anom")

    return scored.select(*df.columns, *[anomaly(v) for v in values])


def return_tail(daily: DataFrame, keys: str | Iterable[str] = "commodity", rows: int = VOL_ROWS) -> DataFrame:
    """The last ``rows`` days of each series as an array ``tail`` of date, last known close and return.

    ``daily`` has ``close`` and ``returns``, one row per series and day.
    """
    keys = as_names(keys)
    filled = daily.withColumn("close", F.last("close", ignorenulls=True).over(in_order(keys)))
    newest = in_order(keys).rowsBetween(0, rows)
    last = filled.withColumn("_left", F.count(F.lit(1)).over(newest)).where(F.col("_left") <= rows)
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "close", "returns"))).alias("tail"))


def late_series(tail: DataFrame, new: DataFrame, keys: str | Iterable[str] = "commodity") -> DataFrame:
    """Series with a new day that is not after their last one: these are derived from their whole history."""
    keys = as_names(keys)
    ends = tail.select(*keys, F.element_at("tail", -1)["date"].alias("_end"))
    first = new.groupBy(*keys).agg(F.min("date").alias("_first"))
    return first.join(ends, keys).where("_first <= _end").select(*keys)


def continued_returns(
    tail: DataFrame, new: DataFrame, keys: str | Iterable[str] = "commodity", rows: int = VOL_ROWS, min_returns: int = VOL_MIN_RETURNS
) -> tuple[DataFrame, DataFrame]:
    """(``new`` with ``returns`` and ``realized_vol_30d``, the tail after it).

    New days come after the tail of their series (see :func:`late_series`). Series without a tail begin here,
    and series without new days keep theirs.
    """
    keys = as_names(keys)
    old = tail.select(*keys, F.explode("tail").alias("_day")).select(*keys, "_day.date", "_day.close", "_day.returns", F.lit(True).alias("_old"))
    days = old.unionByName(new.select(*keys, "date", "close", F.lit(None).cast("double").alias("returns"), F.lit(False).alias("_old")))
    order = in_order(keys)
    known = days.withColumn("_known", F.last("close", ignorenulls=True).over(order))
    change = relative_change(F.col("_known"), F.lag("_known").over(order))
    returned = known.withColumn("returns", F.when(F.col("_old"), F.col("returns")).otherwise(change)).drop("_known")
    priced = realized_vol(returned, keys, rows, min_returns)
    return priced.where(~F.col("_old")).drop("_old"), return_tail(returned.drop("_old"), keys, rows)
