"""Numeric expressions.  NaN is turned into NULL at the sources; only NULL travels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropwind.functions.columns import ColumnLike, as_column

TRADING_DAYS = 252


def null_if_nan(x: ColumnLike) -> Column:
    x = as_column(x)
    return F.when(~F.isnan(x), x)


def logistic_scale(
    x: ColumnLike, a: float = 1.0, b: float = 0.0, lower: float = 0.0, upper: float = 100.0
) -> Column:
    """Map a signal onto (lower, upper); ``b`` is the midpoint, ``a`` the steepness."""
    return F.lit(lower) + F.lit(upper - lower) / (F.lit(1.0) + F.exp((as_column(x) - F.lit(b)) * F.lit(-a)))


def clamp(x: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    """Bound ``x``; NULL stays NULL (greatest and least alone would skip it)."""
    x = as_column(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def relative_change(now: ColumnLike, base: ColumnLike) -> Column:
    """``now / base - 1``; NULL when the base is zero or NULL."""
    return F.try_divide(as_column(now), as_column(base)) - F.lit(1.0)


def percent_change(now: ColumnLike, base: ColumnLike) -> Column:
    return relative_change(now, base) * F.lit(100.0)


def log_ratio(now: ColumnLike, before: ColumnLike) -> Column:
    """``ln(now / before)`` for positive prices, NULL otherwise."""
    now, before = as_column(now), as_column(before)
    return F.when((now > 0) & (before > 0), F.ln(now / before))


def annualised(daily_std: ColumnLike) -> Column:
    return as_column(daily_std) * F.lit(math.sqrt(TRADING_DAYS))


def season_sine(t: ColumnLike, period: int) -> Column:
    return F.sin(as_column(t) * F.lit(2.0 * math.pi / period))


def season_cosine(t: ColumnLike, period: int) -> Column:
    return F.cos(as_column(t) * F.lit(2.0 * math.pi / period))
