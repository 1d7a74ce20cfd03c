"""Calendar expressions.  A week is labelled by the Friday that ends it."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropwind.functions.columns import ColumnLike, as_column

SEASONS = ("weekofyear", "month")


def parse_date(value: ColumnLike) -> Column:
    """UTC calendar day of a text, date or timestamp; what is no date becomes NULL.

    A text without an offset is taken as UTC already; one with an offset is shifted.
    """
    text = as_column(value).cast("string")
    moment = F.try_to_timestamp(text)
    with_offset = text.rlike(r":.*(Z|[+-]\d{1,2}(:?\d{2})?)$")
    return F.when(with_offset, F.to_date(F.to_utc_timestamp(moment, F.current_timezone()))).otherwise(F.to_date(moment))


def week_label(day: ColumnLike) -> Column:
    """The Friday on or after ``day``."""
    return F.next_day(F.date_sub(F.to_date(as_column(day)), 1), "FRI")


def season_of(day: ColumnLike, group_by: str = "weekofyear") -> Column:
    """ISO week number or month number of ``day``."""
    if group_by not in SEASONS:
        raise ValueError(f"group_by must be one of {SEASONS}, got {group_by!r}")
    return F.weekofyear(as_column(day)) if group_by == "weekofyear" else F.month(as_column(day))


def last_thursday(day: ColumnLike) -> Column:
    """The Thursday on or before ``day`` (weekday() counts Monday as 0)."""
    day = as_column(day)
    return F.date_sub(day, F.pmod(F.weekday(day) - 3, F.lit(7)))


def forecast_date(last: ColumnLike, step: ColumnLike, anchor: str = "SUN") -> Column:
    """Label of forecast step 1, 2, ... after the last observed day.

    The first anchor day on or after ``last`` is skipped, so step 1 lies one week
    beyond it: after Friday 2024-01-05 the Sundays start at 2024-01-14.
    """
    first = F.next_day(F.date_sub(as_column(last), 1), anchor)
    return F.date_add(first, (as_column(step) * 7).cast("int"))


def weekly_steps(horizon_days: ColumnLike) -> Column:
    """Whole weeks in a horizon of days, at least one."""
    return F.greatest(F.lit(1), F.floor(as_column(horizon_days) / 7).cast("int"))


def months_before(day: ColumnLike, months: int) -> Column:
    return F.add_months(as_column(day), -months)


def scope_ends(end: dt.date, years: int = 15) -> tuple[dt.date, dt.date]:
    """First and last day of the scope that :func:`rolling_scope` tests."""
    last = calendar.monthrange(end.year - years, end.month)[1]
    return dt.date(end.year - years, end.month, min(end.day, last)), end


def rolling_scope(day: ColumnLike, end: dt.date, years: int = 15) -> Column:
    """True for days in the ``years`` up to and including ``end``."""
    day = as_column(day)
    return (day >= F.add_months(F.lit(end), -12 * years)) & (day <= F.lit(end))
