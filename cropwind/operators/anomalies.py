"""Standardised anomalies of weekly weather."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropwind.functions.calendar import season_of
from cropwind.functions.columns import as_names
from cropwind.operators.weekly import weekly_weather


def region_zscore(df: DataFrame, values: Iterable[str], keys: str | Iterable[str] = "region_id") -> DataFrame:
    """Add ``<value>_anom``: deviation from the key's whole-history mean in population deviations.

    A key that is constant or has no value at all gets 0.0 on every row; a NULL value in a
    varying key stays NULL.  The frame holds one row per key and week, so the window group is
    as long as the calendar; it shares its partitioning with the gap filling before it.
    """
    history = Window.partitionBy(*as_names(keys))
    anomalies = []
    for v in values:
        deviation = F.stddev_pop(v).over(history)
        # Equal extremes are a safer test than a rounded deviation of zero.
        constant = F.min(v).over(history) == F.max(v).over(history)
        z = F.try_divide(F.col(v) - F.avg(v).over(history), deviation)
        anomalies.append(F.when(deviation.isNull() | constant | (deviation == 0), F.lit(0.0)).otherwise(z).alias(f"{v}_anom"))
    return df.select("*", *anomalies)


def seasonal_zscore(
    df: DataFrame,
    value: str,
    keys: str | Iterable[str],
    date: str = "date",
    group_by: str = "weekofyear",
    season_col: str | None = None,
    ddof: int = 0,
    output: str | None = None,
) -> DataFrame:
    """Add the z-score of ``value`` within its key and season.

    The season is ``season_col`` if given, else the ISO week or the month of ``date``.
    A season without spread gives NULL.  With one row per key and week a group holds a few
    rows per year, and the input is read once.
    """
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    season = F.col(season_col) if season_col else season_of(date, group_by)
    peers = Window.partitionBy(*as_names(keys), season)
    deviation = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value).over(peers)
    # Equal extremes are a safer test for a season without spread than a rounded deviation of zero.
    varies = season.isNotNull() & (F.min(value).over(peers) != F.max(value).over(peers))
    z = F.when(varies, F.try_divide(F.col(value) - F.avg(value).over(peers), deviation))
    return df.select("*", z.alias(output or f"{value}_z"))


def weather_anomalies(daily: DataFrame, keys: str | Iterable[str] = "region_id") -> DataFrame:
    """Daily weather to the weekly anomaly table; ``ndvi`` and ``enso`` are 0.0 placeholders."""
    keys = as_names(keys)
    scored = region_zscore(weekly_weather(daily, keys), ["temp", "precip"], keys)
    return scored.select(
        "date", *keys, "temp_anom", "precip_anom", F.lit(0.0).alias("ndvi"), F.lit(0.0).alias("enso")
    )
