"""Landed raw files: weather payloads, quotes with odd close columns, supply."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropwind.functions.calendar import parse_date
from cropwind.functions.columns import as_names, quoted
from cropwind.functions.numeric import null_if_nan
from cropwind.operators.grouped import LANDED, is_scan, keep_last, landed

PAYLOAD_SCHEMA = (
    "daily struct<time: array<string>, temperature_2m_mean: array<double>, precipitation_sum: array<double>>"
)


def flatten_weather(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per day of each JSON payload; the other columns are repeated.

    A payload that is broken, has no ``daily`` part, lacks a series or has series of unequal
    length yields no rows.
    """
    others = [c for c in payloads.columns if c != payload]
    daily = F.from_json(F.col(payload), PAYLOAD_SCHEMA)["daily"]
    parsed = payloads.select(
        *others,
        daily["time"].alias("_t"),
        daily["temperature_2m_mean"].alias("_temp"),
        daily["precipitation_sum"].alias("_precip"),
    ).where((F.size("_t") == F.size("_temp")) & (F.size("_t") == F.size("_precip")))
    rows = parsed.select(*others, F.inline(F.arrays_zip("_t", "_temp", "_precip")))
    return rows.select(
        *others,
        parse_date("_t").alias("date"),
        null_if_nan("_temp").alias("temp"),
        null_if_nan("_precip").alias("precip"),
    )


def weather_files(spark: SparkSession, path: str) -> DataFrame:
    """Payload files named ``<region>.json`` to daily weather rows."""
    files = landed(spark.read.text(path, wholetext=True)).select(
        F.regexp_extract(F.col(LANDED)["file"], r"^([^.]+)\.", 1).alias("region_id"),
        F.col("value").alias("payload"),
        LANDED,
    )
    return flatten_weather(files)


def normalised_name(name: str | Iterable[str]) -> str:
    """Lower case with underscores; parts of a multi-level name are joined, empty ones left out."""
    flat = name if isinstance(name, str) else "_".join(str(part) for part in name if part not in ("", None))
    return flat.strip().lower().replace(" ", "_")


def pick_close(columns: Iterable[str]) -> str:
    """The column that holds the close: an adjusted close before a plain one, and in each group
    the exact name before the first match."""
    named = {}
    for column in columns:
        named.setdefault(normalised_name(column), column)
    for wanted in ("adj_close", "close"):
        matches = [n for n in named if wanted in n]
        if matches:
            return named[wanted if wanted in matches else matches[0]]
    raise KeyError(f"no close-like column; available: {list(named)}")


def daily_close(
    quotes: DataFrame, commodity: str | None = None, date: str = "date", order: str | None = None
) -> DataFrame:
    """Raw quotes to ``commodity, date, close`` with one row per day, the last one landed.

    ``order`` names the column that says which row is later; without it ``quotes`` must come
    straight from files, whose landing order decides.
    """
    return latest_close(dated_close(quotes, commodity, date, order))


def dated_close(
    quotes: DataFrame, commodity: str | None = None, date: str = "date", order: str | None = None
) -> DataFrame:
    """Raw quotes of one header to ``commodity, date, close`` and their order."""
    name = F.col("commodity") if commodity is None else F.lit(commodity)
    close = null_if_nan(F.col(quoted(pick_close(quotes.columns))).cast("double"))
    return _ordered(quotes, order).select(
        F.lower(name).alias("commodity"), parse_date(F.col(quoted(date))).alias("date"), close.alias("close"), LANDED
    )


def latest_close(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("date").isNotNull())
    return keep_last(rows, ["commodity", "date"], [LANDED, "close"]).drop(LANDED)


def one_row_per_day(daily: DataFrame, keys: str | Iterable[str], order: str | None = None) -> DataFrame:
    """Reduce landed rows to the last one of each key and day."""
    tagged = _ordered(daily, order).where(F.col("date").isNotNull())
    values = F.struct(*[quoted(c) for c in tagged.columns if c != LANDED])
    return keep_last(tagged, [*as_names(keys), "date"], [LANDED, values]).drop(LANDED)


def _ordered(rows: DataFrame, order: str | None) -> DataFrame:
    if order is not None:
        return rows.withColumn(LANDED, F.col(quoted(order)))
    if LANDED in rows.columns:
        return rows
    if not is_scan(rows):
        raise ValueError("rows that do not come straight from files need an order column")
    return landed(rows)
