"""Series and figures behind the report: KPIs, bands, histories, summary tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropwind.functions.calendar import months_before
from cropwind.functions.columns import as_names
from cropwind.functions.numeric import percent_change
from cropwind.functions.text import capitalised, fixed, grouped, same_text
from cropwind.operators.design import RISK
from cropwind.operators.grouped import keep_first
from cropwind.operators.market import price_column

# Price columns in order of choice.
REPORT_PRICES = ("price_spot", "price_front_fut", "settlement", "close")


def _last(value: Column, date: str = "date") -> Column:
    """Value of the last row as a struct ``v``, so that a NULL there stays NULL."""
    return F.max_by(F.struct(value.alias("v")), F.col(date))


def _first(value: Column, date: str = "date") -> Column:
    return F.min_by(F.struct(value.alias("v")), F.col(date))


def kpi_row(forecast: DataFrame, index: DataFrame, hedge: DataFrame) -> DataFrame:
    """One row per commodity: last forecast, risk, hedge totals, scenario, forecast change in %.

    The change needs two forecast rows and a first price other than 0.  Ratio and scenario
    come from the first hedge by profile and role.
    """
    price = forecast.groupBy("commodity").agg(
        _last(F.col("price_forecast"))["v"].alias("latest_forecast_price"),
        _first(F.col("price_forecast"))["v"].alias("_first_price"),
        F.count("*").alias("_n"),
    )
    change = F.when(F.col("_n") >= 2, percent_change("latest_forecast_price", "_first_price"))
    price = price.select("commodity", "latest_forecast_price", change.alias("forecast_change_pct"))
    level = F.col("risk") * 100.0 if "risk" in index.columns else F.col(RISK)
    risk = index.groupBy("commodity").agg(_last(level)["v"].alias("risk_score"))
    leading = F.min_by(F.struct("hedge_ratio", "scenario"), F.struct("profile", "role"))
    hedged = hedge.groupBy("commodity").agg(
        F.sum("hedge_notional").alias("hedge_notional"), leading.alias("_lead"), F.count("*").alias("hedge_legs")
    )
    hedged = hedged.select("commodity", "hedge_notional", "_lead.hedge_ratio", "_lead.scenario", "hedge_legs")
    return price.join(risk, "commodity", "full_outer").join(hedged, "commodity", "full_outer")


def forecast_band_series(forecast: DataFrame) -> DataFrame:
    """Points of the price chart with its band."""
    return forecast.select("commodity", "date", "price_forecast", "price_lo95", "price_hi95")


def pct_band_series(forecast: DataFrame, keys: str | Iterable[str] = "commodity") -> DataFrame:
    """Forecast and band as % change on the last forecast price; dropped where that is NULL or 0."""
    keys = as_names(keys)
    last = _last(F.col("price_forecast")).over(Window.partitionBy(*keys))
    based = forecast.withColumn("_base", last["v"]).where(F.col("_base") != 0)
    return based.select(
        *keys,
        "date",
        percent_change("price_forecast", "_base").alias("ret_pct"),
        percent_change("price_lo95", "_base").alias("ret_lo95"),
        percent_change("price_hi95", "_base").alias("ret_hi95"),
    )


def padded_domain(
    df: DataFrame, values: Iterable[str], pad: float = 0.05, flat: float = 1.0, keys: str | Iterable[str] = "commodity"
) -> DataFrame:
    """Axis range over all ``values``: extremes plus ``pad`` of their distance on each side.

    A flat series is first widened by ``flat`` both ways.
    """
    keys, values = as_names(keys), list(values)
    spread = (lambda f, xs: f(*xs) if len(xs) > 1 else xs[0])
    columns = [F.col(v) for v in values]
    bounds = df.groupBy(*keys).agg(
        F.min(spread(F.least, columns)).alias("_lo"), F.max(spread(F.greatest, columns)).alias("_hi")
    )
    is_flat = F.col("_lo") == F.col("_hi")
    widened = bounds.select(
        *keys,
        F.when(is_flat, F.col("_lo") - flat).otherwise(F.col("_lo")).alias("_lo"),
        F.when(is_flat, F.col("_hi") + flat).otherwise(F.col("_hi")).alias("_hi"),
    )
    margin = (F.col("_hi") - F.col("_lo")) * pad
    return widened.select(*keys, (F.col("_lo") - margin).alias("domain_min"), (F.col("_hi") + margin).alias("domain_max"))


def forecast_domain(forecast: DataFrame) -> DataFrame:
    return padded_domain(forecast, ["price_forecast", "price_lo95", "price_hi95"])


def pct_domain(pct: DataFrame) -> DataFrame:
    return padded_domain(pct, ["ret_pct", "ret_lo95", "ret_hi95"], pad=0.10, flat=0.1)


def trailing_window(df: DataFrame, window: str, keys: str | Iterable[str] = "commodity", date: str = "date") -> DataFrame:
    """Rows of the last months before each series' last date: ``12M``, ``24M``, ``All``.

    A label that is not understood returns the input.
    """
    number = window.replace("M", "")
    if window == "All" or not number.lstrip("+-").isdigit():
        return df
    dated = df.withColumn("_last", F.max(date).over(Window.partitionBy(*as_names(keys))))
    return dated.where(F.col(date) >= months_before("_last", int(number))).select(*df.columns)


def price_history(market: DataFrame, window: str = "12M", commodity: str | None = None) -> DataFrame:
    """Price series of the report in its window."""
    chosen = market if commodity is None else market.where(same_text("commodity", commodity))
    price = price_column(chosen.columns, REPORT_PRICES)
    return trailing_window(chosen, window).select("commodity", "date", F.col(price).alias("price"))


def price_history_dedup(market: DataFrame, order: Iterable[str | Column], commodity: str | None = None) -> DataFrame:
    """First priced row per commodity and date, ``order`` deciding which is first."""
    chosen = market if commodity is None else market.where(same_text("commodity", commodity))
    priced = chosen.dropna(subset=["date", "price_spot"])
    return keep_first(priced, ["commodity", "date"], order)


def risk_history(index: DataFrame, window: str = "12M") -> DataFrame:
    """Risk series of the report: ``risk`` where it exists, else the 0-100 index."""
    value = "risk" if "risk" in index.columns else RISK
    return trailing_window(index.select("commodity", "date", F.col(value).alias("risk_value")), window)


def hedge_summary_table(hedge: DataFrame) -> DataFrame:
    """Label and text rows of each recommendation, in report order."""
    # The labels.
    lines = [
        ("Profile", capitalised("profile")),
        ("Role", capitalised("role")),
        ("Scenario", capitalised("scenario")),
        ("Risk Score", F.concat(fixed("risk_score", 1), F.lit(" / 100"))),
        ("Forecast Horizon", F.concat(F.col("forecast_horizon_weeks").cast("string"), F.lit(" weeks"))),
        ("Exposure", F.concat(grouped("exposure"), F.lit(" USD"))),
        ("Suggested Hedge Ratio", F.concat(fixed(F.col("hedge_ratio") * 100, 1), F.lit("%"))),
        ("Hedge Notional", F.concat(grouped("hedge_notional"), F.lit(" units"))),
        ("Instrument", capitalised("instrument")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), text.alias("value"))
            for i, (label, text) in enumerate(lines, 1)
        ]
    )
    return hedge.select("commodity", "profile", "role", F.inline(rows))


def hedge_detail_table(hedge: DataFrame) -> DataFrame:
    """Field and value rows of each recommendation as the dashboard lists them."""
    # The labels.
    fields = [
        ("Commodity", "commodity"),
        ("Profile", "profile"),
        ("Role", "role"),
        ("Exposure", "exposure"),
        ("Hedge notional", "hedge_notional"),
        ("Instrument", "instrument"),
        ("Maturity", "instrument_maturity"),
        ("Strike", "instrument_strike"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("label"),
                F.coalesce(F.col(name).cast("string"), F.lit("–")).alias("value"),
            )
            for i, (label, name) in enumerate(fields, 1)
        ]
    )
    return hedge.select(
        F.col("commodity"), F.col("profile"), F.col("role"), F.inline(rows)
    )
