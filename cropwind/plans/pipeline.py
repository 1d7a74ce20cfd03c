"""The full run over landed data: silver tables, index, forecast, hedge, report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cropwind.operators import anomalies, climate, forecast, hedge, market, report, silver, weekly
from cropwind.plans import panels
from cropwind.sources.paths import written, written_together


@dataclass(frozen=True)
class Layers:
    """Gold tables of one run; the silver ones behind them are stored in the shared folder."""

    market: DataFrame
    index: DataFrame
    forecast: DataFrame
    hedge: DataFrame

    def kpis(self) -> DataFrame:
        return report.kpi_row(self.forecast, self.index, self.hedge)


def weather_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.weather_anomalies(panels.daily_weather(spark, sf_dir))


def market_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.weekly_market(panels.daily_market(spark, sf_dir))


def supply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.weekly_supply(panels.daily_supply(spark, sf_dir))


def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.global_index(weather_table(spark, sf_dir), panels.PANEL_CONFIG)


def stored_silver(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Weekly weather, market and supply, built side by side and stored."""
    return written_together(
        spark,
        weather=lambda: weather_table(spark, sf_dir),
        market=lambda: market_table(spark, sf_dir),
        supply=lambda: supply_table(spark, sf_dir),
    )


def aligned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.align_regions(*stored_silver(spark, sf_dir), config=panels.PANEL_CONFIG)


def stored_model_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weekly prices and index, stored: the model reads each of them more than once."""
    prices, index = written_together(
        spark, market=lambda: market_table(spark, sf_dir), index=lambda: index_table(spark, sf_dir)
    )
    return prices, index


def run_layers(
    market_weekly: DataFrame,
    index: DataFrame,
    as_of: dt.datetime,
    exposure: float = 10000.0,
    profiles: tuple[str, ...] = tuple(hedge.PROFILES),
    roles: tuple[str, ...] = hedge.ROLES,
) -> Layers:
    """Forecast and hedge every commodity; the forecast is stored as the hedge reads it twice."""
    path = written(forecast.market_model(market_weekly, index), "forecast")
    wanted = hedge.with_request_grid(hedge.latest_state(path, index), profiles, roles, exposure)
    return Layers(market_weekly, index, path, hedge.recommend(wanted, as_of))
