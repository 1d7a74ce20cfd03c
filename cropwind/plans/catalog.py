"""Registered queries: each one runs over whole tables and, where SQL can say it, has a twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropwind.functions.calendar import parse_date, rolling_scope
from cropwind.operators import (
    anomalies,
    climate,
    design,
    forecast,
    hedge,
    market,
    quality,
    regression,
    report,
    silver,
    state,
    weekly,
)
from cropwind.plans import panels, pipeline, runs
from cropwind.plans.oracle import EXOG, LEGACY, TWO_LAGS, WEEKLY, day, r, rationale, rounded, sql, week, whole
from cropwind.sources import audit, config, landing, tables
from cropwind.sources.config import unknown_keys
from cropwind.sources.paths import folder_moved, leaf_folders, scratch_path, written, written_together
from cropwind.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = dt.datetime(2025, 1, 1)


def _register(select: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if select is not None:
            ORACLES[query.__name__] = sql(select)
        return query

    return add


def present(df: DataFrame, digits: Mapping[str, int] | None = None) -> DataFrame:
    """Output form of every query: doubles rounded (see ``rounded``), days as text."""
    digits = digits or {}
    columns = []
    for name, kind in df.dtypes:
        value = f"`{name}`"
        if kind == "double":
            value = rounded(value, digits.get(name))
        elif kind == "date":
            value = f"date_format({value}, 'yyyy-MM-dd')"
        elif kind == "int":
            value = f"CAST({value} AS BIGINT)"
        columns.append(f"{value} AS `{name}`")
    return df.selectExpr(*columns)


# Weekly panels -------------------------------------------------------------------------------


@_register(f"SELECT station_id, {day()}, {r('temp')}, {r('precip')} FROM weekly_station")
def weekly_weather_gapfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's weeks, with the ones without rows filled in."""
    return present(weekly.weekly_weather(panels.daily_station_weather(spark, sf_dir), "station_id"))


@_register(f"SELECT region_id, {day()}, {r('prod_estimate')}, {r('stocks')}, 'landed' AS data_source FROM weekly_supply")
def weekly_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(pipeline.supply_table(spark, sf_dir))


_MARKET = f"""SELECT commodity, {day()}, {r('price_spot')}, {r('price_spot', name='price_front_fut')},
       {r('realized_vol_30d')}, 'landed' AS data_source FROM market"""
_INDEX = f"SELECT commodity, {day()}, {r('global_risk_0_100')} FROM risk_index"


@_register(_MARKET)
def weekly_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(pipeline.market_table(spark, sf_dir))


@_register(f"SELECT vendor_id, {day()}, {r('price_spot')}, {r('realized_vol_30d')} FROM vendor_market")
def vendor_weekly_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price series per supplier, with weeks without a price."""
    panel = market.weekly_market(panels.daily_vendor_market(spark, sf_dir), "vendor_id")
    return present(panel.select("vendor_id", "date", "price_spot", "realized_vol_30d"))


@_register(f"SELECT commodity, {day()}, {r('close')}, {r('ret', name='returns')}, {r('vol', name='realized_vol_30d')} FROM market_vol")
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(market.realized_vol(market.daily_returns(panels.daily_market(spark, sf_dir))))


@_register(f"SELECT commodity, {day()}, {r('close')}, {r('ret', name='returns')}, {r('vol', name='realized_vol_30d')} FROM market_vol")
def realized_vol_from_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns and volatility over three increments, each of which goes on from the last 30 days before it."""
    first, *later = _increments(written(panels.daily_market(spark, sf_dir), "closes"))
    scored = written(market.realized_vol(market.daily_returns(first)), "priced")
    tail = written(state.return_tail(scored), "tail")
    for part in later:
        priced, after = state.continued_returns(tail, part)
        scored, tail = scored.unionByName(priced), written(after, "tail")
    return present(scored)


@_register(f"SELECT region_id, {day()}, {r('temp_anom')}, {r('precip_anom')}, {r('ndvi')}, {r('enso')} FROM weather")
def region_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(pipeline.weather_table(spark, sf_dir))


@_register(
    f"SELECT station_id, {day()}, {r('temp_anom')}, {r('precip_anom')}, {r('ndvi')}, {r('enso')} FROM station_weather"
)
def station_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same anomalies for every supplier."""
    return present(anomalies.weather_anomalies(panels.daily_station_weather(spark, sf_dir), "station_id"))


#: Increments of the queries that go on from a state: before, between and from these dates.
_INCREMENTS = (dt.date(1995, 3, 3), dt.date(1999, 6, 4))


def _increments(df: DataFrame) -> list[DataFrame]:
    date, (first, second) = F.col("date"), (F.lit(d) for d in _INCREMENTS)
    return [df.where(date < first), df.where((date >= first) & (date < second)), df.where(date >= second)]


@_register(f"SELECT station_id, {day()}, {r('temp_anom')}, {r('precip_anom')} FROM station_weather")
def station_zscore_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomalies of every supplier from moments that were merged over three increments."""
    values = ["temp", "precip"]
    weeks = written(weekly.weekly_weather(panels.daily_station_weather(spark, sf_dir), "station_id"), "station-weeks")
    first, *later = [state.moments(part, values, "station_id") for part in _increments(weeks)]
    known = written(first, "station-moments")
    for part in later:
        known = written(state.merge_moments(known, part, values, "station_id"), "station-moments")
    return present(state.zscore_from_state(weeks, known, values, "station_id").drop(*values))


def _seasonal_sql(season: str, deviation: str) -> str:
    return f"""SELECT station_id, {day()}, {r('temp')}, {r('z', name='temp_z')} FROM (
  SELECT station_id, date, temp, CASE WHEN min(temp) OVER g <> max(temp) OVER g
         THEN (temp - avg(temp) OVER g) / {deviation}(temp) OVER g END AS z
  FROM weekly_station WINDOW g AS (PARTITION BY station_id, {season}(date))) AS scored"""


def _seasonal(spark: SparkSession, sf_dir: str, group_by: str, ddof: int) -> DataFrame:
    panel = weekly.weekly_weather(panels.daily_station_weather(spark, sf_dir), "station_id")
    scored = anomalies.seasonal_zscore(panel, "temp", "station_id", group_by=group_by, ddof=ddof)
    return present(scored.select("station_id", "date", "temp", "temp_z"))


@_register(_seasonal_sql("weekofyear", "stddev_pop"))
def seasonal_zscore_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seasonal(spark, sf_dir, "weekofyear", 0)


@_register(_seasonal_sql("month", "stddev_samp"))
def seasonal_zscore_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seasonal(spark, sf_dir, "month", 1)


# Climate index -------------------------------------------------------------------------------


@_register(f"SELECT commodity, region_id, {day()}, {r('weight')}, {r('regional_score')} FROM score")
def regional_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(climate.regional_scores(pipeline.weather_table(spark, sf_dir), panels.PANEL_CONFIG))


@_register(_INDEX)
def global_risk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(pipeline.index_table(spark, sf_dir))


_REGIONS = panels.PANEL_CONFIG.region_ids()


@_register(
    f"""SELECT commodity, {day()}, {r('total', name='global_risk_0_100')},
       {', '.join(r(f'p{i}', name=f'contrib_{name}'.replace(' ', '_')) for i, name in enumerate(_REGIONS))}
FROM (SELECT commodity, date, sum(coalesce(regional_score * weight, 0)) AS total,
             {', '.join(f"coalesce(sum(regional_score * weight) FILTER (WHERE region_id = '{name}'), 0) AS p{i}" for i, name in enumerate(_REGIONS))}
      FROM score GROUP BY 1, 2) AS wide"""
)
def global_risk_contrib_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = climate.global_index_wide(pipeline.weather_table(spark, sf_dir), panels.PANEL_CONFIG)
    return present(wide.toDF(*[c.replace(" ", "_") for c in wide.columns]))


@_register(
    f"""SELECT {day()}, {r('score', name='global_climate_index')}
FROM (SELECT date, avg(temp_anom - precip_anom) AS score FROM weather GROUP BY 1) AS mean"""
)
def simple_climate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(climate.simple_index(pipeline.weather_table(spark, sf_dir)))


@_register(
    f"""SELECT c.commodity, c.region_id, factor, {whole('count(value)', 'weeks')},
       {r('avg(value * factor_weight)', name='mean_effect')}
FROM (UNPIVOT config ON w_temp_anom AS temp_anom, w_precip_anom AS precip_anom, w_ndvi AS ndvi, w_enso AS enso
      INTO NAME factor VALUE factor_weight) AS c
JOIN (UNPIVOT weather ON temp_anom, precip_anom, ndvi, enso INTO NAME factor VALUE value) AS w
     USING (region_id, factor) GROUP BY 1, 2, 3"""
)
def factor_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weighted anomaly of each configured factor: the exploded config against the weather."""
    observed = pipeline.weather_table(spark, sf_dir).unpivot(
        ["date", "region_id"], ["temp_anom", "precip_anom", "ndvi", "enso"], "factor", "value"
    )
    factors = panels.PANEL_CONFIG.factor_frame(spark)
    effects = observed.join(factors, ["region_id", "factor"]).groupBy("commodity", "region_id", "factor")
    return present(effects.agg(F.count("value").alias("weeks"), F.avg(F.col("value") * F.col("factor_weight")).alias("mean_effect")))


@_register("SELECT DISTINCT region_id FROM config WHERE region_id NOT IN (SELECT region_id FROM daily_weather)")
def regions_without_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured regions that the inner join would drop without a word."""
    observed = panels.daily_weather(spark, sf_dir).select("region_id").distinct()
    return unknown_keys(panels.PANEL_CONFIG.to_frame(spark), observed, "region_id")


# Silver layer --------------------------------------------------------------------------------

_SPLIT = dt.date(1999, 1, 1)
_SPLIT_SQL = f"DATE '{_SPLIT}'"
_OVERLAP = dt.date(1998, 1, 1)


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw prints: many rows per commodity and day, the order number says which is later."""
    orders = panels.table(spark, sf_dir, "orders")
    customers = panels.table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("commodity"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.to_date("o_orderdate").alias("date"), "commodity", F.col("o_totalprice").alias("price_spot"), "o_orderkey"
    )


@_register(
    f"""SELECT commodity, {day()}, {r('price', name='price_spot')}, {whole('o_orderkey')} FROM (
  SELECT commodity, date, price, o_orderkey, row_number() OVER (
           PARTITION BY commodity, date ORDER BY batch DESC, o_orderkey DESC) AS place
  FROM (SELECT lower(c_mktsegment) AS commodity, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, o_orderkey, 0 AS batch
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < DATE '{_SPLIT}'
        UNION ALL
        SELECT lower(c_mktsegment), CAST(o_orderdate AS DATE), o_totalprice * 1.1, o_orderkey, 1
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '{_OVERLAP}') AS batches) AS placed
WHERE place = 1"""
)
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches that share a year; the second one carries revised prices."""
    prints = _dated_orders(spark, sf_dir)
    old = prints.where(F.col("date") < F.lit(_SPLIT))
    new = prints.where(F.col("date") >= F.lit(_OVERLAP)).withColumn("price_spot", F.col("price_spot") * 1.1)
    return present(silver.incremental_update(old, new, ["date", "commodity"], order="o_orderkey"))


_ALIGNED = """SELECT c.commodity, w.date, w.region_id, NULL::DOUBLE AS region_weight, temp_anom, precip_anom, ndvi, enso,
       prod_estimate, stocks, price_spot, price_spot AS price_front_fut, realized_vol_30d
FROM weather w JOIN config c ON w.region_id = c.region_id
LEFT JOIN weekly_supply s ON s.region_id = w.region_id AND s.date = w.date
LEFT JOIN market m ON m.commodity = c.commodity AND m.date = w.date
WHERE w.region_id IN (SELECT region_id FROM weekly_supply)"""


@_register(
    f"""SELECT commodity, {day()}, region_id, region_weight,
       {', '.join(r(c) for c in silver.ALIGNED_COLUMNS[3:])} FROM ({_ALIGNED}) AS aligned"""
)
def aligned_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(pipeline.aligned_table(spark, sf_dir))


_MERGED = f"""SELECT {day('day', 'date')}, place AS region_id, {r('temp_anom')}, {r('precip_anom')}, {r('ndvi')}, {r('enso')},
       commodity, {r('price_spot')}, {r('price_spot', name='price_front_fut')}, {r('realized_vol_30d')},
       CASE WHEN commodity IS NOT NULL THEN 'landed' END AS data_source,
       {r('prod_estimate')}, {r('stocks')}, CASE WHEN has_supply THEN 'landed' END AS data_source_agri
FROM (SELECT coalesce(a.date, s.date) AS day, coalesce(a.region_id, s.region_id) AS place, a.* EXCLUDE (date, region_id),
             s.prod_estimate, s.stocks, s.date IS NOT NULL AS has_supply
      FROM (SELECT coalesce(w.date, m.date) AS date, w.region_id, temp_anom, precip_anom, ndvi, enso,
                   commodity, price_spot, realized_vol_30d
            FROM weather w FULL OUTER JOIN market m ON w.date = m.date) AS a
      FULL OUTER JOIN weekly_supply s ON a.date = s.date AND a.region_id IS NOT DISTINCT FROM s.region_id) AS merged"""


@_register(_MERGED)
def silver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(silver.silver_merge(*pipeline.stored_silver(spark, sf_dir)))


@_register(_INDEX)
def global_risk_from_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index from the merged table in its nested form, whose weather rows are not repeated per commodity."""
    nested = silver.silver_nested(*pipeline.stored_silver(spark, sf_dir))
    return present(climate.global_index(silver.nested_rows(nested, "weather"), panels.PANEL_CONFIG))


@_register(
    f"""SELECT strftime(date, '%Y-%m-%d') AS date, {whole('coalesce(regions, 0)', 'regions')}, {whole('coalesce(commodities, 0)', 'commodities')},
       {whole('coalesce(supplies, 0)', 'supplies')}, {r('temp_anom')}, {r('top_price')}, {r('stocks')}
FROM (SELECT date, count(*) AS regions, avg(temp_anom) AS temp_anom FROM weather GROUP BY 1) AS w
FULL OUTER JOIN (SELECT date, count(*) AS commodities, max(price_spot) AS top_price FROM market GROUP BY 1) AS m USING (date)
FULL OUTER JOIN (SELECT date, count(*) AS supplies, max(stocks) AS stocks FROM weekly_supply GROUP BY 1) AS s USING (date)"""
)
def silver_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested table by date: how many rows each array holds, and one figure of each."""
    nested = silver.silver_nested(*pipeline.stored_silver(spark, sf_dir))
    known = F.filter(F.col("weather.temp_anom"), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
    return present(
        nested.select(
            "date",
            F.size("weather").alias("regions"),
            F.size("market").alias("commodities"),
            F.size("supply").alias("supplies"),
            F.try_divide(total, F.size(known)).alias("temp_anom"),
            F.array_max(F.col("market.price_spot")).alias("top_price"),
            F.array_max(F.col("supply.stocks")).alias("stocks"),
        )
    )


@_register(_MERGED)
def silver_unfolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide merged table out of the stored nested one."""
    nested = written(silver.silver_nested(*pipeline.stored_silver(spark, sf_dir)), "nested")
    return present(silver.silver_merge(*[silver.nested_rows(nested, name) for name in ("weather", "market", "supply")]))


_NOT_NULL = ["temp_anom", "precip_anom", "price_spot", "price_front_fut", "realized_vol_30d"]


def _contract_sql() -> str:
    rows = []
    for rule in quality.SILVER_CONTRACT:
        c = rule.column
        rows.append(f"SELECT '{c}' AS \"column\", 'type' AS rule, 0::BIGINT AS failures")
        if not rule.nullable:
            rows.append(f"SELECT '{c}', 'not_null', count_if({c} IS NULL)::BIGINT FROM aligned")
        if rule.finite:
            rows.append(f"SELECT '{c}', 'finite', count_if(isinf({c}))::BIGINT FROM aligned")
        if rule.non_negative:
            rows.append(f"SELECT '{c}', 'non_negative', count_if({c} < 0)::BIGINT FROM aligned")
    return f"SELECT * FROM (WITH aligned AS ({_ALIGNED}) " + " UNION ALL ".join(rows) + ") AS report"


@_register(_contract_sql())
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(quality.contract_report(pipeline.aligned_table(spark, sf_dir)))


@_register(
    f"""SELECT commodity, {day()}, region_id, {', '.join(r(c) for c in silver.ALIGNED_COLUMNS[3:])}
FROM ({_ALIGNED}) AS aligned WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NOT_NULL)} AND realized_vol_30d >= 0"""
)
def conforming_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned rows that keep every rule of the contract."""
    return present(quality.conforming(pipeline.aligned_table(spark, sf_dir)).drop("region_weight"))


# Return model --------------------------------------------------------------------------------


@_register(f"SELECT commodity, {day()}, {r('y')}, {r('y_lag1')}, {r('risk_lag1')} FROM model_legacy")
def design_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, index = pipeline.market_table(spark, sf_dir), pipeline.index_table(spark, sf_dir)
    return present(design.merge_price_and_risk(prices, index).frame)


@_register(f"SELECT commodity, {day()}, {r('y')}, {', '.join(r(c) for c in WEEKLY)} FROM model_auto")
def design_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, index = pipeline.market_table(spark, sf_dir), pipeline.index_table(spark, sf_dir)
    base = design.merge_price_and_risk(prices, index, mode="auto").frame
    return present(design.auto_features(base).frame.drop("risk"))


def _fit_columns(features: tuple[str, ...]) -> str:
    coefficients = ", ".join(r(f"c_{i}", name=f"b_{name}") for i, name in enumerate(features, 1))
    return f"{whole('n_obs')}, {r('c_0', name='intercept')}, {coefficients}, {r('resid_var')}"


def _fit(model: design.Design) -> DataFrame:
    fitted = regression.fit_ols(model)
    coefficients = [F.col("coeffs")[name].alias(f"b_{name}") for name in model.features]
    return present(fitted.select(*model.keys, "n_obs", "intercept", *coefficients, "resid_var"))


@_register(f"SELECT commodity, {_fit_columns(LEGACY)} FROM model_legacy_fit")
def ols_legacy_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(design.merge_price_and_risk(*pipeline.stored_model_inputs(spark, sf_dir)))


@_register(f"SELECT commodity, {_fit_columns(WEEKLY)} FROM model_auto_fit")
def ols_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = design.merge_price_and_risk(*pipeline.stored_model_inputs(spark, sf_dir), mode="auto").frame
    return _fit(design.auto_features(base))


@_register(f"SELECT commodity, {_fit_columns(TWO_LAGS)} FROM model_two_lags_fit")
def ols_two_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legacy model with two lags of return and risk."""
    return _fit(design.merge_price_and_risk(*pipeline.stored_model_inputs(spark, sf_dir), lags=2))


def _exog_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weekly prices, and the index with the week's mean output of all regions as an extra regressor."""

    def risk() -> DataFrame:
        output = pipeline.supply_table(spark, sf_dir).groupBy("date").agg(F.avg("prod_estimate").alias("exog_output"))
        return pipeline.index_table(spark, sf_dir).join(output, "date")

    prices, index = written_together(spark, market=lambda: pipeline.market_table(spark, sf_dir), exog_index=risk)
    return prices, index


@_register(f"SELECT commodity, {_fit_columns(EXOG)} FROM model_exog_fit")
def ols_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with lags, season and an extra regressor."""
    base = design.merge_price_and_risk(*_exog_inputs(spark, sf_dir), mode="auto", exog_cols=["exog_output"]).frame
    return _fit(design.auto_features(base, extra_exog=["exog_output"]))


def _vendor_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A weekly price series per supplier with its region, and one risk series per region: the score
    of a region is joined by week, and no supplier has a copy of it."""

    def prices() -> DataFrame:
        panel = market.weekly_market(panels.daily_vendor_market(spark, sf_dir), "vendor_id")
        vendors = panels.supplier_regions(spark, sf_dir).withColumnRenamed("s_suppkey", "vendor_id")
        return panel.select("vendor_id", "date", "price_spot").join(vendors, "vendor_id")

    def risk() -> DataFrame:
        config = panels.PANEL_CONFIG.only("automobile")
        scores = climate.regional_scores(pipeline.weather_table(spark, sf_dir), config)
        return scores.selectExpr("region_id", "date", f"regional_score AS {design.RISK}")

    stored = written_together(spark, vendor_market=prices, region_risk=risk)
    return stored[0], stored[1]


@_register(f"SELECT vendor_id, {_fit_columns(WEEKLY)} FROM vendor_weekly_fit")
def ols_per_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weekly model per supplier in a single job."""
    prices, risk = _vendor_inputs(spark, sf_dir)
    return _fit(forecast.market_model_parts(prices, risk, keys="vendor_id", risk_keys="region_id")[0])


_PRICE_DIGITS = {"price_forecast": 2, "price_lo95": 2, "price_hi95": 2}
_FORECAST = f"{day()}, {r('y_forecast')}, {r('price_forecast', 2)}, {r('price_lo95', 2)}, {r('price_hi95', 2)}"


@_register(f"SELECT vendor_id, {_FORECAST} FROM vendor_forecast")
def forecast_per_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, risk = _vendor_inputs(spark, sf_dir)
    return present(forecast.market_model(prices, risk, keys="vendor_id", risk_keys="region_id"), _PRICE_DIGITS)


@_register(f"SELECT commodity, {_FORECAST} FROM model_forecast")
def forecast_8w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(forecast.market_model(*pipeline.stored_model_inputs(spark, sf_dir)), _PRICE_DIGITS)


def _horizon_sql(mode: str) -> str:
    return f"""SELECT commodity, {whole('horizon_days')}, {whole('steps')}, {r('price_forecast', 2)}, {r('cum_return')},
       {r('lo95')}, {r('hi95')} FROM {mode}_horizons"""


@_register(_horizon_sql("legacy"))
def forecast_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, index = pipeline.stored_model_inputs(spark, sf_dir)
    return present(forecast.train_and_forecast(prices, index), _PRICE_DIGITS)


@_register(_horizon_sql("auto"))
def forecast_horizons_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, index = pipeline.stored_model_inputs(spark, sf_dir)
    return present(forecast.train_and_forecast(prices, index, mode="auto"), _PRICE_DIGITS)


@_register(_horizon_sql("exog"))
def forecast_horizons_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons with an extra regressor, which stays at its last value."""
    prices, index = _exog_inputs(spark, sf_dir)
    return present(forecast.train_and_forecast(prices, index, mode="auto", exog_cols=["exog_output"]), _PRICE_DIGITS)


@_register(f"SELECT commodity, {_FORECAST} FROM model_forecast")
def forecast_unit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly model on a risk series from 0 to 1: its scale is seen, and the forecast is the same."""
    prices, index = pipeline.stored_model_inputs(spark, sf_dir)
    return present(forecast.market_model(prices, index.withColumn(design.RISK, F.col(design.RISK) / 100.0)), _PRICE_DIGITS)


@_register(
    f"""SELECT commodity, {day('last_date', 'date')}, {r('last_price', name='price_spot')},
       {r('risk', name='global_risk_0_100')} FROM (
  SELECT commodity, max(date) AS last_date, arg_max(price, date) AS last_price, arg_max(risk, date) AS risk
  FROM model_joined GROUP BY 1) AS newest"""
)
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, index = pipeline.market_table(spark, sf_dir), pipeline.index_table(spark, sf_dir)
    joined = design.join_price_and_risk(prices, index, "price_spot")
    return present(design.latest_row(joined).select("commodity", "date", "price_spot", "global_risk_0_100"))


@_register(
    f"""SELECT commodity, {r('last', name='last_price_spot')}, {r('prev', name='prev_price_spot')} FROM (
  SELECT commodity, price_spot AS last, lag(price_spot) OVER o AS prev, row_number() OVER (PARTITION BY commodity ORDER BY date DESC) AS place
  FROM market WINDOW o AS (PARTITION BY commodity ORDER BY date)) AS pairs WHERE place = 1"""
)
def last_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(design.last_two(pipeline.market_table(spark, sf_dir), "price_spot"))


@_register(
    f"""SELECT commodity, {whole('place')}, {r('risk')} FROM (
  SELECT commodity, global_risk_0_100 / 100 AS risk, row_number() OVER (PARTITION BY commodity ORDER BY date) - 1 AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY date DESC) AS newest FROM risk_index) AS ranked
  WHERE newest <= 10) AS tail"""
)
def tail10_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = design.tail_in_order(pipeline.index_table(spark, sf_dir), design.RISK, 10, output="path")
    rows = tails.select("commodity", F.posexplode("path").alias("place", "risk"))
    return present(rows.withColumn("risk", F.col("risk") / 100.0))


# Hedge and report ----------------------------------------------------------------------------


def _layers(spark: SparkSession, sf_dir: str) -> pipeline.Layers:
    return pipeline.run_layers(*pipeline.stored_model_inputs(spark, sf_dir), AS_OF)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What advice is given from. Texts show all digits of a price, so it keeps those that do not
    depend on the order in which an engine adds."""
    prices, index = pipeline.stored_model_inputs(spark, sf_dir)
    state = hedge.latest_state(written(forecast.market_model(prices, index), "forecast"), index)
    return state.withColumn("last_price_forecast", F.expr(rounded("last_price_forecast", 2)))


def _advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedge.recommend(hedge.with_request_grid(_state(spark, sf_dir)), AS_OF)


@_register(
    f"""SELECT commodity, profile, role, {r('exposure')}, {whole('forecast_horizon_weeks')}, scenario, {r('risk_score')},
       {r('hedge_ratio')}, {r('hedge_notional')}, instrument, {r('forecast_price', 2)}, instrument_maturity,
       {r('instrument_strike', 2)}, summary, justification, '{AS_OF:%Y-%m-%dT%H:%M:%SZ}' AS "timestamp"
FROM ({rationale('SELECT * FROM advice')}) AS told"""
)
def hedge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a recommendation for each commodity, profile and role."""
    return present(_advice(spark, sf_dir), {"forecast_price": 2, "instrument_strike": 2})


def _customer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests summed up from the customers of each commodity, profile and role."""
    balance = F.col("c_acctbal")
    profile = F.when(balance > 6000, "opportunistic").when(balance > 2000, "balanced").otherwise("conservative")
    role = F.when(F.col("region_id").isin("EUROPE", "ASIA"), "importer").otherwise("exporter")
    customers = panels.table(spark, sf_dir, "customer")
    return (
        customers.join(panels.nation_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.lower("c_mktsegment").alias("commodity"), profile.alias("profile"), role.alias("role"))
        .agg(F.round(F.sum("c_acctbal"), 2).alias("exposure"))
    )


@_register(
    f"""SELECT commodity, profile, role, {r('exposure')}, scenario, {r('hedge_ratio')}, {r('hedge_notional')}, instrument
FROM (SELECT commodity, r.profile, r.role, r.exposure, scenario, hedge_ratio, hedge_ratio * r.exposure AS hedge_notional, instrument
      FROM (SELECT lower(c_mktsegment) AS commodity, profile, role, round(sum(c_acctbal), 2) AS exposure FROM (
              SELECT *, CASE WHEN c_acctbal > 6000 THEN 'opportunistic' WHEN c_acctbal > 2000 THEN 'balanced' ELSE 'conservative' END AS profile,
                     CASE WHEN r_name IN ('EUROPE', 'ASIA') THEN 'importer' ELSE 'exporter' END AS role
              FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS typed
            GROUP BY 1, 2, 3) AS r
      JOIN hedge AS h USING (commodity, profile, role)) AS asked"""
)
def hedge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests summed up from the customers of each commodity, profile and role."""
    prices, index = pipeline.stored_model_inputs(spark, sf_dir)
    path = written(forecast.market_model(prices, index), "forecast")
    rows = hedge.recommend(hedge.with_requests(hedge.latest_state(path, index), _customer_requests(spark, sf_dir)), AS_OF)
    return present(rows.select("commodity", "profile", "role", "exposure", "scenario", "hedge_ratio", "hedge_notional", "instrument"))


@_register(
    f"""SELECT commodity, profile, role, summary, justification FROM ({rationale(
        "SELECT * REPLACE (asked AS exposure, hedge_ratio * asked AS hedge_notional) FROM advice JOIN customer_requests USING (commodity, profile, role)"
    )}) AS told"""
)
def hedge_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts for the customers' requests: shares, amounts and prices as they are printed."""
    rows = hedge.recommend(hedge.with_requests(_state(spark, sf_dir), _customer_requests(spark, sf_dir)), AS_OF)
    return rows.select("commodity", "profile", "role", "summary", "justification")


@_register(
    f"""SELECT f.commodity, {r('last_price', 2, 'latest_forecast_price')}, {r('(last_price / first_price - 1) * 100', name='forecast_change_pct')},
       {r('risk_score')}, {r('notional', name='hedge_notional')}, {r('hedge_ratio')}, scenario, {whole('legs', 'hedge_legs')}
FROM (SELECT commodity, max(CASE WHEN step = 8 THEN price_forecast END) AS last_price,
             max(CASE WHEN step = 1 THEN price_forecast END) AS first_price FROM model_forecast GROUP BY 1) AS f
JOIN (SELECT commodity, max(risk_score) AS risk_score, sum(hedge_notional) AS notional, count(*) AS legs,
             max(scenario) AS scenario, max(CASE WHEN profile = 'balanced' AND role = 'exporter' THEN hedge_ratio END) AS hedge_ratio
      FROM hedge GROUP BY 1) AS h USING (commodity)"""
)
def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(_layers(spark, sf_dir).kpis(), {"latest_forecast_price": 2})


@_register(
    f"""SELECT commodity, profile, role, {whole('position')}, label, value FROM (
  SELECT commodity, profile, role, unnest(range(1, 10)) AS position,
         unnest(['Profile', 'Role', 'Scenario', 'Risk Score', 'Forecast Horizon', 'Exposure', 'Suggested Hedge Ratio', 'Hedge Notional', 'Instrument']) AS label,
         unnest([upper(profile[1]) || profile[2:], upper(role[1]) || role[2:], upper(scenario[1]) || scenario[2:],
                 printf('%.1f / 100', risk_score), '8 weeks', format('{{:,}} USD', round_even(exposure, 0)::BIGINT), printf('%.1f%%', hedge_ratio * 100),
                 format('{{:,}} units', round_even(hedge_notional, 0)::BIGINT), upper(instrument[1]) || instrument[2:]]) AS value
  FROM (SELECT * REPLACE (asked AS exposure, hedge_ratio * asked AS hedge_notional) FROM advice JOIN customer_requests USING (commodity, profile, role)) AS given) AS listed"""
)
def hedge_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the report's summary for the customers' requests."""
    rows = hedge.recommend(hedge.with_requests(_state(spark, sf_dir), _customer_requests(spark, sf_dir)), AS_OF)
    return present(report.hedge_summary_table(rows))


@_register(
    f"""SELECT commodity, profile, role, {whole('position')}, label, value FROM (
  SELECT commodity, profile, role, unnest(range(1, 9)) AS position,
         unnest(['Commodity', 'Profile', 'Role', 'Exposure', 'Hedge notional', 'Instrument', 'Maturity', 'Strike']) AS label,
         unnest([commodity, profile, role, exposure::VARCHAR, round(hedge_notional, 2)::VARCHAR, instrument, instrument_maturity, instrument_strike::VARCHAR]) AS value
  FROM advice) AS listed"""
)
def hedge_detail_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and value of each recommendation, as the dashboard lists them."""
    rows = _advice(spark, sf_dir).withColumn("hedge_notional", F.round("hedge_notional", 2))
    return present(report.hedge_detail_table(rows))


def _model_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.market_model(*pipeline.stored_model_inputs(spark, sf_dir))


@_register(f"SELECT commodity, {day()}, {r('ret_pct', 4)}, {r('ret_lo95', 4)}, {r('ret_hi95', 4)} FROM pct_band")
def pct_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(report.pct_band_series(_model_forecast(spark, sf_dir)), {"ret_pct": 4, "ret_lo95": 4, "ret_hi95": 4})


@_register(
    f"""SELECT commodity, {r('domain_min', 2)}, {r('domain_max', 2)} FROM (
  SELECT commodity, lo - (hi - lo) * 0.05 AS domain_min, hi + (hi - lo) * 0.05 AS domain_max FROM (
    SELECT commodity, CASE WHEN lo = hi THEN lo - 1 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 1 ELSE hi END AS hi FROM (
      SELECT commodity, min(least(price_forecast, price_lo95, price_hi95)) AS lo,
             max(greatest(price_forecast, price_lo95, price_hi95)) AS hi FROM model_forecast GROUP BY 1) AS raw) AS wide) AS padded"""
)
def padded_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(report.forecast_domain(_model_forecast(spark, sf_dir)), {"domain_min": 2, "domain_max": 2})


@_register(
    f"""SELECT commodity, {day()}, {r('price_spot', name='price')} FROM market JOIN (
  SELECT commodity, max(date) AS newest FROM market GROUP BY 1) AS ends USING (commodity)
WHERE date >= newest - INTERVAL 12 MONTH"""
)
def trailing_12m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(report.price_history(pipeline.market_table(spark, sf_dir), "12M"))


@_register(
    f"""SELECT commodity, {day()}, {r('global_risk_0_100', name='risk_value')} FROM risk_index JOIN (
  SELECT commodity, max(date) AS newest FROM risk_index GROUP BY 1) AS ends USING (commodity)
WHERE date >= newest - INTERVAL 24 MONTH"""
)
def risk_history_24m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(report.risk_history(pipeline.index_table(spark, sf_dir), "24M"))


@_register(
    f"""SELECT commodity, {day()}, {r('o_totalprice', name='price_spot')}, {whole('o_orderkey')} FROM (
  SELECT lower(c_mktsegment) AS commodity, CAST(o_orderdate AS DATE) AS date, o_totalprice, o_orderkey,
         row_number() OVER (PARTITION BY c_mktsegment, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS place
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') AS placed WHERE place = 1"""
)
def price_history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First print of each day of one commodity, named in any case."""
    return present(report.price_history_dedup(_dated_orders(spark, sf_dir), ["o_orderkey"], commodity="Building"))


# Sources and sinks ---------------------------------------------------------------------------


@_register(
    f"SELECT station_id, {day()}, {r('temp')}, {r('precip')} FROM daily_station"
)
def weather_payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per supplier and year, as an archive would land it, back to daily rows.

    One payload holds at most one row per day of its year.
    """
    daily = panels.daily_station_weather(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("date", "temp", "precip")))
    payloads = (
        daily.groupBy("station_id", F.year("date").alias("_year"))
        .agg(rows.alias("_rows"))
        .select(
            "station_id",
            F.to_json(
                F.struct(
                    F.struct(
                        F.transform("_rows", lambda x: x["date"].cast("string")).alias("time"),
                        F.col("_rows.temp").alias("temperature_2m_mean"),
                        F.col("_rows.precip").alias("precipitation_sum"),
                    ).alias("daily")
                )
            ).alias("payload"),
        )
    )
    return present(landing.flatten_weather(payloads))


@_register(f"SELECT commodity, {day()}, {r('close')} FROM daily_market")
def close_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with an adjusted and a plain close; the adjusted one is taken."""
    closes = panels.daily_market(spark, sf_dir)
    quotes = closes.select(
        "commodity", "date", (F.col("close") * 2).alias("Close_ZS=F"), F.col("close").alias("Adj Close_ZS=F")
    )
    return present(landing.daily_close(quotes, order="date"))


@_register(
    f"""SELECT {day()}, {whole('count(*)', 'orders')} FROM (
  SELECT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus <> 'P') AS dated GROUP BY date"""
)
def utc_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days parsed from plain dates, UTC timestamps with an offset and junk, which is dropped."""
    orders = panels.table(spark, sf_dir, "orders")
    plain = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(F.col("o_orderstatus") == "F", plain)
        .when(F.col("o_orderstatus") == "P", F.lit("no date"))
        .otherwise(F.concat(plain, F.lit("T02:30:00+02:00")))
    )
    dated = orders.select(parse_date(text).alias("date")).dropna(subset=["date"])
    return present(dated.groupBy("date").agg(F.count("*").alias("orders")))


@_register(
    f"SELECT commodity, {day()}, {r('close')} FROM daily_market WHERE date BETWEEN DATE '1996-06-30' AND DATE '2000-06-30'"
)
def rolling_window_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of the four years that end on a given day."""
    closes = panels.daily_market(spark, sf_dir)
    return present(closes.where(rolling_scope("date", dt.date(2000, 6, 30), years=4)))


@_register(_MARKET)
def market_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market table written as CSV and scanned back by column name."""
    path = scratch_path(spark, "market") + ".csv"
    tables.write_table(pipeline.market_table(spark, sf_dir), path)
    return present(tables.csv_scan(spark, path, tables.MARKET).select(*tables.MARKET.fieldNames()))


@_register(_INDEX)
def index_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written as JSON, one folder per commodity, and read back."""
    path = scratch_path(spark, "index")
    tables.gold_sink(pipeline.index_table(spark, sf_dir), path, format="json")
    return present(tables.json_scan(spark, path, tables.INDEX, lines=True))


@_register(_MARKET)
def silver_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store loaded with all weeks, then upserted with revised later years and once more with the
    true rows: the last batch wins in the years it touches."""
    prices = written(pipeline.market_table(spark, sf_dir), "market")
    store = tables.SilverStore(spark, scratch_path(spark, "store"), tables.MARKET, ["date", "commodity"])
    store.overwrite(prices)
    late = prices.where(F.col("date") >= F.lit(_SPLIT))
    store.upsert(late.withColumn("price_spot", F.col("price_spot") * 2), "revised")
    store.upsert(late, "restored")
    return present(store.read())


@_register(_MARKET)
def silver_store_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store reloaded after an upsert died between its two writes: what was staged is dropped."""
    prices = written(pipeline.market_table(spark, sf_dir), "market")
    store = tables.SilverStore(spark, scratch_path(spark, "store"), tables.MARKET, ["date", "commodity"])
    late = prices.where(F.col("date") >= F.lit(_SPLIT))
    store.overwrite(prices.withColumn("price_spot", F.col("price_spot") * 3))
    store._stage(late.withColumn("price_spot", F.col("price_spot") * 2), "died", None)
    store.overwrite(prices)
    store.upsert(late, "next")
    return present(store.read())


@_register(_MARKET)
def silver_store_same_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows under the id of the batch before: they are merged like any others."""
    prices = written(pipeline.market_table(spark, sf_dir), "market")
    store = tables.SilverStore(spark, scratch_path(spark, "store"), tables.MARKET, ["date", "commodity"])
    late = F.col("date") >= F.lit(_SPLIT)
    store.upsert(prices.where(~late), "one")
    store.upsert(prices.where(late).withColumn("price_spot", F.col("price_spot") * 2), "one")
    store.upsert(prices.where(late), "one")
    return present(store.read())


@_register(f"SELECT commodity, {day()}, {r('close')} FROM daily_market")
def quotes_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as CSV, each commodity with columns of its own names in its own order."""
    path = scratch_path(spark, "quotes")
    closes = written(panels.daily_market(spark, sf_dir), "closes")
    for i, name in enumerate(sorted(panels.PANEL_CONFIG.commodities)):
        plain, adjusted = (F.col("close") * 2).alias(f"Close_X{i}=F"), F.col("close").alias(f"Adj Close_X{i}=F" if i % 2 else "Adj Close")
        columns = ["commodity", F.col("date").alias("Date"), adjusted, plain]
        closes.where(F.col("commodity") == name).select(*columns[i % 4 :], *columns[: i % 4]).write.option("header", True).csv(f"{path}/{i}")
    frames = [landing.dated_close(raw, date="Date") for raw in tables.csv_frames(spark, f"{path}/*")]
    return present(landing.latest_close(reduce(DataFrame.unionByName, frames)))


@_register(
    f"""SELECT commodity, {day()}, later, {r('close')} FROM (
  SELECT commodity, date, 'small' AS later, CASE WHEN date >= {_SPLIT_SQL} THEN close ELSE close * 2 END AS close FROM daily_market
  UNION ALL SELECT commodity, date, 'large' AS later, close FROM daily_market) AS landed"""
)
def landed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that landed twice, in sets of files of unequal size: the later set wins, be it the small or the large one."""
    closes = written(panels.daily_market(spark, sf_dir).withColumnRenamed("close", "Close"), "closes")
    late, out = closes.where(F.col("date") >= F.lit(_SPLIT)), []
    for later, sets in {"small": [(closes, 2, 5), (late, 1, 3)], "large": [(late, 3, 3), (closes, 1, 5)]}.items():
        path = scratch_path(spark, "landed")
        for rows, factor, files in sets:
            rows.withColumn("Close", F.col("Close") * factor).repartition(files, "commodity").write.mode("append").option("header", True).csv(path)
        out.append(landing.daily_close(tables.csv_frames(spark, path)[0]).withColumn("later", F.lit(later)))
    return present(out[0].unionByName(out[1]).select("commodity", "date", "later", "close"))


@_register(_MARKET)
def load_in_two_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes that land in two parts; the weekly table sees the whole stored history."""
    closes = written(panels.daily_market(spark, sf_dir), "closes")
    store = tables.SilverStore(spark, scratch_path(spark, "store"), tables.DAILY_MARKET, ["date", "commodity"])
    late = F.col("date") >= F.lit(_SPLIT)
    store.upsert(closes.where(~late), "first")
    store.upsert(closes.where(late), "second")
    return present(market.weekly_market(store.read()))


@_register(f"SELECT region_id, {day()}, {r('temp_anom')}, {r('precip_anom')}, {r('ndvi')}, {r('enso')} FROM weather")
def second_load_touches_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather that lands twice, the second time for one region alone: the weekly rows of that region
    are derived again, and the table equals the one made from all days at once."""
    days = written(panels.daily_weather(spark, sf_dir), "days")
    late = (F.col("region_id") == "ASIA") & (F.col("date") >= F.lit(_SPLIT))
    run = runs.Run(spark, scratch_path(spark, "run"), dt.datetime(2002, 1, 1))
    for batch in (days.where(~late), days.where(late)):
        run.landed("weather", batch, "load")
    return present(run.store("weather").read())


@_register(f"SELECT commodity, {day()}, {r('y_forecast')}, {r('price_forecast', 2)}, {r('price_lo95', 2)}, {r('price_hi95', 2)} FROM model_forecast")
def commodity_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as one JSON array per commodity, whose name only the file has."""
    path, out = scratch_path(spark, "forecasts"), scratch_path(spark, "forecast-files")
    row = F.struct("date", "y_forecast", "price_forecast", "price_lo95", "price_hi95")
    arrays = _model_forecast(spark, sf_dir).groupBy("commodity").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value"))
    arrays.write.partitionBy("commodity").text(path)
    for folder in leaf_folders(spark, path, 1):
        name = folder.removeprefix("commodity=")
        for file in spark.read.text(f"{path}/{folder}").inputFiles():
            folder_moved(spark, file, f"{out}/{name}_forecast.json")
    rows = tables.json_scan(spark, out, tables.FORECAST, commodity_suffix="_forecast")
    return present(rows, _PRICE_DIGITS)


@_register(f"SELECT commodity, {day()}, {r('close')} FROM daily_market")
def any_format_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table given without its extension: parquet where there is one, else CSV."""
    base = scratch_path(spark, "any")
    closes = written(panels.daily_market(spark, sf_dir), "closes")
    late = F.col("date") >= F.lit(_SPLIT)
    tables.write_table(closes.where(late), f"{base}-late.parquet")
    tables.write_table(closes.where(~late), f"{base}-early.csv")
    both = [tables.any_scan(spark, f"{base}-{part}", tables.DAILY_MARKET) for part in ("late", "early", "absent")]
    return present(reduce(DataFrame.unionByName, both))


@_register(
    f"""SELECT 'ingestion' AS layer, 'market_written' AS action, commodity AS path, {whole('count(*)', 'rows')}
FROM daily_market GROUP BY commodity"""
)
def audit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit event per commodity with its row count, appended and scanned back."""
    path = scratch_path(spark, "audit")
    counted = panels.daily_market(spark, sf_dir).groupBy("commodity").agg(F.count("*").alias("rows"))
    events = counted.select(
        F.lit(AS_OF.isoformat() + "Z").alias("timestamp"),
        F.lit("ingestion").alias("layer"),
        F.lit("market_written").alias("action"),
        F.struct(F.col("commodity").alias("path"), "rows").alias("payload"),
    )
    audit.audit_append(events, path)
    return audit.audit_scan(spark, path).select("layer", "action", "payload.path", "payload.rows")


@_register(
    f"""SELECT 'ingestion' AS layer, 'market_written' AS action, commodity AS path, {whole('count(*)', 'rows')}
FROM daily_market GROUP BY commodity"""
)
def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events tailed as a stream."""
    path, out = scratch_path(spark, "audit"), scratch_path(spark, "tail")
    counted = panels.daily_market(spark, sf_dir).groupBy("commodity").agg(F.count("*").alias("rows"))
    payload = F.struct(F.col("commodity").alias("path"), "rows").alias("payload")
    stamp = F.lit(AS_OF.isoformat() + "Z").alias("timestamp")
    audit.audit_append(counted.select(stamp, F.lit("ingestion").alias("layer"), F.lit("market_written").alias("action"), payload), path)
    events = jobs.audit_stream(spark, path)
    query = events.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("layer", "action", "payload.path", "payload.rows")


@_register(f"SELECT commodity, {day()}, {r('price_forecast', 2)}, {r('price_lo95', 2)}, {r('price_hi95', 2)} FROM model_forecast")
def forecast_band_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price chart's points as stored report rows: exported as CSV and read back by name."""
    path = scratch_path(spark, "bands")
    bands = report.forecast_band_series(_model_forecast(spark, sf_dir))
    tables.csv_export(bands, path)
    rows = tables.csv_scan(spark, f"{path}.csv", tables.FORECAST).drop("y_forecast")
    return present(rows, {"price_forecast": 2, "price_lo95": 2, "price_hi95": 2})


@_register(
    f"""SELECT region_id, commodity, ticker, latitude, longitude, {whole('weeks')} FROM (
  SELECT region_id, commodity, count(*) AS weeks FROM (
    SELECT date, CASE r_name WHEN 'AFRICA' THEN 'AR' WHEN 'AMERICA' THEN 'US' WHEN 'ASIA' THEN 'CN' WHEN 'EUROPE' THEN 'FR' ELSE 'XX' END AS region_id
    FROM (SELECT region_id AS r_name, date FROM weather) AS w) AS placed,
    (SELECT DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN 'Corn' WHEN 'MACHINERY' THEN 'Cocoa' ELSE 'steel' END AS commodity FROM customer) AS goods
  GROUP BY 1, 2) AS counted
JOIN (VALUES ('AR', -34.6037e0, -58.3816e0), ('US', 39.8283e0, -98.5795e0), ('CN', 35.8617e0, 104.1954e0), ('FR', 46.2276e0, 2.2137e0)) AS c(region_id, latitude, longitude) USING (region_id)
JOIN (VALUES ('Corn', 'ZC=F'), ('Cocoa', 'CC=F')) AS t(commodity, ticker) USING (commodity)"""
)
def reference_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks per region and commodity with the region's centre and the commodity's ticker; unknown ones drop out."""
    codes = {"AFRICA": "AR", "AMERICA": "US", "ASIA": "CN", "EUROPE": "FR"}
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("region_id")], F.lit("XX"))
    weeks = pipeline.weather_table(spark, sf_dir).groupBy(code.alias("region_id")).agg(F.count("*").alias("weeks"))
    segment = F.col("c_mktsegment")
    goods = panels.table(spark, sf_dir, "customer").select(
        F.when(segment == "BUILDING", "Corn").when(segment == "MACHINERY", "Cocoa").otherwise("steel").alias("commodity")
    )
    names = config.with_ticker(goods.distinct())
    # One row for each known commodity, two here.
    pairs = F.transform(F.array(*[F.lit(c) for c in config.TICKERS]), lambda c: c)
    rows = weeks.withColumn("_name", F.explode(pairs)).join(names, F.lower("commodity") == F.col("_name")).drop("_name")
    return config.with_region_centre(rows).select("region_id", "commodity", "ticker", "latitude", "longitude", "weeks")


# Streams -------------------------------------------------------------------------------------


@_register(
    f"""SELECT {day()}, region_id, {r('temp')}, {r('precip')} FROM (
  SELECT {week('l_shipdate')} AS date, r_name AS region_id, avg(l_quantity) AS temp,
         CAST(sum(l_linenumber) AS DOUBLE) AS precip
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) AS weeks
WHERE date + INTERVAL 1 DAY <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 14 DAY"""
)
def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly weather from a stream of line items: weeks the watermark has closed."""
    lines = panels.stream(spark, sf_dir, "lineitem").select(
        # The wall clock of the file is UTC, whatever the session's time zone.
        F.from_utc_timestamp(F.col("l_shipdate").cast("timestamp"), F.current_timezone()).alias("ts"),
        "l_suppkey",
        F.col("l_quantity").alias("temp"),
        F.col("l_linenumber").cast("double").alias("precip"),
    )
    placed = lines.join(panels.supplier_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    weeks = jobs.stream_weekly(placed)
    path = scratch_path(spark, "weekly")
    query = (
        weeks.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return present(spark.read.schema(weeks.schema).parquet(path))


@_register(
    f"""SELECT {week('l_shipdate')}::VARCHAR AS date, r_name AS region_id, {r('avg(l_quantity)', name='temp')},
       {r('CAST(sum(l_linenumber) AS DOUBLE)', name='precip')}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
)
def stream_weekly_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly weather from line items in four micro-batches, each with rows of all weeks:
    every batch corrects weeks that were emitted before, and the last state is that of all rows."""
    path = scratch_path(spark, "corrected")
    lines = panels.landed_stream(spark, sf_dir, "lineitem", path, ["l_orderkey", "l_linenumber"]).select(
        F.from_utc_timestamp(F.col("l_shipdate").cast("timestamp"), F.current_timezone()).alias("ts"),
        "l_suppkey",
        F.col("l_quantity").alias("temp"),
        F.col("l_linenumber").cast("double").alias("precip"),
    )
    placed = lines.join(panels.supplier_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    store = tables.SilverStore(spark, f"{path}/store", tables.WEEKLY_WEATHER, ["date", "region_id"])
    jobs.stream_weekly_corrected(placed, store, "weeks", checkpoint=f"{path}/state").awaitTermination()
    return present(store.read())


@_register(f"SELECT commodity, {day()}, {r('close', name='price_spot')} FROM daily_market")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prints streamed into a store that keeps the last print of each day.

    The orders come in four micro-batches, dealt by hash, so that a later batch holds earlier orders
    as well.
    """
    path = scratch_path(spark, "prints")
    customers = panels.table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("commodity"))
    prints = (
        panels.landed_stream(spark, sf_dir, "orders", path, ["o_orderkey"])
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.to_date("o_orderdate").alias("date"), "commodity", F.col("o_totalprice").alias("price_spot"), "o_orderkey")
    )
    store = tables.SilverStore(spark, f"{path}/store", tables.MARKET, ["date", "commodity"])
    jobs.stream_upsert(prints, store, "prints", checkpoint=f"{path}/state", order="o_orderkey").awaitTermination()
    return present(store.read().select("commodity", "date", "price_spot"))
