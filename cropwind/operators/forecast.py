"""Recursive price forecasts with 95% bands."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropwind.functions.calendar import forecast_date, weekly_steps
from cropwind.functions.columns import as_names, text
from cropwind.operators.design import (
    RISK,
    Design,
    auto_features,
    join_price_and_risk,
    merge_price_and_risk,
    unit_risk,
)
from cropwind.operators.market import in_order, log_returns, price_column
from cropwind.operators.regression import fit_ols

Z95 = 1.96
RISK_TAIL = 10


def _lag(name: str) -> int:
    return int(name.rsplit("lag", 1)[1])


def _known_part(features: Iterable[str], period: int) -> str:
    """SQL for everything in the return of step ``s`` (from 1) that no earlier forecast decides."""
    turn = f"{2.0 * math.pi / period!r}D * (season_phase + s)"
    terms = ["intercept"]
    for name in features:
        if name.startswith("y_lag"):
            continue
        if name.startswith("risk_lag"):
            # Lag k looks k - 1 places ahead on the path; past its end the last value repeats.
            value = f"risk_path[least(s - 1 + {_lag(name) - 1}, size(risk_path) - 1)]"
        elif name == "season_sin":
            value = f"sin({turn})"
        elif name == "season_cos":
            value = f"cos({turn})"
        else:
            value = f"coalesce(try_element_at(exog_last, {text(name)}), 0D)"
        terms.append(f"coeffs[{text(name)}] * {value}")
    return " + ".join(terms)


def recursive_forecast(
    params: DataFrame,
    features: Iterable[str],
    horizon: int,
    season_period: int = 52,
    proper_shift: bool = False,
    keys: str | Iterable[str] = "commodity",
) -> DataFrame:
    """One row per series and step with ``y_forecast``, ``cum_return`` and ``price_forecast``.

    ``params`` holds the fit plus ``last_price``, ``risk_path`` (array), ``season_phase`` and
    ``y_seed`` (array of starting lags, newest first; missing ones count as 0).  By default
    all return lags take the newest forecast from step 2 on; ``proper_shift`` moves them one
    place instead.  The recursion is a fold inside each row, so no data moves between tasks.
    """
    keys, features = as_names(keys), list(features)
    orders = [_lag(f) for f in features if f.startswith("y_lag")]
    depth = max(orders, default=1)
    carried = [c for c in params.columns if c not in ("risk_path", "y_seed")]
    drift = f"transform(sequence(1, {horizon}), s -> CAST({_known_part(features, season_period)} AS DOUBLE))"
    y = " + ".join(["known", *[f"coeffs['y_lag{k}'] * state.lags[{k - 1}]" for k in orders]])
    next_lags = f"concat(array(y), slice(state.lags, 1, {depth - 1}))" if proper_shift else f"array_repeat(y, {depth})"
    # One step: its return, then the moved lags, the running sum and the price.
    step = f"""transform(array({y}), y -> named_struct(
        'lags', {next_lags},
        'cum', state.cum + y,
        'price', state.price * exp(y),
        'out', concat(state.out, array(named_struct('y', y, 'cum', state.cum + y, 'price', state.price * exp(y))))
    ))[0]"""
    start = f"""named_struct(
        'lags', transform(sequence(0, {depth - 1}), k -> coalesce(get(y_seed, k), 0D)),
        'cum', 0D,
        'price', CAST(last_price AS DOUBLE),
        'out', CAST(array() AS array<struct<y:double,cum:double,price:double>>)
    )"""
    path = f"aggregate({drift}, {start}, (state, known) -> {step}, state -> state.out)"
    return params.selectExpr(*carried, f"posexplode({path}) AS (_pos, _step)").selectExpr(
        *carried,
        "_pos + 1 AS step",
        "_step.y AS y_forecast",
        "_step.cum AS cum_return",
        "_step.price AS price_forecast",
    )


def with_price_band(forecast: DataFrame) -> DataFrame:
    """Add ``price_lo95`` and ``price_hi95``; without residual variance both equal the forecast."""
    spread = F.sqrt(F.col("resid_var") * F.col("step")) * Z95
    bound = lambda sign: F.when(
        F.col("resid_var") > 0, F.col("last_price") * F.exp(F.col("cum_return") + F.lit(sign) * spread)
    ).otherwise(F.col("price_forecast"))
    return forecast.withColumns({"price_lo95": bound(-1.0), "price_hi95": bound(1.0)})


def with_return_band(forecast: DataFrame) -> DataFrame:
    """Add ``lo95`` and ``hi95`` around the cumulative return."""
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("resid_var")) * F.col("step")) * Z95
    return forecast.withColumns({"lo95": F.col("cum_return") - spread, "hi95": F.col("cum_return") + spread})


def market_model_parts(
    market: DataFrame,
    index: DataFrame,
    p: int = 2,
    q: int = 2,
    season_period: int = 52,
    keys: str | Iterable[str] = "commodity",
    seed_lags: bool = False,
    risk_keys: str | Iterable[str] | None = None,
) -> tuple[Design, DataFrame]:
    """Design and fitted parameters of the weekly model, ready for :func:`recursive_forecast`.

    ``risk_keys`` names the columns that tell a price series' risk series, where several share one.
    """
    keys = as_names(keys)
    shared = keys if risk_keys is None else as_names(risk_keys)
    price = price_column(market.columns)
    joined = join_price_and_risk(market, index.select(*shared, "date", RISK), price, RISK, keys, shared)
    merged = log_returns(joined.drop(*[c for c in shared if c not in keys]), price, keys)
    design = auto_features(merged, p, q, True, season_period, keys=keys)
    fit = fit_ols(design)
    # The last few rows of each series become one short array.
    order, whole = in_order(keys), Window.partitionBy(*keys)
    kept = max(RISK_TAIL, p)
    numbered = merged.select(
        *keys,
        F.struct("date", F.col(price).alias("price"), "y", unit_risk(RISK, keys).alias("risk")).alias("_row"),
        F.row_number().over(order).alias("_place"),
        F.count("*").over(whole).alias("_rows"),
    ).where(F.col("_place") > F.col("_rows") - kept)
    newest_first = F.reverse(F.array_sort(F.collect_list("_row")))
    state = (
        numbered.groupBy(*keys)
        .agg(newest_first.alias("_recent"), F.max("_rows").alias("_rows"))
        .select(
            *keys,
            F.col("_recent")[0]["date"].alias("last_date"),
            F.col("_recent")[0]["price"].alias("last_price"),
            F.pmod(F.col("_rows") - 1, F.lit(season_period)).cast("double").alias("season_phase"),
            F.reverse(F.slice("_recent", 1, RISK_TAIL))["risk"].alias("risk_path"),
            (F.col("_recent")["y"] if seed_lags else F.array().cast("array<double>")).alias("y_seed"),
        )
    )
    return design, fit.join(state, keys, "inner")


def market_model(
    market: DataFrame,
    index: DataFrame,
    horizon: int = 8,
    p: int = 2,
    q: int = 2,
    season_period: int = 52,
    anchor: str = "SUN",
    seed_lags: bool = False,
    proper_shift: bool = False,
    keys: str | Iterable[str] = "commodity",
    risk_keys: str | Iterable[str] | None = None,
) -> DataFrame:
    """Fit every series and forecast ``horizon`` weeks with price bands.

    The future risk path replays the last ten observed values.  Return lags start at 0 unless
    ``seed_lags``.  Forecast weeks are labelled by ``anchor`` days after the last Friday.
    """
    keys = as_names(keys)
    design, params = market_model_parts(market, index, p, q, season_period, keys, seed_lags, risk_keys)
    path = with_price_band(recursive_forecast(params, design.features, horizon, season_period, proper_shift, keys))
    return path.select(
        *keys,
        forecast_date("last_date", "step", anchor).alias("date"),
        "price_forecast",
        "y_forecast",
        "price_lo95",
        "price_hi95",
    )


def train_and_forecast(
    price: DataFrame,
    risk: DataFrame,
    horizons: Iterable[int] = (30, 60, 90),
    price_col: str = "price_front_fut",
    risk_col: str = RISK,
    lags: int = 1,
    mode: str = "legacy",
    p: int = 2,
    q: int = 2,
    include_seasonal: bool = True,
    season_period: int = 52,
    exog_cols: Iterable[str] | None = None,
    keys: str | Iterable[str] = "commodity",
) -> DataFrame:
    """Fit every series and forecast the price and cumulative return at each horizon (in days).

    The future risk stays at the last level.  In ``legacy`` mode the recursion starts from the
    lags of the last training row; in ``auto`` mode from 0.
    """
    keys, horizons = as_names(keys), [int(h) for h in horizons]
    if mode == "legacy" and lags < 1:
        raise ValueError("legacy mode needs at least one lag to know the last risk level")
    merged = merge_price_and_risk(price, risk, price_col, risk_col, lags, mode, exog_cols, keys)
    if mode == "legacy":
        design, level = merged, F.col("risk_lag1")
        phase, seed = F.lit(0.0), F.array(*[f"y_lag{k}" for k in range(1, lags + 1)])
    else:
        design = auto_features(merged.frame, p, q, include_seasonal, season_period, exog_cols, keys)
        level, seed = F.col("risk"), F.array().cast("array<double>")
        # A dated table starts the season at the ISO week of its last row.
        phase = F.pmod(F.weekofyear("date"), F.lit(season_period)).cast("double") if include_seasonal else F.lit(0.0)
    last = F.struct("date", level.alias("level"), seed.alias("seed"), phase.alias("phase"))
    state = merged.frame.groupBy(*keys).agg(F.max_by(last, F.col("date")).alias("_last"))
    # Price of the last training week, else the last price there is.
    priced = price.select(*keys, "date", F.col(price_col).alias("_p"))
    on_last = (
        priced.join(state.select(*keys, F.col("_last.date").alias("_day")), keys, "inner")
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("date") == F.col("_day"), F.col("_p"))).alias("_exact"),
            F.max_by(F.struct("_p"), F.col("date")).alias("_newest"),
        )
        .select(*keys, F.coalesce("_exact", "_newest._p").alias("last_price"))
    )
    params = (
        fit_ols(design)
        .join(state, keys, "inner")
        .join(on_last, keys, "inner")
        .withColumns(
            {
                "risk_path": F.array(F.col("_last.level")),
                "y_seed": F.col("_last.seed"),
                "season_phase": F.col("_last.phase"),
                "last_date": F.col("_last.date"),
            }
        )
        .drop("_last")
    )
    longest = max(max(1, h // 7) for h in horizons)
    path = with_return_band(recursive_forecast(params, design.features, longest, season_period, keys=keys))
    wanted = path.withColumn("horizon_days", F.explode(F.lit(horizons))).where(F.col("step") == weekly_steps("horizon_days"))
    return wanted.select(
        *keys, "horizon_days", F.col("step").alias("steps"), "price_forecast", "cum_return", "lo95", "hi95"
    )
