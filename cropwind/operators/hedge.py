"""Hedge recommendations for every commodity, profile and role in one projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.functions.calendar import last_thursday
from cropwind.functions.columns import require_columns
from cropwind.functions.numeric import clamp
from cropwind.functions.text import fixed, percent
from cropwind.operators.design import RISK, last_two

# Base ratio, bump at high risk, risk threshold per profile.
PROFILES = {
    "conservative": {"base": 0.60, "bump": 0.20, "threshold": 70.0},
    "balanced": {"base": 0.45, "bump": 0.15, "threshold": 75.0},
    "opportunistic": {"base": 0.20, "bump": 0.10, "threshold": 80.0},
}
ROLES = ("importer", "exporter")

# Price moves that make a scenario, and what each adds to the ratio.
RISE, FALL = 1.02, 0.98
BULLISH_EXTRA, EXTREME_EXTRA = 0.05, 0.10

# The sentences of the rationale.
SENTENCES = {
    "base": "Base hedge ratio for %s profile: %s.",
    "high_risk": "Climate risk %s exceeds profile threshold %s → add bump %s.",
    "low_risk": "Climate risk %s is below profile threshold %s → no additional bump.",
    "bullish": "Bullish ARIMAX forecast (price trending up) → increase hedge ratio by 5 pp.",
    "extreme": "Extreme ARIMAX forecast (sharp move) → increase hedge ratio by 10 pp.",
    "baseline": "Baseline ARIMAX forecast (no strong trend) → keep profile hedge ratio unchanged.",
    "position": "Role: %s → use '%s'. Exposure %s → hedge %s units (hedge ratio %s).",
    "option_strike": "For options, we set the strike close to the ARIMAX fair value (%s), "
    "so that the hedge is activated around the model-implied price.",
    "future_strike": "For futures, the economic 'strike' is the forward price, "
    "here approximated by the ARIMAX forecast (%s).",
    "closing": "Climate risk at %s on a 0–100 scale justifies this level of protection for a %s %s.",
}

# The recommendation table's columns.
RECOMMENDATION_COLUMNS = [
    "commodity",
    "profile",
    "role",
    "exposure",
    "forecast_horizon_weeks",
    "scenario",
    "risk_score",
    "hedge_ratio",
    "hedge_notional",
    "instrument",
    "forecast_price",
    "instrument_maturity",
    "instrument_strike",
    "summary",
    "justification",
    "timestamp",
]


def latest_state(forecast: DataFrame, index: DataFrame) -> DataFrame:
    """One row per commodity: last two forecasts, last forecast week, last risk."""
    require_columns(forecast.columns, ["commodity", "date", "price_forecast"], KeyError)
    require_columns(index.columns, ["commodity", "date", RISK], KeyError)
    prices = last_two(forecast, "price_forecast")
    ends = forecast.groupBy("commodity").agg(F.max("date").alias("last_forecast_date"))
    risk = index.groupBy("commodity").agg(F.max_by(F.struct(RISK), F.col("date")).alias("_risk"))
    return (
        prices.join(ends, "commodity")
        .join(risk.select("commodity", F.col(f"_risk.{RISK}").alias("risk_score")), "commodity")
        .select("commodity", "last_price_forecast", "prev_price_forecast", "last_forecast_date", "risk_score")
    )


def scenario(last: Column, previous: Column) -> Column:
    """``bullish`` above +2%, ``extreme`` below -2%, else ``baseline``."""
    return (
        F.when(last > previous * RISE, "bullish").when(last < previous * FALL, "extreme").otherwise("baseline")
    )


def _profile_value(name: str) -> Column:
    cases = " ".join(f"WHEN '{profile}' THEN {numbers[name]}D" for profile, numbers in PROFILES.items())
    unknown = "CAST(raise_error(concat('unknown hedge profile: ', profile)) AS DOUBLE)"
    return F.expr(f"CASE profile {cases} ELSE {unknown} END")


def with_request_grid(
    state: DataFrame,
    profiles: Iterable[str] = tuple(PROFILES),
    roles: Iterable[str] = ROLES,
    exposure: float = 10000.0,
) -> DataFrame:
    """Repeat each commodity for every profile and role: a literal array, not a join."""
    profiles = list(profiles)
    for name in profiles:
        if name not in PROFILES:
            raise KeyError(f"unknown hedge profile {name!r}")
    grid = F.array(
        *[
            F.struct(F.lit(p).alias("profile"), F.lit(r).alias("role"), F.lit(float(exposure)).alias("exposure"))
            for p in profiles
            for r in roles
        ]
    )
    return state.select("*", F.inline(grid))


def with_requests(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach requests (commodity, profile, role, exposure) to the state of their commodity."""
    return requests.select("commodity", "profile", "role", F.col("exposure").cast("double")).join(state, "commodity", "inner")


def recommend(requested: DataFrame, as_of: dt.datetime, horizon_weeks: int = 8) -> DataFrame:
    """Ratio, instrument, notional, maturity, strike and rationale of each requested hedge.

    ``requested`` comes from :func:`with_request_grid` or :func:`with_requests`.  ``as_of``
    stamps the rows and stands in for a missing forecast date.
    """
    role, risk = F.col("role"), F.col("risk_score")
    last, previous = F.col("last_price_forecast"), F.col("prev_price_forecast")
    sized = requested.select(
        "*",
        scenario(last, previous).alias("scenario"),
        *[_profile_value(n).alias(f"_{n}") for n in ("base", "bump", "threshold")],
    )
    name = F.col("scenario")
    high = risk >= F.col("_threshold")
    extra = F.when(name == "bullish", BULLISH_EXTRA).when(name == "extreme", EXTREME_EXTRA).otherwise(0.0)
    ratio = clamp(F.col("_base") + F.when(high, F.col("_bump")).otherwise(0.0) + extra)
    calm = name == "baseline"
    instrument = F.when(role == "importer", F.when(calm, "long call options").otherwise("long futures")).otherwise(
        F.when(calm, "long put options").otherwise("short futures")
    )
    sized = sized.select("*", ratio.alias("hedge_ratio"), instrument.alias("instrument"))
    sized = sized.withColumn("hedge_notional", F.col("hedge_ratio") * F.col("exposure"))
    maturity = last_thursday(F.coalesce(F.col("last_forecast_date"), F.lit(as_of.date())))
    told = sized.select(
        "*",
        maturity.cast("string").alias("instrument_maturity"),
        _summary(high).alias("summary"),
        F.lit(int(horizon_weeks)).alias("forecast_horizon_weeks"),
        last.alias("forecast_price"),
        last.alias("instrument_strike"),
        F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("timestamp"),
    )
    return told.withColumn("justification", _justification()).select(*RECOMMENDATION_COLUMNS)


def _summary(high: Column) -> Column:
    """What was added to the ratio and why."""
    profile, name = F.col("profile"), F.col("scenario")
    risk, threshold = fixed("risk_score", 1), fixed("_threshold", 1)
    base = _say("base", profile, percent("_base"))
    climate = F.when(high, _say("high_risk", risk, threshold, percent("_bump"))).otherwise(_say("low_risk", risk, threshold))
    trend = F.when(name == "bullish", _say("bullish")).when(name == "extreme", _say("extreme")).otherwise(_say("baseline"))
    position = _say(
        "position",
        F.col("role"),
        F.col("instrument"),
        fixed("exposure", 2),
        fixed("hedge_notional", 2),
        percent("hedge_ratio"),
    )
    return F.concat_ws(" ", base, climate, trend, position)


def _justification() -> Column:
    strike = fixed("instrument_strike", 2)
    about_strike = F.when(F.col("instrument").contains("option"), _say("option_strike", strike)).otherwise(
        _say("future_strike", strike)
    )
    closing = _say("closing", fixed("risk_score", 1), F.col("profile"), F.col("role"))
    return F.concat_ws(" ", F.col("summary"), about_strike, closing)


def _say(sentence: str, *parts: Column) -> Column:
    text = SENTENCES[sentence]
    return F.format_string(text, *parts) if parts else F.lit(text)
