"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Each query is a SELECT over named building blocks; :func:`sql` puts the blocks it needs in
front of it.  Text is generated only where the number of columns depends on the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from cropwind.operators.hedge import PROFILES, SENTENCES
from cropwind.plans.panels import PANEL_CONFIG


def week(day: str) -> str:
    return f"CAST(date_trunc('week', {day} + INTERVAL 2 DAY) + INTERVAL 4 DAY AS DATE)"


def rounded(value: str, digits: int | None = None) -> str:
    """Output form of a double in either engine: 6 decimals, or ``digits`` decimals of a column
    that grows with the exponential of a fit, of which 7 leading digits are kept."""
    if digits is None:
        result = f"round({value}, 6)"
    else:
        scaled = f"({value}) * 1e{digits}"
        unit = f"pow(10, greatest(floor(log10(greatest(abs({scaled}), 1))) - 6, 0))"
        result = f"round({scaled} / {unit}) * {unit} / 1e{digits}"
    return f"CASE WHEN {result} = 0 THEN 0e0 ELSE {result} END"


def r(value: str, digits: int | None = None, name: str | None = None) -> str:
    """Rounded output column without a negative zero."""
    return f"{rounded(value, digits)} AS {name or value}"


def day(value: str = "date", name: str | None = None) -> str:
    return f"strftime({value}, '%Y-%m-%d') AS {name or value}"


def whole(value: str, name: str | None = None) -> str:
    return f"CAST({value} AS BIGINT) AS {name or value}"


BLOCKS: dict[str, str] = {}


def _block(name: str, text: str) -> None:
    BLOCKS[name] = text


# Daily panels.
_block(
    "daily_weather",
    """SELECT r_name AS region_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) / count(*) AS temp,
       CAST(sum(l_linenumber) AS DOUBLE) AS precip
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
_block(
    "daily_station",
    """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) / count(*) AS temp,
       CAST(sum(l_linenumber) AS DOUBLE) AS precip FROM lineitem GROUP BY 1, 2""",
)
_block(
    "daily_market",
    """SELECT lower(c_mktsegment) AS commodity, CAST(o_orderdate AS DATE) AS date,
       arg_max(o_totalprice, o_orderkey) AS close
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
_block(
    "daily_vendor",
    """SELECT l_suppkey AS vendor_id, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close
FROM lineitem GROUP BY 1, 2""",
)
_block(
    "daily_supply",
    """SELECT r_name AS region_id, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS prod_estimate,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS stocks
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)


def _weekly_blocks(name: str, source: str, key: str, aggregates: dict[str, str], zero: Iterable[str] = ()) -> None:
    """Weekly aggregation and the calendar of every week between a key's first and last one."""
    parts = ", ".join(f"{expr} AS {column}" for column, expr in aggregates.items())
    _block(f"{name}_present", f"SELECT {key}, {week('date')} AS date, {parts} FROM {source} GROUP BY 1, 2")
    _block(
        f"{name}_calendar",
        f"""SELECT {key}, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date
FROM (SELECT {key}, min(date) AS lo, max(date) AS hi FROM {name}_present GROUP BY 1) AS ends""",
    )
    values = ", ".join(f"coalesce(w.{c}, 0.0) AS {c}" if c in zero else f"w.{c}" for c in aggregates)
    _block(
        name,
        f"""SELECT c.{key}, c.date, {values}
FROM {name}_calendar c LEFT JOIN {name}_present w ON c.{key} = w.{key} AND c.date = w.date""",
    )


_WEATHER = {"temp": "avg(temp)", "precip": "coalesce(sum(precip), 0.0)"}
_weekly_blocks("weekly_weather", "daily_weather", "region_id", _WEATHER, ["precip"])
_weekly_blocks("weekly_station", "daily_station", "station_id", _WEATHER, ["precip"])
_weekly_blocks(
    "weekly_supply", "daily_supply", "region_id", {"prod_estimate": "avg(prod_estimate)", "stocks": "avg(stocks)"}
)


def _anomaly_block(name: str, source: str, key: str) -> None:
    z = lambda c: (
        f"CASE WHEN stddev_pop({c}) OVER h IS NULL OR min({c}) OVER h = max({c}) OVER h THEN 0.0 "
        f"ELSE ({c} - avg({c}) OVER h) / stddev_pop({c}) OVER h END AS {c}_anom"
    )
    _block(
        name,
        f"""SELECT {key}, date, {z('temp')}, {z('precip')}, 0.0::DOUBLE AS ndvi, 0.0::DOUBLE AS enso
FROM {source} WINDOW h AS (PARTITION BY {key})""",
    )


_anomaly_block("weather", "weekly_weather", "region_id")
_anomaly_block("station_weather", "weekly_station", "station_id")

# Region configuration as a literal table; a factor that a region does not list is NULL.
_FACTORS = ("temp_anom", "precip_anom", "ndvi", "enso")


def _config_rows() -> str:
    rows = []
    for commodity, region_id, weight, factors in PANEL_CONFIG.rows():
        listed = ", ".join(f"{factors[f]}::DOUBLE" if f in factors else "NULL::DOUBLE" for f in _FACTORS)
        rows.append(f"('{commodity}', '{region_id}', {weight}::DOUBLE, {listed})")
    return ",\n  ".join(rows)


_block(
    "config",
    f"SELECT * FROM (VALUES\n  {_config_rows()}\n) AS t(commodity, region_id, weight, "
    + ", ".join(f"w_{f}" for f in _FACTORS)
    + ")",
)
_block(
    "score",
    f"""SELECT commodity, region_id, date, weight, avg(100.0 / (1.0 + exp(-mix))) AS regional_score FROM (
  SELECT c.commodity, c.region_id, w.date, c.weight,
         ({' + '.join(f'CASE WHEN w_{f} IS NULL THEN 0.0 ELSE w_{f} * {f} END' for f in _FACTORS)})
         / ({' + '.join(f'coalesce(w_{f}, 0.0)' for f in _FACTORS)}) AS mix
  FROM weather w JOIN config c ON w.region_id = c.region_id) AS mixed GROUP BY 1, 2, 3, 4""",
)
_block(
    "risk_index",
    """SELECT commodity, date, sum(coalesce(regional_score * weight, 0.0)) AS global_risk_0_100
FROM score GROUP BY 1, 2""",
)


def _market_blocks(prefix: str, source: str, key: str) -> None:
    _block(
        f"{prefix}_returns",
        f"""SELECT {key}, date, close, known / nullif(lag(known) OVER (PARTITION BY {key} ORDER BY date), 0) - 1 AS ret
FROM (SELECT *, last_value(close IGNORE NULLS) OVER (
        PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
      FROM {source}) AS filled""",
    )
    _block(
        f"{prefix}_vol",
        f"""SELECT {key}, date, close, ret,
       CASE WHEN count(ret) OVER f >= 10 THEN stddev_samp(ret) OVER f * sqrt(252) END AS vol
FROM {prefix}_returns WINDOW f AS (PARTITION BY {key} ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    )
    _weekly_blocks(
        prefix,
        f"{prefix}_vol",
        key,
        {
            "price_spot": "arg_max(close, date) FILTER (WHERE close IS NOT NULL)",
            "realized_vol_30d": "arg_max(vol, date) FILTER (WHERE vol IS NOT NULL)",
        },
    )


_market_blocks("market", "daily_market", "commodity")
_market_blocks("vendor_market", "daily_vendor", "vendor_id")

# The risk of a vendor is the score of its region in the automobile mix.
_block(
    "vendor_risk",
    """SELECT s_suppkey AS vendor_id, date, regional_score AS global_risk_0_100
FROM score JOIN region ON region_id = r_name JOIN nation ON n_regionkey = r_regionkey
     JOIN supplier ON s_nationkey = n_nationkey WHERE commodity = 'automobile'""",
)


def _model_blocks(name: str, market: str, risk: str, key: str) -> None:
    """Joined weeks with the log return, and both design tables."""
    _block(
        f"{name}_joined",
        f"""SELECT {key}, date, price, risk,
       CASE WHEN price > 0 AND lag(price) OVER o > 0 THEN ln(price / lag(price) OVER o) END AS y
FROM (SELECT m.{key}, m.date, m.price_spot AS price, i.global_risk_0_100 AS risk
      FROM {market} m JOIN {risk} i ON m.{key} = i.{key} AND m.date = i.date) AS j
WINDOW o AS (PARTITION BY {key} ORDER BY date)""",
    )
    _block(
        f"{name}_legacy",
        f"""SELECT * FROM (
  SELECT {key}, date, price, y, lag(y) OVER o AS y_lag1, lag(risk / 100) OVER o AS risk_lag1
  FROM {name}_joined WHERE price IS NOT NULL AND risk IS NOT NULL AND y IS NOT NULL
  WINDOW o AS (PARTITION BY {key} ORDER BY date)) AS lagged
WHERE y_lag1 IS NOT NULL AND risk_lag1 IS NOT NULL""",
    )
    _block(
        f"{name}_auto_base",
        f"""SELECT {key}, date, y, risk / 100 AS risk FROM {name}_joined
WHERE price IS NOT NULL AND risk IS NOT NULL AND y IS NOT NULL""",
    )
    # The weekly model takes its lags before rows with NULLs are dropped; the library's auto mode after.
    for design, source in ((f"{name}_weekly", f"{name}_joined"), (f"{name}_auto", f"{name}_auto_base")):
        _block(
            design,
            f"""SELECT {key}, date, y, y_lag1, y_lag2, risk_lag1, risk_lag2,
       sin(2 * pi() / 52 * t) AS season_sin, cos(2 * pi() / 52 * t) AS season_cos
FROM (SELECT {key}, date, y, lag(y) OVER o AS y_lag1, lag(y, 2) OVER o AS y_lag2,
             lag(unit) OVER o AS risk_lag1, lag(unit, 2) OVER o AS risk_lag2, row_number() OVER o - 1 AS t
      FROM (SELECT *, CASE WHEN max(risk) OVER (PARTITION BY {key}) > 1.5 THEN risk / 100 ELSE risk END AS unit
            FROM {source}) AS scaled
      WINDOW o AS (PARTITION BY {key} ORDER BY date)) AS lagged
WHERE y IS NOT NULL AND y_lag2 IS NOT NULL AND y_lag1 IS NOT NULL AND risk_lag1 IS NOT NULL AND risk_lag2 IS NOT NULL""",
        )


_model_blocks("model", "market", "risk_index", "commodity")
_model_blocks("vendor", "vendor_market", "vendor_risk", "vendor_id")

LEGACY = ("y_lag1", "risk_lag1")
WEEKLY = ("y_lag1", "y_lag2", "risk_lag1", "risk_lag2", "season_sin", "season_cos")
TWO_LAGS = ("y_lag1", "risk_lag1", "y_lag2", "risk_lag2")
EXOG = (*WEEKLY, "exog_output")

_block(
    "model_two_lags",
    """SELECT * FROM (
  SELECT commodity, date, y, lag(y) OVER o AS y_lag1, lag(risk / 100) OVER o AS risk_lag1,
         lag(y, 2) OVER o AS y_lag2, lag(risk / 100, 2) OVER o AS risk_lag2
  FROM model_joined WHERE price IS NOT NULL AND risk IS NOT NULL AND y IS NOT NULL
  WINDOW o AS (PARTITION BY commodity ORDER BY date)) AS lagged
WHERE y_lag1 IS NOT NULL AND risk_lag1 IS NOT NULL AND y_lag2 IS NOT NULL AND risk_lag2 IS NOT NULL""",
)
# Weeks with an output of the regions; returns run over these weeks alone.
_block(
    "model_exog_base",
    """SELECT * FROM (
  SELECT commodity, date, risk, exog_output,
         CASE WHEN price > 0 AND lag(price) OVER o > 0 THEN ln(price / lag(price) OVER o) END AS y
  FROM (SELECT m.commodity, m.date, m.price_spot AS price, i.global_risk_0_100 / 100 AS risk, s.exog_output
        FROM market m JOIN risk_index i ON m.commodity = i.commodity AND m.date = i.date
        JOIN (SELECT date, avg(prod_estimate) AS exog_output FROM weekly_supply GROUP BY 1) AS s ON s.date = m.date) AS j
  WINDOW o AS (PARTITION BY commodity ORDER BY date)) AS returned
WHERE y IS NOT NULL AND risk IS NOT NULL AND exog_output IS NOT NULL""",
)
_block(
    "model_exog",
    """SELECT commodity, date, y, y_lag1, y_lag2, risk_lag1, risk_lag2,
       sin(2 * pi() / 52 * t) AS season_sin, cos(2 * pi() / 52 * t) AS season_cos, exog_output
FROM (SELECT *, lag(y) OVER o AS y_lag1, lag(y, 2) OVER o AS y_lag2, lag(risk) OVER o AS risk_lag1,
             lag(risk, 2) OVER o AS risk_lag2, row_number() OVER o - 1 AS t
      FROM model_exog_base WINDOW o AS (PARTITION BY commodity ORDER BY date)) AS lagged
WHERE y_lag2 IS NOT NULL AND risk_lag2 IS NOT NULL""",
)


def _least_squares_blocks(design: str, key: str, features: tuple[str, ...]) -> None:
    """Normal equations by Gauss-Jordan elimination, one block per pivot, then the residuals."""
    x = ["1.0::DOUBLE", *features]
    k = len(x)
    cells = [f"sum({x[i]} * {x[j]}) AS a_{i}_{j}" for i in range(k) for j in range(k)]
    right = [f"sum({x[i]} * y) AS c_{i}" for i in range(k)]
    _block(f"{design}_e0", f"SELECT {key}, count(*) AS n_obs, {', '.join(cells + right)} FROM {design} GROUP BY 1")
    for p in range(k):
        out = []
        for i in range(k):
            for j in range(p + 1, k):
                scaled = f"a_{p}_{j} / a_{p}_{p}"
                out.append(f"{scaled} AS a_{p}_{j}" if i == p else f"a_{i}_{j} - a_{i}_{p} * ({scaled}) AS a_{i}_{j}")
            scaled = f"c_{p} / a_{p}_{p}"
            out.append(f"{scaled} AS c_{i}" if i == p else f"c_{i} - a_{i}_{p} * ({scaled}) AS c_{i}")
        _block(f"{design}_e{p + 1}", f"SELECT {key}, n_obs, {', '.join(out)} FROM {design}_e{p}")
    fitted = " + ".join(["c_0", *[f"c_{i} * {f}" for i, f in enumerate(features, 1)]])
    _block(
        f"{design}_fit",
        f"""SELECT {key}, n_obs, {', '.join(f'c_{i}' for i in range(k))},
       sum((y - ({fitted})) * (y - ({fitted}))) / greatest(1, n_obs - {k}) AS resid_var
FROM {design} JOIN {design}_e{k} USING ({key}) GROUP BY {key}, n_obs, {', '.join(f'c_{i}' for i in range(k))}""",
    )


_least_squares_blocks("model_legacy", "commodity", LEGACY)
_least_squares_blocks("model_weekly", "commodity", WEEKLY)
_least_squares_blocks("model_auto", "commodity", WEEKLY)
_least_squares_blocks("vendor_weekly", "vendor_id", WEEKLY)
_least_squares_blocks("model_two_lags", "commodity", TWO_LAGS)
_least_squares_blocks("model_exog", "commodity", EXOG)


def _weekly_forecast_blocks(name: str, key: str) -> None:
    """State of each series and the eight-week recursion; all return lags follow the newest forecast."""
    _block(
        f"{name}_state",
        f"""SELECT {key}, max(date) AS last_date, arg_max(price, place) AS last_price,
       CAST((count(*) - 1) % 52 AS DOUBLE) AS phase,
       list(unit ORDER BY date) FILTER (WHERE place > n - 10) AS path
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS place,
             count(*) OVER (PARTITION BY {key}) AS n,
             CASE WHEN max(risk) OVER (PARTITION BY {key}) > 1.5 THEN risk / 100 ELSE risk END AS unit
      FROM {name}_joined) AS placed GROUP BY 1""",
    )
    risk = lambda step: (
        f"c_3 * path[least({step}, len(path))] + c_4 * path[least({step} + 1, len(path))]"
        f" + c_5 * sin(2 * pi() / 52 * (phase + {step})) + c_6 * cos(2 * pi() / 52 * (phase + {step}))"
    )
    _block(
        f"{name}_path",
        f"""SELECT s.*, f.resid_var, f.c_1 + f.c_2 AS carry, c_0, c_3, c_4, c_5, c_6, 1 AS step,
       c_0 + {risk('1')} AS y, c_0 + {risk('1')} AS cum
  FROM {name}_state s JOIN {name}_weekly_fit f USING ({key})
  UNION ALL
  SELECT * EXCLUDE (step, y, cum), step + 1, c_0 + carry * y + {risk('(step + 1)')},
         cum + c_0 + carry * y + {risk('(step + 1)')}
  FROM {name}_path WHERE step < 8""",
    )
    _block(
        f"{name}_forecast",
        f"""SELECT {key}, CAST(sunday + 7 * step AS DATE) AS date, step, y AS y_forecast,
       last_price * exp(cum) AS price_forecast,
       CASE WHEN resid_var > 0 THEN last_price * exp(cum - 1.96 * sqrt(resid_var * step))
            ELSE last_price * exp(cum) END AS price_lo95,
       CASE WHEN resid_var > 0 THEN last_price * exp(cum + 1.96 * sqrt(resid_var * step))
            ELSE last_price * exp(cum) END AS price_hi95
FROM (SELECT *, last_date + CAST((7 - dayofweek(last_date)) % 7 AS INTEGER) AS sunday FROM {name}_path) AS dated""",
    )


_weekly_forecast_blocks("model", "commodity")
_weekly_forecast_blocks("vendor", "vendor_id")

# Horizon forecasts keep the risk at its last level and start from the last training row.
_block(
    "legacy_path",
    """SELECT commodity, c_0 + c_2 * d.risk_lag1 AS drift, c_1, resid_var, d.date AS last_date, 1 AS step,
       c_0 + c_2 * d.risk_lag1 + c_1 * d.y_lag1 AS y, c_0 + c_2 * d.risk_lag1 + c_1 * d.y_lag1 AS cum
  FROM model_legacy d JOIN (SELECT commodity, max(date) AS date FROM model_legacy GROUP BY 1) AS newest
       USING (commodity, date) JOIN model_legacy_fit USING (commodity)
  UNION ALL
  SELECT commodity, drift, c_1, resid_var, last_date, step + 1, drift + c_1 * y, cum + drift + c_1 * y
  FROM legacy_path WHERE step < 12""",
)
def _auto_path_block(mode: str, extra: str = "") -> None:
    season = lambda step: f"c_5 * sin(2 * pi() / 52 * ({step})) + c_6 * cos(2 * pi() / 52 * ({step}))"
    first = f"drift + {season('phase + 1')}"
    later = f"drift + carry * y + {season('phase + step + 1')}"
    _block(
        f"{mode}_path",
        f"""SELECT *, 1 AS step, {first} AS y, {first} AS cum FROM (
  SELECT commodity, c_0 + (c_3 + c_4) * risk{extra} AS drift, c_1 + c_2 AS carry, c_5, c_6, resid_var, date AS last_date,
         CAST(weekofyear(date) % 52 AS DOUBLE) AS phase
  FROM model_{mode}_base JOIN (SELECT commodity, max(date) AS date FROM model_{mode}_base GROUP BY 1) AS newest
       USING (commodity, date) JOIN model_{mode}_fit USING (commodity)) AS begun
  UNION ALL
  SELECT * EXCLUDE (step, y, cum), step + 1, {later}, cum + {later} FROM {mode}_path WHERE step < 12""",
    )


_auto_path_block("auto")
_auto_path_block("exog", " + c_7 * exog_output")
for _mode in ("legacy", "auto", "exog"):
    _block(
        f"{_mode}_horizons",
        f"""SELECT commodity, horizon_days, step AS steps, last_price * exp(cum) AS price_forecast, cum AS cum_return,
       cum - 1.96 * sqrt(resid_var * step) AS lo95, cum + 1.96 * sqrt(resid_var * step) AS hi95
FROM {_mode}_path
JOIN (SELECT unnest([30, 60, 90]) AS horizon_days) AS horizons ON step = greatest(1, horizon_days // 7)
JOIN (SELECT commodity, date AS last_date, price_spot AS last_price FROM market) AS prices USING (commodity, last_date)""",
    )

_profiles = ", ".join(f"('{n}', {v['base']}, {v['bump']}, {v['threshold']})" for n, v in PROFILES.items())
_block("profiles", f"SELECT * FROM (VALUES {_profiles}) AS t(profile, base, bump, threshold)")
_block(
    "decision_state",
    """SELECT commodity, last_price, coalesce(prev_price, last_price) AS prev_price, last_day, risk_score FROM (
  SELECT commodity, max(date) AS last_day, max(CASE WHEN step = 8 THEN price_forecast END) AS last_price,
         max(CASE WHEN step = 7 THEN price_forecast END) AS prev_price FROM model_forecast GROUP BY 1) AS f
JOIN (SELECT commodity, arg_max(global_risk_0_100, date) AS risk_score FROM risk_index GROUP BY 1) AS i USING (commodity)""",
)
_block(
    "hedge",
    """SELECT commodity, profile, role, 10000.0::DOUBLE AS exposure, 8 AS forecast_horizon_weeks, scenario, risk_score,
       hedge_ratio, hedge_ratio * 10000.0 AS hedge_notional,
       CASE WHEN role = 'importer' AND scenario = 'baseline' THEN 'long call options'
            WHEN role = 'importer' THEN 'long futures'
            WHEN scenario = 'baseline' THEN 'long put options' ELSE 'short futures' END AS instrument,
       last_price AS forecast_price,
       strftime(last_day - CAST((dayofweek(last_day) + 3) % 7 AS INTEGER), '%Y-%m-%d') AS instrument_maturity,
       last_price AS instrument_strike
FROM (SELECT *, least(greatest(base + CASE WHEN risk_score >= threshold THEN bump ELSE 0 END
                 + CASE scenario WHEN 'bullish' THEN 0.05 WHEN 'extreme' THEN 0.10 ELSE 0 END, 0), 1)::DOUBLE AS hedge_ratio
      FROM (SELECT *, CASE WHEN last_price > prev_price * 1.02 THEN 'bullish'
                           WHEN last_price < prev_price * 0.98 THEN 'extreme' ELSE 'baseline' END AS scenario
            FROM decision_state, profiles, (VALUES ('importer'), ('exporter')) AS roles(role)) AS judged) AS sized""",
)


def _said(sentence: str, *parts: str) -> str:
    """A sentence of the rationale with its values, as printf would write it."""
    text = SENTENCES[sentence].replace("'", "''")
    return f"printf('{text}', {', '.join(parts)})" if parts else f"'{text}'"


# What advice is told from: the price has the digits that both engines agree on, and the ratio is a sum
# of doubles, as texts show on which side of a half an amount lies.
_block(
    "advice",
    f"""SELECT * REPLACE (hedge_ratio * exposure AS hedge_notional) FROM (
  SELECT h.* REPLACE ({rounded('forecast_price', 2)} AS forecast_price, {rounded('instrument_strike', 2)} AS instrument_strike,
         least(greatest(base::DOUBLE + CASE WHEN risk_score >= threshold THEN bump::DOUBLE ELSE 0e0 END
               + CASE scenario WHEN 'bullish' THEN 5e-2 WHEN 'extreme' THEN 1e-1 ELSE 0e0 END, 0e0), 1e0) AS hedge_ratio),
         base, bump, threshold FROM hedge AS h JOIN profiles USING (profile)) AS summed""",
)
_block(
    "customer_requests",
    """SELECT lower(c_mktsegment) AS commodity, profile, role, round(sum(c_acctbal), 2) AS asked FROM (
  SELECT *, CASE WHEN c_acctbal > 6000 THEN 'opportunistic' WHEN c_acctbal > 2000 THEN 'balanced' ELSE 'conservative' END AS profile,
         CASE WHEN r_name IN ('EUROPE', 'ASIA') THEN 'importer' ELSE 'exporter' END AS role
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS typed
GROUP BY 1, 2, 3""",
)


def rationale(advice: str) -> str:
    """``advice`` with the columns ``summary`` and ``justification``."""
    told = f"""concat_ws(' ', {_said('base', 'profile', "printf('%.0f%%', base * 100)")},
      CASE WHEN risk_score >= threshold THEN {_said('high_risk', "printf('%.1f', risk_score)", "printf('%.1f', threshold)", "printf('%.0f%%', bump * 100)")}
           ELSE {_said('low_risk', "printf('%.1f', risk_score)", "printf('%.1f', threshold)")} END,
      CASE scenario WHEN 'bullish' THEN {_said('bullish')} WHEN 'extreme' THEN {_said('extreme')} ELSE {_said('baseline')} END,
      {_said('position', 'role', 'instrument', "printf('%.2f', exposure)", "printf('%.2f', hedge_notional)", "printf('%.0f%%', hedge_ratio * 100)")})"""
    strike = "printf('%.2f', instrument_strike)"
    return f"""SELECT *, concat_ws(' ', summary,
       CASE WHEN contains(instrument, 'option') THEN {_said('option_strike', strike)} ELSE {_said('future_strike', strike)} END,
       {_said('closing', "printf('%.1f', risk_score)", 'profile', 'role')}) AS justification
FROM (SELECT *, {told} AS summary FROM ({advice}) AS given) AS summed"""


_block(
    "pct_band",
    """SELECT commodity, date, (price_forecast / base - 1) * 100 AS ret_pct, (price_lo95 / base - 1) * 100 AS ret_lo95,
       (price_hi95 / base - 1) * 100 AS ret_hi95
FROM (SELECT *, arg_max(price_forecast, date) OVER (PARTITION BY commodity) AS base FROM model_forecast) AS based
WHERE base <> 0""",
)


def _needed(text: str) -> list[str]:
    """Blocks used by ``text``, dependencies first."""
    order: list[str] = []

    def visit(body: str, own: str | None) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", body)):
            if name in BLOCKS and name != own and name not in order:
                visit(BLOCKS[name], name)
                order.append(name)

    visit(text, None)
    return order


def sql(select: str) -> str:
    """The query with its building blocks."""
    blocks = _needed(select)
    if not blocks:
        return select
    body = ",\n".join(f"{name} AS ({BLOCKS[name]})" for name in blocks)
    return f"WITH RECURSIVE {body}\n{select}"
