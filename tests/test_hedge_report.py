from __future__ import annotations

import datetime as dt

import pytest
from conftest import d, fridays
from pyspark.sql import functions as F

from cropwind.operators import hedge as H
from cropwind.operators import report as R

AS_OF = dt.datetime(2024, 2, 1, 10, 30)
STATE = "commodity string, last_price_forecast double, prev_price_forecast double, last_forecast_date date, risk_score double"


def state(spark, last=100.0, prev=100.0, risk=50.0, day="2024-01-05"):
    return spark.createDataFrame([("wheat", last, prev, d(day) if day else None, risk)], STATE)


def advice(spark, profile="balanced", role="importer", exposure=10000.0, **values):
    return H.recommend(H.with_request_grid(state(spark, **values), [profile], [role], exposure), AS_OF).first()


@pytest.mark.parametrize(
    "last, prev, expected",
    [(102.0, 100.0, "baseline"), (102.01, 100.0, "bullish"), (98.0, 100.0, "baseline"), (97.99, 100.0, "extreme"), (100.0, 100.0, "baseline")],
)
def test_scenario_edges_are_strict(spark, last, prev, expected):
    assert advice(spark, last=last, prev=prev)["scenario"] == expected


@pytest.mark.parametrize(
    "profile, last, risk, ratio",
    [("conservative", 100.0, 70.0, 0.80), ("conservative", 110.0, 69.9, 0.65), ("balanced", 90.0, 75.0, 0.70), ("opportunistic", 110.0, 80.0, 0.35)],
)
def test_ratio_rules(spark, profile, last, risk, ratio):
    row = advice(spark, profile, last=last, risk=risk)
    assert row["hedge_ratio"] == pytest.approx(ratio)
    assert row["hedge_notional"] == pytest.approx(ratio * 10000.0)
    assert 0.0 <= row["hedge_ratio"] <= 1.0


def test_instruments(spark):
    grid = H.with_request_grid(state(spark).unionAll(state(spark, last=110.0).withColumn("commodity", F.lit("corn"))))
    got = {(r["commodity"], r["role"]): r["instrument"] for r in H.recommend(grid, AS_OF).collect()}
    assert got == {
        ("wheat", "importer"): "long call options", ("wheat", "exporter"): "long put options",
        ("corn", "importer"): "long futures", ("corn", "exporter"): "short futures",
    }
    assert grid.count() == 12


@pytest.mark.parametrize("day, maturity", [("2024-01-04", "2024-01-04"), ("2024-01-07", "2024-01-04"), (None, "2024-02-01")])
def test_maturity_is_the_last_thursday(spark, day, maturity):
    assert advice(spark, day=day)["instrument_maturity"] == maturity


def test_rationale_text(spark):
    row = advice(spark, last=110.0, risk=80.25)
    assert row["summary"] == (
        "Base hedge ratio for balanced profile: 45%. Climate risk 80.2 exceeds profile threshold 75.0 → add bump 15%. "
        "Bullish ARIMAX forecast (price trending up) → increase hedge ratio by 5 pp. "
        "Role: importer → use 'long futures'. Exposure 10000.00 → hedge 6500.00 units (hedge ratio 65%)."
    )
    assert row["justification"] == row["summary"] + (
        " For futures, the economic 'strike' is the forward price, here approximated by the ARIMAX forecast (110.00)."
        " Climate risk at 80.2 on a 0–100 scale justifies this level of protection for a balanced importer."
    )
    calm = advice(spark)
    assert "below profile threshold" in calm["summary"] and "For options, we set the strike" in calm["justification"]
    assert row["timestamp"] == "2024-02-01T10:30:00Z" and row["forecast_horizon_weeks"] == 8
    assert H.recommend(H.with_request_grid(state(spark)), AS_OF).columns == H.RECOMMENDATION_COLUMNS


def test_unknown_profiles_are_refused(spark):
    with pytest.raises(KeyError):
        H.with_request_grid(state(spark), ["bold"])
    asked = spark.createDataFrame([("wheat", "bold", "importer", 1.0)], "commodity string, profile string, role string, exposure double")
    with pytest.raises(Exception, match="unknown hedge profile: bold"):
        H.recommend(H.with_requests(state(spark), asked), AS_OF).collect()


def test_requests_meet_their_own_commodity(spark):
    asked = spark.createDataFrame(
        [("wheat", "balanced", "importer", 10), ("tea", "balanced", "importer", 10)], "commodity string, profile string, role string, exposure int"
    )
    rows = H.recommend(H.with_requests(state(spark), asked), AS_OF).collect()
    assert [(r["commodity"], r["hedge_notional"]) for r in rows] == [("wheat", 4.5)]


@pytest.fixture()
def gold(spark):
    weeks = fridays(3)
    forecast = spark.createDataFrame(
        [("wheat", w, p, p - 10, p + 20) for w, p in zip(weeks, [100.0, 110.0, 120.0])] + [("corn", weeks[0], 50.0, 50.0, 50.0)],
        "commodity string, date date, price_forecast double, price_lo95 double, price_hi95 double",
    )
    index = spark.createDataFrame([(c, w, 10.0 * i) for c in ("wheat", "corn") for i, w in enumerate(weeks)], "commodity string, date date, global_risk_0_100 double")
    return forecast, index


def test_latest_state_of_a_single_forecast(gold):
    rows = {r["commodity"]: r for r in H.latest_state(*gold).collect()}
    assert rows["corn"]["last_price_forecast"] == rows["corn"]["prev_price_forecast"] == 50.0
    assert (rows["wheat"]["last_price_forecast"], rows["wheat"]["prev_price_forecast"], rows["wheat"]["risk_score"]) == (120.0, 110.0, 20.0)
    with pytest.raises(KeyError):
        H.latest_state(gold[0].drop("price_forecast"), gold[1])


def test_kpis(gold):
    forecast, index = gold
    hedges = H.recommend(H.with_request_grid(H.latest_state(forecast, index)), AS_OF)
    rows = {r["commodity"]: r for r in R.kpi_row(forecast, index, hedges).collect()}
    wheat = rows["wheat"]
    assert (wheat["latest_forecast_price"], wheat["risk_score"], wheat["scenario"], wheat["hedge_legs"]) == (120.0, 20.0, "bullish", 6)
    assert wheat["forecast_change_pct"] == pytest.approx(20.0)
    assert rows["corn"]["forecast_change_pct"] is None
    assert wheat["hedge_notional"] == pytest.approx(2 * 10000 * (0.65 + 0.50 + 0.25))
    unit = index.select("commodity", "date", (F.col("global_risk_0_100") / 100).alias("risk"))
    assert R.kpi_row(forecast, unit, hedges).where("commodity = 'wheat'").first()["risk_score"] == pytest.approx(20.0)


def test_bands_and_domains(gold):
    forecast, _ = gold
    pct = R.pct_band_series(forecast)
    row = pct.where("commodity = 'wheat'").orderBy("date").first()
    assert row["ret_pct"] == pytest.approx((100 / 120 - 1) * 100) and row["ret_hi95"] == pytest.approx(0.0)
    domains = {r["commodity"]: (r["domain_min"], r["domain_max"]) for r in R.forecast_domain(forecast).collect()}
    assert domains["wheat"] == (pytest.approx(90 - 2.5), pytest.approx(140 + 2.5))
    assert domains["corn"] == (pytest.approx(49 - 0.1), pytest.approx(51 + 0.1))
    flat = {r["commodity"]: (r["domain_min"], r["domain_max"]) for r in R.pct_domain(pct).collect()}
    assert flat["corn"] == (pytest.approx(-0.12), pytest.approx(0.12))
    zero = forecast.withColumn("price_forecast", F.lit(0.0))
    assert R.pct_band_series(zero).count() == 0
    assert R.forecast_band_series(forecast).columns == ["commodity", "date", "price_forecast", "price_lo95", "price_hi95"]


def test_histories(spark):
    weeks = [d("2022-01-31"), d("2023-01-31"), d("2024-01-31")]
    market = spark.createDataFrame([("Wheat", w, float(i)) for i, w in enumerate(weeks)] + [("corn", weeks[0], 9.0)], "commodity string, date date, settlement double")
    assert {r["price"] for r in R.price_history(market, "12M", "wheat").collect()} == {1.0, 2.0}
    assert R.price_history(market, "24M").count() == 4 and R.price_history(market, "All").count() == 4
    assert R.trailing_window(market, "a year").count() == 4
    prints = spark.createDataFrame(
        [("corn", weeks[0], None, 1), ("corn", weeks[0], 2.0, 2), ("corn", weeks[0], 3.0, 3), ("corn", None, 4.0, 4)], "commodity string, date date, price_spot double, seq int"
    )
    assert [r["price_spot"] for r in R.price_history_dedup(prints, ["seq"], "CORN").collect()] == [2.0]
    risk = market.select("commodity", "date", F.col("settlement").alias("risk"), F.lit(5.0).alias("global_risk_0_100"))
    assert R.risk_history(risk, "All").agg(F.max("risk_value")).first()[0] == 9.0


def test_summary_tables(spark):
    hedges = H.recommend(H.with_request_grid(state(spark, risk=50.25), ["balanced"], ["importer"], 12345.0), AS_OF)
    lines = [(r["label"], r["value"]) for r in R.hedge_summary_table(hedges).orderBy("position").collect()]
    assert lines == [
        ("Profile", "Balanced"), ("Role", "Importer"), ("Scenario", "Baseline"), ("Risk Score", "50.2 / 100"),
        ("Forecast Horizon", "8 weeks"), ("Exposure", "12,345 USD"), ("Suggested Hedge Ratio", "45.0%"),
        ("Hedge Notional", "5,555 units"), ("Instrument", "Long call options"),
    ]
    detail = {r["label"]: r["value"] for r in R.hedge_detail_table(hedges).collect()}
    assert detail["Maturity"] == "2024-01-04" and detail["Strike"] == "100.0" and len(detail) == 8
