from __future__ import annotations

import math

import pandas as pd
import pytest
from conftest import d, fridays

from cropwind.operators import anomalies, market, weekly


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gap_weeks_have_zero_sum_and_null_mean(spark):
    daily = spark.createDataFrame(
        [("A", d("2024-01-01"), 1.0, 2.0), ("A", d("2024-01-05"), 3.0, 4.0), ("A", d("2024-01-25"), 5.0, 6.0)],
        "region_id string, date date, temp double, precip double",
    )
    assert rows(weekly.weekly_weather(daily), "date") == [
        (d("2024-01-05"), "A", 2.0, 6.0),
        (d("2024-01-12"), "A", None, 0.0),
        (d("2024-01-19"), "A", None, 0.0),
        (d("2024-01-26"), "A", 5.0, 6.0),
    ]
    assert weekly.weekly_weather(daily, fill_gaps=False).count() == 2


def test_last_skips_null_and_undated_rows_are_dropped(spark):
    daily = spark.createDataFrame(
        [("A", d("2024-01-02"), 1.0), ("A", d("2024-01-03"), 2.0), ("A", d("2024-01-04"), None), ("A", None, 9.0)],
        "k string, date date, v double",
    )
    assert rows(weekly.weekly_panel(daily, "k", {"v": "last"}), "date") == [(d("2024-01-05"), "A", 2.0)]
    with pytest.raises(ValueError):
        weekly.weekly_panel(daily, "k", {"v": "median"})


def test_all_null_week_sums_to_zero(spark):
    daily = spark.createDataFrame([("A", d("2024-01-02"), None)], "k string, date date, v double")
    assert rows(weekly.weekly_panel(daily, "k", {"v": "sum"}), "date") == [(d("2024-01-05"), "A", 0.0)]


def test_constant_region_scores_zero_and_null_stays_null_elsewhere(spark):
    weeks = fridays(3)
    frame = spark.createDataFrame(
        [("A", w, 1.0) for w in weeks] + [("B", weeks[0], 1.0), ("B", weeks[1], 3.0), ("B", weeks[2], None)]
        + [("C", weeks[0], None)],
        "region_id string, date date, temp double",
    )
    scored = anomalies.region_zscore(frame, ["temp"])
    got = {(r["region_id"], r["date"]): r["temp_anom"] for r in scored.collect()}
    assert [got["A", w] for w in weeks] == [0.0, 0.0, 0.0]
    assert [got["B", w] for w in weeks] == [-1.0, 1.0, None]
    assert got["C", weeks[0]] == 0.0


@pytest.mark.parametrize("group_by, ddof", [("weekofyear", 0), ("month", 1)])
def test_seasonal_zscore_matches_pandas(spark, group_by, ddof):
    weeks = fridays(160)
    values = [float((7 * i * i + 3 * i) % 31) for i in range(160)]
    frame = spark.createDataFrame([("A", w, v) for w, v in zip(weeks, values)], "k string, date date, v double")
    got = anomalies.seasonal_zscore(frame, "v", "k", group_by=group_by, ddof=ddof).orderBy("date").toPandas()["v_z"]
    index = pd.DatetimeIndex(weeks)
    season = index.isocalendar().week.to_numpy() if group_by == "weekofyear" else index.month
    series = pd.Series(values, index=index)
    grouped = series.groupby(season)
    expected = (series - grouped.transform("mean")) / grouped.transform("std", ddof=ddof)
    for a, b in zip(got, expected):
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-12)


def test_seasonal_zscore_without_spread_is_null_and_takes_a_season_column(spark):
    frame = spark.createDataFrame(
        [("A", fridays(3)[i], v, s) for i, (v, s) in enumerate([(1.0, "x"), (1.0, "x"), (4.0, "y")])],
        "k string, date date, v double, season string",
    )
    assert {r["v_z"] for r in anomalies.seasonal_zscore(frame, "v", "k", season_col="season").collect()} == {None}
    with pytest.raises(ValueError):
        anomalies.seasonal_zscore(frame, "v", "k", group_by="decade")


def test_returns_carry_the_last_close_over_a_null(spark):
    days = [d("2024-01-01"), d("2024-01-02"), d("2024-01-03")]
    frame = spark.createDataFrame(
        [("A", x, c) for x, c in zip(days, [1.0, None, 2.0])], "commodity string, date date, close double"
    )
    assert [r["returns"] for r in market.daily_returns(frame).orderBy("date").collect()] == [None, 0.0, 1.0]


def test_volatility_warms_up_and_matches_pandas(spark):
    closes = [100.0 + ((i * 37) % 17) for i in range(60)]
    days = pd.date_range("2024-01-01", periods=60)
    frame = spark.createDataFrame(
        [("A", x.date(), c) for x, c in zip(days, closes)], "commodity string, date date, close double"
    )
    got = market.realized_vol(market.daily_returns(frame)).orderBy("date").toPandas()["realized_vol_30d"]
    expected = pd.Series(closes).pct_change().rolling(30, min_periods=10).std() * math.sqrt(252)
    assert got[:10].isna().all() and not math.isnan(got[10])
    pd.testing.assert_series_equal(got, expected, check_names=False, rtol=1e-9)


def test_weekly_market_has_both_prices_and_all_weeks(spark):
    frame = spark.createDataFrame(
        [("corn", d("2024-01-03"), 5.0), ("corn", d("2024-01-18"), 7.0)], "commodity string, date date, close double"
    )
    assert rows(market.weekly_market(frame), "date") == [
        (d("2024-01-05"), "corn", 5.0, 5.0, None, "landed"),
        (d("2024-01-12"), "corn", None, None, None, "landed"),
        (d("2024-01-19"), "corn", 7.0, 7.0, None, "landed"),
    ]


def test_price_column_is_chosen_by_name():
    assert market.price_column(["date", "price_front_fut", "price_spot"]) == "price_spot"
    assert market.price_column(["date", "price_front_fut"]) == "price_front_fut"
    with pytest.raises(KeyError):
        market.price_column(["date"])


def test_zero_price_blanks_its_week_and_the_next(spark):
    frame = spark.createDataFrame(
        [("A", w, p) for w, p in zip(fridays(4), [1.0, 0.0, 2.0, 4.0])], "commodity string, date date, p double"
    )
    got = [r["y"] for r in market.log_returns(frame, "p").orderBy("date").collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(math.log(2))
