from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from conftest import fridays
from pyspark.sql import functions as F

from cropwind.functions.linalg import solve_centred
from cropwind.operators import design as D
from cropwind.operators import forecast as M
from cropwind.operators.regression import fit_ols

N = 130


def wave(i, a, b):
    return ((a * i * i + b * i) % 97) / 97.0


def series(name, shift):
    """Prices, a 0-100 risk and an extra regressor, without randomness."""
    prices = [100.0 + shift + 30.0 * wave(i, 13, 7 + shift) + 5 * math.sin(i / 4) for i in range(N)]
    risk = [40.0 + 25.0 * wave(i, 29, 11) + shift for i in range(N)]
    extra = [1e5 * wave(i, 5, 31) for i in range(N)]
    return [(name, w, p, r, e) for w, p, r, e in zip(fridays(N), prices, risk, extra)]


@pytest.fixture(scope="module")
def panel(spark):
    rows = series("corn", 0) + series("wheat", 3)
    return spark.createDataFrame(rows, "commodity string, date date, price double, global_risk_0_100 double, exog_rain double").cache()


@pytest.fixture(scope="module")
def price(panel):
    return panel.select("commodity", "date", F.col("price").alias("price_front_fut"))


@pytest.fixture(scope="module")
def risk(panel):
    return panel.select("commodity", "date", "global_risk_0_100", "exog_rain")


def pandas_base(name, shift):
    frame = pd.DataFrame(series(name, shift), columns=["c", "date", "price", "risk", "exog_rain"])
    frame["y"] = np.log(frame["price"] / frame["price"].shift(1))
    return frame


def lstsq(frame, columns):
    x = np.column_stack([np.ones(len(frame)), frame[columns].to_numpy()])
    beta = np.linalg.lstsq(x, frame["y"].to_numpy(), rcond=None)[0]
    residual = frame["y"].to_numpy() - x @ beta
    return beta, float(residual @ residual) / max(1, len(frame) - x.shape[1])


def fitted(model, name="corn"):
    return fit_ols(model).where(F.col("commodity") == name).first()


def test_legacy_design_interleaves_lags_after_dropping(panel, price, risk):
    model = D.merge_price_and_risk(price, risk.drop("exog_rain"), lags=2)
    assert model.features == ("y_lag1", "risk_lag1", "y_lag2", "risk_lag2")
    got = model.frame.where("commodity = 'corn'").orderBy("date").toPandas()
    base = pandas_base("corn", 0).dropna()
    for k in (1, 2):
        base[f"y_lag{k}"], base[f"risk_lag{k}"] = base["y"].shift(k), (base["risk"] / 100).shift(k)
    expected = base.dropna()
    assert len(got) == len(expected) == N - 3
    for c in ("y", *model.features):
        np.testing.assert_allclose(got[c], expected[c], rtol=1e-12)


def test_legacy_design_drops_rows_with_a_null_in_any_extra_column(spark, price, risk):
    hole = risk.withColumn("exog_rain", F.when(F.col("date") != fridays(N)[50], F.col("exog_rain")))
    whole = D.merge_price_and_risk(price, risk).frame.count()
    assert D.merge_price_and_risk(price, hole).frame.count() == whole - 2
    assert D.merge_price_and_risk(price, hole.drop("exog_rain")).frame.count() == whole


def test_auto_design_counts_rows_as_given(panel, price, risk):
    base = D.merge_price_and_risk(price, risk, mode="auto", exog_cols=["exog_rain"])
    assert base.frame.columns == ["commodity", "date", "y", "risk", "exog_rain"] and base.features == ()
    model = D.auto_features(base.frame, extra_exog=["exog_rain"])
    assert model.features == ("y_lag1", "y_lag2", "risk_lag1", "risk_lag2", "season_sin", "season_cos", "exog_rain")
    got = model.frame.where("commodity = 'corn'").orderBy("date").toPandas()
    assert len(got) == N - 3
    # Two rows were lost to the lags, so the first one left is position 2.
    assert got["season_sin"][0] == pytest.approx(math.sin(2 * math.pi * 2 / 52))
    assert D.auto_features(base.frame, p=0, q=0, include_seasonal=False).features == ("y_lag1", "risk_lag1")


def test_risk_scale_is_decided_per_series(spark):
    rows = [(n, w, 0.1, v) for n, v in (("big", 50.0), ("small", 0.5)) for w in fridays(4)]
    frame = spark.createDataFrame(rows, "commodity string, date date, y double, global_risk_0_100 double")
    got = D.auto_features(frame, p=1, q=1).frame.groupBy("commodity").agg(F.max("risk_lag1")).collect()
    assert {tuple(r) for r in got} == {("big", 0.5), ("small", 0.5)}


def test_given_risk_lags_are_used(spark):
    rows = [("a", w, 0.1 * i, float(i), float(i)) for i, w in enumerate(fridays(6))]
    frame = spark.createDataFrame(rows, "commodity string, date date, y double, risk_lag1 double, risk_lag2 double")
    assert D.auto_features(frame).frame.agg(F.max("risk_lag1")).first()[0] == 5.0
    with pytest.raises(ValueError):
        D.auto_features(frame, q=3)


def test_design_errors(price, risk):
    with pytest.raises(ValueError):
        M.train_and_forecast(price, risk, lags=0)
    bare = fitted(D.merge_price_and_risk(price, risk, lags=0))
    assert bare["coeffs"] == {} and bare["intercept"] == pytest.approx(pandas_base("corn", 0)["y"].mean())
    with pytest.raises(ValueError):
        D.merge_price_and_risk(price, risk, mode="other")
    with pytest.raises(ValueError):
        D.merge_price_and_risk(price, risk, price_col="nope")
    with pytest.raises(ValueError):
        D.merge_price_and_risk(price, risk, mode="auto", exog_cols=["exog_none"])
    base = D.merge_price_and_risk(price, risk, mode="auto").frame
    with pytest.raises(ValueError):
        D.auto_features(base, extra_exog=["rain"])
    with pytest.raises(ValueError):
        D.auto_features(base, extra_exog=["exog_rain"])
    with pytest.raises(ValueError):
        D.auto_features(base.drop("y"))


@pytest.mark.parametrize("name, shift", [("corn", 0), ("wheat", 3)])
def test_fit_equals_lstsq(price, risk, name, shift):
    base = D.merge_price_and_risk(price, risk, mode="auto", exog_cols=["exog_rain"])
    model = D.auto_features(base.frame, extra_exog=["exog_rain"])
    got = fitted(model, name)
    rows = model.frame.where(F.col("commodity") == name).orderBy("date").toPandas()
    beta, variance = lstsq(rows, list(model.features))
    assert got["intercept"] == pytest.approx(beta[0], rel=1e-8)
    np.testing.assert_allclose([got["coeffs"][f] for f in model.features], beta[1:], rtol=1e-7, atol=1e-14)
    assert got["resid_var"] == pytest.approx(variance, rel=1e-10)
    assert got["n_obs"] == len(rows) and got["n_coef"] == 8
    assert got["exog_last"] == {"exog_rain": rows["exog_rain"].iloc[-1]}


def test_constant_risk_gives_the_minimum_norm_fit(price, risk):
    flat = risk.drop("exog_rain").withColumn("global_risk_0_100", F.lit(60.0))
    model = D.auto_features(D.merge_price_and_risk(price, flat, mode="auto").frame)
    got = fitted(model)
    rows = model.frame.where("commodity = 'corn'").orderBy("date").toPandas()
    beta, variance = lstsq(rows, list(model.features))
    np.testing.assert_allclose([got["intercept"], *[got["coeffs"][f] for f in model.features]], beta, atol=1e-10)
    assert got["resid_var"] == pytest.approx(variance, rel=1e-9)


@pytest.mark.parametrize("n", [2, 3, 5, 9])
def test_short_series_match_lstsq(spark, n):
    rows = [("a", w, wave(i, 13, 7), wave(i, 5, 3), wave(i, 11, 2), 0.0) for i, w in enumerate(fridays(n))]
    frame = spark.createDataFrame(rows, "commodity string, date date, y double, x1 double, x2 double, x3 double")
    got = fit_ols(D.Design(frame, ("x1", "x2", "x3"), ("commodity",))).first()
    beta, variance = lstsq(frame.orderBy("date").toPandas(), ["x1", "x2", "x3"])
    np.testing.assert_allclose([got["intercept"], *[got["coeffs"][f] for f in ("x1", "x2", "x3")]], beta, atol=1e-7)
    assert got["resid_var"] == pytest.approx(variance, abs=1e-12)


def centred(x, y):
    """The solver's result for regressors without the intercept's column."""
    d = x - x.mean(axis=0)
    return solve_centred((d.T @ d / len(x))[None], (d.T @ (y - y.mean()) / len(x))[None], x.mean(axis=0)[None], np.array([y.mean()]))[0]


@pytest.mark.parametrize("size", [1e-4, 1e-5, 1e-6, 1e-7, 0.0])
def test_nearly_constant_regressors_keep_their_digits(spark, size):
    n = 780
    noise = [wave(i, 37, 5) + wave(i, 11, 2) / 3 for i in range(n)]
    rows = [("a", w, wave(i, 13, 7) + noise[i] / 2, 0.5 + size * noise[i], wave(i, 5, 3)) for i, w in enumerate(fridays(n))]
    frame = spark.createDataFrame(rows, "commodity string, date date, y double, x1 double, x2 double").repartition(3)
    got = fit_ols(D.Design(frame, ("x1", "x2"), ("commodity",))).first()
    beta, variance = lstsq(frame.orderBy("date").toPandas(), ["x1", "x2"])
    np.testing.assert_allclose([got["intercept"], got["coeffs"]["x1"], got["coeffs"]["x2"]], beta, rtol=1e-6, atol=1e-9)
    assert got["resid_var"] == pytest.approx(variance, rel=1e-8)


def test_solver_handles_badly_scaled_and_singular_systems():
    x = np.array([[1.0, 1e6 * wave(i, 3, 5), 1e-6 * wave(i, 7, 2), 2e6 * wave(i, 3, 5)] for i in range(40)])
    y = np.array([wave(i, 19, 1) for i in range(40)])
    expected = np.linalg.lstsq(x[:, :3], y, rcond=None)[0]
    np.testing.assert_allclose(centred(x[:, 1:3], y), expected, rtol=1e-6)
    # The last column doubles the second one; among all solutions the shortest is wanted.
    z = x[:, [0, 1, 3]] / [1.0, 1e6, 1e6]
    expected = np.linalg.lstsq(z, y, rcond=None)[0]
    np.testing.assert_allclose(centred(z[:, 1:], y), expected, rtol=1e-8)


def walk(fit, start_price, lags, path, phase, steps, period=52, proper=False, extra=None):
    """The recursion in plain Python."""
    price, out = start_price, []
    order = sum(name.startswith("y_lag") for name in fit["coeffs"])
    lags = (list(lags) + [0.0] * order)[:order]
    for s in range(1, steps + 1):
        y = fit["intercept"]
        for name, weight in fit["coeffs"].items():
            if name.startswith("y_lag"):
                y += weight * lags[int(name[5:]) - 1]
            elif name.startswith("risk_lag"):
                y += weight * path[min(s - 1 + int(name[8:]) - 1, len(path) - 1)]
            elif name == "season_sin":
                y += weight * math.sin(2 * math.pi / period * (phase + s))
            elif name == "season_cos":
                y += weight * math.cos(2 * math.pi / period * (phase + s))
            else:
                y += weight * extra
        lags = [y, *lags[:-1]] if proper else [y] * order
        price *= math.exp(y)
        out.append((y, price))
    return out


@pytest.mark.parametrize("seed_lags, proper", [(False, False), (True, True), (True, False), (False, True)])
def test_weekly_model_follows_the_recursion(price, risk, seed_lags, proper):
    index = risk.select("commodity", "date", "global_risk_0_100")
    model, _ = M.market_model_parts(price, index)
    fit = fitted(model, "wheat").asDict()
    base = pandas_base("wheat", 3)
    seeds = [base["y"].iloc[-1], base["y"].iloc[-2]] if seed_lags else []
    path = (base["risk"].tail(10) / 100).tolist()
    expected = walk(fit, base["price"].iloc[-1], seeds, path, (N - 1) % 52, 8, proper=proper)
    got = M.market_model(price, index, seed_lags=seed_lags, proper_shift=proper).where("commodity = 'wheat'").orderBy("date").collect()
    np.testing.assert_allclose([(r["y_forecast"], r["price_forecast"]) for r in got], expected, rtol=1e-9)
    for step, row in enumerate(got, 1):
        cum = sum(y for y, _ in expected[:step])
        width = 1.96 * math.sqrt(fit["resid_var"] * step)
        assert row["price_lo95"] == pytest.approx(base["price"].iloc[-1] * math.exp(cum - width), rel=1e-9)
        assert row["price_lo95"] <= row["price_forecast"] <= row["price_hi95"]
        assert row["date"].weekday() == 6


def test_short_risk_history_repeats_its_last_value(spark, price, risk):
    late = risk.select("commodity", "date", "global_risk_0_100").where(F.col("date") >= fridays(N)[-7])
    got = M.market_model(price, late).where("commodity = 'corn'").orderBy("date").collect()
    assert len(got) == 8 and all(math.isfinite(r["price_forecast"]) for r in got)


@pytest.mark.parametrize("lags", [1, 2])
def test_horizons_in_legacy_mode(price, risk, lags):
    index = risk.drop("exog_rain")
    model = D.merge_price_and_risk(price, index, lags=lags)
    fit = fitted(model).asDict()
    last = model.frame.where("commodity = 'corn'").orderBy(F.desc("date")).first()
    expected = walk(fit, pandas_base("corn", 0)["price"].iloc[-1], [last[f"y_lag{k}"] for k in range(1, lags + 1)], [last["risk_lag1"]], 0, 12)
    got = M.train_and_forecast(price, index, lags=lags).where("commodity = 'corn'").orderBy("horizon_days").collect()
    assert [(r["horizon_days"], r["steps"]) for r in got] == [(30, 4), (60, 8), (90, 12)]
    for row in got:
        cum = sum(y for y, _ in expected[: row["steps"]])
        width = 1.96 * math.sqrt(fit["resid_var"] * row["steps"])
        assert row["cum_return"] == pytest.approx(cum, abs=1e-12)
        assert row["price_forecast"] == pytest.approx(expected[row["steps"] - 1][1], rel=1e-10)
        assert (row["lo95"], row["hi95"]) == (pytest.approx(cum - width), pytest.approx(cum + width))


def test_horizons_in_auto_mode_hold_extra_regressors(price, risk):
    model = D.auto_features(D.merge_price_and_risk(price, risk, mode="auto", exog_cols=["exog_rain"]).frame, extra_exog=["exog_rain"])
    fit = fitted(model).asDict()
    base = pandas_base("corn", 0)
    phase = fridays(N)[-1].isocalendar().week % 52
    expected = walk(fit, base["price"].iloc[-1], [], [base["risk"].iloc[-1] / 100], phase, 4, extra=base["exog_rain"].iloc[-1])
    got = M.train_and_forecast(price, risk, horizons=[30], mode="auto", exog_cols=["exog_rain"]).where("commodity = 'corn'").first()
    assert got["price_forecast"] == pytest.approx(expected[-1][1], rel=1e-8)


def test_last_price_falls_back_to_the_newest(price, risk):
    later = price.withColumn("date", F.col("date"))
    cut = risk.drop("exog_rain").where(F.col("date") <= fridays(N)[-5])
    got = M.train_and_forecast(later, cut, horizons=[7]).where("commodity = 'corn'").first()
    base = pandas_base("corn", 0)
    assert got["price_forecast"] / math.exp(got["cum_return"]) == pytest.approx(base["price"].iloc[-5])


def test_perfect_fit_has_no_band(spark):
    frame = spark.createDataFrame([("a", 100.0, 0.0, 1, 0.0, 100.0)], "commodity string, last_price double, resid_var double, step int, cum_return double, price_forecast double")
    row = M.with_price_band(frame).first()
    assert row["price_lo95"] == row["price_hi95"] == 100.0


def test_latest_last_two_and_tail(spark):
    w = fridays(3)
    frame = spark.createDataFrame([("a", w[0], 1.0), ("a", w[1], 2.0), ("a", w[2], None), ("b", w[0], 5.0)], "commodity string, date date, v double")
    assert {tuple(r) for r in D.latest_row(frame).collect()} == {("a", w[2], None), ("b", w[0], 5.0)}
    assert {tuple(r) for r in D.last_two(frame, "v").collect()} == {("a", None, 2.0), ("b", 5.0, 5.0)}
    tails = {r["commodity"]: r["tail"] for r in D.tail_in_order(frame, "v", 2).collect()}
    assert tails == {"a": [2.0, None], "b": [5.0]}
