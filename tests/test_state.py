"""State tables against the same measures over the whole history."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cropwind.operators import anomalies, market, state

DAY = dt.date(2020, 1, 3)


@pytest.fixture(scope="module")
def weeks(spark):
    """Values near 1e8, a constant series, one without values, one that starts late, and a NULL key."""
    r = random.Random(2)
    rows = []
    for i in range(90):
        date = DAY + dt.timedelta(weeks=i)
        rows += [("far", date, 1e8 + r.random(), r.choice([None, 1.0, 2.5])), ("flat", date, 0.1, None), (None, date, r.gauss(0, 1), 3.0)]
        if i >= 70:
            rows.append(("late", date, r.random(), r.random()))
    return spark.createDataFrame(rows, "region_id string, date date, temp double, precip double")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_merged_moments_score_like_the_whole_history(weeks, order):
    cuts = [DAY - dt.timedelta(1), DAY + dt.timedelta(weeks=5), DAY + dt.timedelta(weeks=60), dt.date(2100, 1, 1)]
    parts = [weeks.where((F.col("date") > cuts[i]) & (F.col("date") <= cuts[i + 1])) for i in order]
    values = ["temp", "precip"]
    known = state.moments(parts[0], values, "region_id")
    for part in parts[1:]:
        known = state.merge_moments(known, state.moments(part, values, "region_id"), values, "region_id")
    assert known.count() == 4
    key = lambda r: (str(r.region_id), r.date)
    got = sorted(state.zscore_from_state(weeks, known, values, "region_id").collect(), key=key)
    want = sorted(anomalies.region_zscore(weeks, values).collect(), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for c in ("temp_anom", "precip_anom"):
            assert (g[c] is None) == (w[c] is None) and (g[c] is None or abs(g[c] - w[c]) < 1e-6)


def test_an_empty_increment_changes_nothing(weeks):
    known = state.moments(weeks, ["temp"], "region_id")
    none = state.moments(weeks.where("false"), ["temp"], "region_id")
    for a, b in ((known, none), (none, known)):
        assert sorted(map(str, state.merge_moments(a, b, ["temp"], "region_id").collect())) == sorted(map(str, known.collect()))


@pytest.mark.parametrize("cuts", [(0, 7, 45, 80), (0, 31, 32, 80)])
def test_returns_go_on_from_the_tail(spark, cuts):
    r = random.Random(5)
    closes = {"a": [r.choice([None, 1 + r.random()]) for _ in range(80)], "b": [None] * 10 + [5 + r.random() for _ in range(70)], "gone": [2 + r.random() for _ in range(20)], "new": [None] * 50 + [1 + r.random() for _ in range(30)]}
    rows = [(name, DAY + dt.timedelta(i), c) for name, cs in closes.items() for i, c in enumerate(cs) if not (name == "new" and i < 50)]
    schema = "commodity string, date date, close double"
    daily = spark.createDataFrame(rows, schema)
    want = {(x.commodity, x.date): (x.returns, x.realized_vol_30d) for x in market.realized_vol(market.daily_returns(daily)).collect()}
    got, tail = {}, spark.createDataFrame([], "commodity string, tail array<struct<date: date, close: double, returns: double>>")
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = [x for x in rows if low <= (x[1] - DAY).days < high]
        done, after = state.continued_returns(tail, spark.createDataFrame(part, schema))
        got |= {(x.commodity, x.date): (x.returns, x.realized_vol_30d) for x in done.collect()}
        tail = spark.createDataFrame(after.collect(), tail.schema)
    assert got.keys() == want.keys()
    for key, (returns, vol) in want.items():
        assert got[key][0] == returns
        assert (got[key][1] is None) == (vol is None) and (vol is None or abs(got[key][1] - vol) < 1e-9)
    # At most the rows that a frame looks at, and series without new days keep theirs.
    assert {x.commodity: len(x.tail) for x in tail.collect()} == {"a": 30, "b": 30, "gone": 20, "new": 30}


def test_late_days_are_told(spark):
    schema = "commodity string, tail array<struct<date: date, close: double, returns: double>>"
    tail = spark.createDataFrame([("a", [(DAY, 1.0, None)]), ("b", [(DAY, 1.0, None)])], schema)
    new = spark.createDataFrame([("a", DAY, 2.0), ("b", DAY + dt.timedelta(1), 2.0), ("c", DAY, 1.0)], "commodity string, date date, close double")
    assert [x.commodity for x in state.late_series(tail, new).collect()] == ["a"]
