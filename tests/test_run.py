"""A full run over landed files, through the command line."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest

from cropwind.__main__ import main
from cropwind.plans.runs import Run, unconfigured

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(900)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    for sub in ("weather", "quotes", "supply"):
        (folder / "landing" / sub).mkdir(parents=True)
    for k, region in enumerate(["FR", "US", "BR"]):
        daily = {
            "time": [str(x) for x in DAYS],
            "temperature_2m_mean": [15 + 10 * math.sin(i / 58 + k) + (i * 7 % 5) for i in range(len(DAYS))],
            "precipitation_sum": [(i * (k + 3)) % 11 / 2 for i in range(len(DAYS))],
        }
        (folder / "landing" / "weather" / f"{region}.json").write_text(json.dumps({"daily": daily}))
    for k, name in enumerate(["wheat", "corn", "cocoa"]):
        lines = ["Date,Adj Close,Close"] + [f"{x},{100 + k + 20 * math.sin(i / 31) + (i * 13 % 17) / 5},1" for i, x in enumerate(DAYS)]
        (folder / "landing" / "quotes" / f"{name}.csv").write_text("\n".join(lines))
    lines = ["region_id,date,prod_estimate,stocks"] + [f"{r},{x},{50 + i % 9},{200 - i % 7}" for r in ("FR", "US") for i, x in enumerate(DAYS)]
    (folder / "landing" / "supply" / "supply.csv").write_text("\n".join(lines))
    return str(folder)


def test_full_run(spark, root):
    main(["full-run", "--root", root, "--as-of", "2022-07-01T00:00:00", "--role", "importer", "--exposure", "500"], spark)
    run = Run(spark, root, dt.datetime(2022, 7, 1))
    assert run.store("weather").read().count() == 3 * 130
    assert {r["commodity"] for r in run.store("market").read().select("commodity").distinct().collect()} == {"wheat", "corn", "cocoa"}
    # Cocoa has quotes but no regions.
    assert [r["commodity"] for r in unconfigured(run).collect()] == ["cocoa"]
    assert {r["commodity"]: r["count"] for r in run.gold("forecast").groupBy("commodity").count().collect()} == {"wheat": 8, "corn": 8}
    hedges = run.gold("hedge_rec").collect()
    assert len(hedges) == 6 and all(0 <= r["hedge_ratio"] <= 1 and r["exposure"] == 500 for r in hedges)
    assert all(dt.date.fromisoformat(r["instrument_maturity"]).weekday() == 3 for r in hedges)
    kpis = {r["commodity"] for r in spark.read.option("header", True).csv(f"{root}/report/kpis.csv").collect()}
    assert {"wheat", "corn"} <= kpis
    run.merge_silver()
    assert spark.read.parquet(f"{root}/silver/silver_data.parquet").count() >= 3 * 3 * 130


def test_steps_can_be_repeated_for_one_commodity(spark, root):
    at = ["--root", root, "--as-of", "2022-07-02T00:00:00", "--commodity", "wheat"]
    run = Run(spark, root, dt.datetime(2022, 7, 2))
    before = sorted(tuple(r) for r in run.gold("forecast").collect())
    for step in ("ingest", "climate-index", "market-model", "hedge", "report"):
        main([step, *at], spark)
    assert sorted(tuple(r) for r in run.gold("forecast").collect()) == before
    assert run.store("weather").read().count() == 3 * 130
    with pytest.raises(KeyError):
        main(["climate-index", "--root", root, "--commodity", "cocoa"], spark)


def weekly_rows(run):
    return sorted(map(repr, run.store("weather").read().collect()))


def test_an_ingest_derives_the_series_it_touches_only(spark, tmp_path):
    schema = "region_id string, date date, temp double, precip double"
    days = lambda regions, first, n, shift=0: [(r, dt.date(2020, 1, 1) + dt.timedelta(days=first + i), float((i * (k + 3) + shift) % 17), float(i % 5)) for k, r in enumerate(regions) for i in range(n)]
    regions = [f"r{i}" for i in range(12)]
    first, second = days(regions, 0, 300), days(["r5"], 300, 20) + days(["r5"], 40, 3, 9) + days(["new"], 0, 30)
    run = Run(spark, str(tmp_path / "steps"), dt.datetime(2021, 3, 1))
    run.landed("weather", spark.createDataFrame(first, schema), "1")
    files = lambda: {f"{p.parent}/{p.name}": p for p in (tmp_path / "steps/silver/weather").glob("*/*/*.parquet")}
    before = files()
    run.landed("weather", spark.createDataFrame(second, schema), "2")
    written = spark.read.parquet(*[str(p) for name, p in files().items() if name not in before])
    touched = run.store("weather").buckets
    assert {"r5", "new"} <= {r[0] for r in written.select("region_id").distinct().collect()}
    # Series that share a bucket with the two are copied; the others' files stay.
    assert 0 < written.count() < run.store("weather").read().count() * 4 / touched and len(before.keys() & files().keys()) > 0
    latest = {(r, day): (r, day, t, p) for r, day, t, p in first + second}
    once = Run(spark, str(tmp_path / "once"), dt.datetime(2021, 3, 1))
    once.landed("weather", spark.createDataFrame(list(latest.values()), schema), "1", force=True)
    assert weekly_rows(run) == weekly_rows(once)
    # Time passes: days that leave the scope touch their series although nothing lands.
    later = Run(spark, str(tmp_path / "steps"), dt.datetime(2035, 2, 1))
    later.landed("weather", spark.createDataFrame([], schema), "3")
    again = Run(spark, str(tmp_path / "once"), dt.datetime(2035, 2, 1))
    again.landed("weather", spark.createDataFrame([], schema), "2", force=False)
    again.store("weather").overwrite(again.weekly("weather"))
    assert weekly_rows(later) == weekly_rows(again) and 0 < len(weekly_rows(later)) < len(weekly_rows(run)) + 1
    assert min(r["date"] for r in later.store("weather").read().collect()) >= dt.date(2020, 2, 1)
