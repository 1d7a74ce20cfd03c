from __future__ import annotations

import math

import pytest
from conftest import d, fridays
from pyspark.sql import functions as F

from cropwind.operators import climate
from cropwind.sources import config as C

SILVER = "date date, region_id string, temp_anom double, precip_anom double, ndvi double, enso double"
EVEN = {"temp_anom": 0.4, "precip_anom": 0.4, "ndvi": 0.1, "enso": 0.1}


def logistic(x):
    return 100.0 / (1.0 + math.exp(-x))


def config(*regions, commodity="wheat"):
    return C.RegionConfig({commodity: tuple(C.Region(*r) for r in regions)})


def test_weights_of_missing_factors_are_spread_and_null_spoils_the_score(spark):
    w = fridays(2)
    silver = spark.createDataFrame([(w[0], "FR", 1.0, 2.0, 0.0, 0.0), (w[1], "FR", 1.0, None, 0.0, 0.0)], SILVER)
    without = silver.drop("ndvi", "enso")
    direct = without.select("date", climate.regional_score(without.columns, EVEN).alias("s")).orderBy("date").collect()
    assert direct[0]["s"] == pytest.approx(logistic(1.5)) and direct[1]["s"] is None
    scores = climate.regional_scores(without, config(("FR", 0.5, EVEN))).orderBy("date").collect()
    assert scores[0]["regional_score"] == pytest.approx(logistic(1.5)) and scores[1]["regional_score"] is None
    index = climate.global_index(without, config(("FR", 0.5, EVEN))).orderBy("date").collect()
    assert index[0]["global_risk_0_100"] == pytest.approx(0.5 * logistic(1.5))
    assert index[1]["global_risk_0_100"] == 0.0


def test_missing_regions_count_as_zero_and_rows_of_a_date_are_averaged(spark):
    w = fridays(2)
    silver = spark.createDataFrame(
        [(w[0], "FR", 1.0, 1.0, 1.0, 1.0), (w[0], "FR", 3.0, 3.0, 3.0, 3.0), (w[0], "US", 0.0, 0.0, 0.0, 0.0), (w[1], "US", 0.0, 0.0, 0.0, 0.0),
         (w[1], "XX", 9.0, 9.0, 9.0, 9.0)],
        SILVER,
    )
    both = config(("FR", 0.25, EVEN), ("US", 0.5, EVEN))
    rows = climate.global_index_wide(silver, both).orderBy("date").collect()
    fr = 0.25 * (logistic(1.0) + logistic(3.0)) / 2
    assert rows[0]["contrib_FR"] == pytest.approx(fr) and rows[0]["contrib_US"] == pytest.approx(25.0)
    assert rows[1]["contrib_FR"] == 0.0 and rows[1]["global_risk_0_100"] == pytest.approx(25.0)
    for row in rows:
        assert row["global_risk_0_100"] == pytest.approx(row["contrib_FR"] + row["contrib_US"])
    long = {r["date"]: r["global_risk_0_100"] for r in climate.global_index(silver, both).collect()}
    assert long == {r["date"]: pytest.approx(r["global_risk_0_100"]) for r in rows}


def test_a_silver_table_with_commodities_serves_each_its_own_rows(spark):
    day = fridays(1)[0]
    silver = spark.createDataFrame([(day, "FR", 1.0, 1.0, 1.0, 1.0), (day, "FR", -1.0, -1.0, -1.0, -1.0)], SILVER)
    silver = silver.withColumn("commodity", F.when(F.col("temp_anom") > 0, "wheat").otherwise("corn"))
    got = climate.global_index(silver, config(("FR", 1.0, EVEN)), per_commodity=True).collect()
    mixed = climate.global_index(silver, config(("FR", 1.0, EVEN))).first()["global_risk_0_100"]
    assert mixed == pytest.approx((logistic(1.0) + logistic(-1.0)) / 2)
    assert [(r["commodity"], round(r["global_risk_0_100"], 6)) for r in got] == [("wheat", round(logistic(1.0), 6))]


def test_scores_stay_between_0_and_100(spark):
    day = d("2024-01-05")
    silver = spark.createDataFrame([(day, "FR", x, x, x, x) for x in (-1e6, -3.0, 0.0, 3.0, 1e6)], SILVER)
    bounds = silver.select(climate.regional_score(silver.columns, EVEN).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert bounds[0] == 0.0 and bounds[1] == 100.0


def test_bad_configs_are_refused(spark):
    silver = spark.createDataFrame([], SILVER)
    with pytest.raises(ValueError):
        climate.regional_score(silver.columns, {"soil": 1.0})
    with pytest.raises(ValueError):
        climate.regional_score(silver.columns, {"ndvi": 1.0, "enso": -1.0})
    with pytest.raises(ValueError):
        climate.global_index(silver, config(("FR", 1.0, {"soil": 1.0})))
    with pytest.raises(KeyError):
        C.DEFAULT_CONFIG.only("coffee")
    with pytest.raises(ValueError):
        C.RegionConfig({"tea": ()}).only("tea")


def test_simple_index_is_the_plain_mean(spark):
    day = d("2024-01-05")
    silver = spark.createDataFrame([(day, "FR", 2.0, 1.0, 0.0, 0.0), (day, "US", 0.0, 3.0, 0.0, 0.0)], SILVER)
    assert climate.simple_index(silver).first()["global_climate_index"] == -1.0


def test_default_config_weights_add_up():
    for regions in C.DEFAULT_CONFIG.commodities.values():
        assert sum(r.weight for r in regions) == pytest.approx(1.0)
        assert all(sum(r.factors.values()) == pytest.approx(1.0) for r in regions)


def test_config_files_and_dimensions(spark, tmp_path):
    raw = '{"wheat": {"regions": [{"id": "FR", "weight": 0.2, "factors": {"temp_anom": 1}}]}}'
    (tmp_path / "c.json").write_text(raw)
    read = C.RegionConfig.from_file(str(tmp_path / "c.json"))
    assert read.rows() == [("wheat", "FR", 0.2, {"temp_anom": 1.0})]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("wheat:\n  regions:\n    - {id: FR, weight: 0.2, factors: {temp_anom: 1}}\n")
    assert C.RegionConfig.from_file(str(tmp_path / "c.yaml")).rows() == read.rows()
    assert C.DEFAULT_CONFIG.factor_frame(spark).count() == 48
    places = spark.createDataFrame([("FR",), ("ZZ",)], "region_id string")
    assert [r["latitude"] for r in C.with_region_centre(places).collect()] == [46.2276]
    assert [r["region_id"] for r in C.unknown_keys(places, C.region_centres(spark), "region_id").collect()] == ["ZZ"]
    goods = spark.createDataFrame([("Wheat",), ("tea",)], "commodity string")
    assert [tuple(r) for r in C.with_ticker(goods).collect()] == [("Wheat", "ZW=F")]
    assert C.ticker("Corn") == "ZC=F"
    with pytest.raises(ValueError):
        C.ticker("tea")
