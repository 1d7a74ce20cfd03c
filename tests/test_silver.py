from __future__ import annotations

import pytest
from conftest import d, fridays
from pyspark.sql import functions as F

from cropwind.operators import quality, silver
from cropwind.sources.config import Region, RegionConfig

PRICES = "date date, commodity string, price_spot double, seq long"


def test_new_batch_wins_and_its_last_row_counts(spark):
    day = d("2024-01-05")
    old = spark.createDataFrame([(day, "corn", 1.0, 9), (day, "soy", 4.0, 1)], PRICES)
    new = spark.createDataFrame([(day, "corn", 2.0, 1), (day, "corn", 3.0, 2), (None, "corn", 8.0, 3)], PRICES)
    merged = silver.incremental_update(old, new, ["date", "commodity"], order="seq")
    assert sorted(tuple(r) for r in merged.collect()) == [(day, "corn", 3.0, 2), (day, "soy", 4.0, 1)]


def test_upsert_is_idempotent_and_dedupes_a_first_load(spark):
    day = d("2024-01-05")
    new = spark.createDataFrame([(day, "corn", 2.0, 1), (day, "corn", 3.0, 2)], PRICES)
    first = silver.incremental_update(None, new, ["date", "commodity"], order="seq")
    again = silver.incremental_update(first, new, ["date", "commodity"], order="seq")
    assert [tuple(r) for r in first.collect()] == [tuple(r) for r in again.collect()] == [(day, "corn", 3.0, 2)]
    assert silver.incremental_update(first, None, ["date", "commodity"], order="seq").count() == 1
    with pytest.raises(ValueError):
        silver.incremental_update(None, None, ["date"])


def test_position_decides_without_an_order_column_and_text_dates_are_parsed(spark):
    new = spark.createDataFrame([("2024-01-05", "a", 1.0), ("2024-01-05", "a", 2.0), ("junk", "a", 3.0)], "date string, k string, v double").coalesce(1)
    got = silver.incremental_update(None, new, ["date", "k"]).collect()
    assert [tuple(r) for r in got] == [(d("2024-01-05"), "a", 2.0)]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    day = F.lit(d("2024-01-05"))
    copies = spark.range(0, 60_000, 1, 6).select(
        day.alias("date"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("commodity"),
        F.col("id").cast("double").alias("price_spot"),
        F.col("id").alias("seq"),
    )
    merged = silver.incremental_update(None, copies, ["date", "commodity"], order="seq")
    got = {r["commodity"]: r["seq"] for r in merged.collect()}
    assert got["hot"] == 59_997 and len(got) == 501
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_natural_keys_include_the_commodity_of_supply():
    assert silver.natural_keys("supply", ["date", "region_id", "commodity"]) == ["date", "region_id", "commodity"]
    assert silver.natural_keys("supply", ["date", "region_id"]) == ["date", "region_id"]
    assert silver.natural_keys("market", []) == ["date", "commodity"]


@pytest.fixture()
def three_tables(spark):
    w1, w2 = fridays(2)
    weather = spark.createDataFrame(
        [(w1, "FR", 1.0, 2.0, 0.0, 0.0), (w2, "FR", 3.0, 4.0, 0.0, 0.0), (w1, "US", 5.0, 6.0, 0.0, 0.0)],
        "date date, region_id string, temp_anom double, precip_anom double, ndvi double, enso double",
    )
    market = spark.createDataFrame(
        [(w1, "wheat", 10.0, 10.0, 0.2, "x"), (None, "wheat", 1.0, 1.0, 0.1, "x"), (d("2030-01-04"), "wheat", 11.0, 11.0, 0.3, "x")],
        "date date, commodity string, price_spot double, price_front_fut double, realized_vol_30d double, data_source string",
    )
    supply = spark.createDataFrame(
        [(w1, "FR", 7.0, 8.0, "y"), (d("2030-01-04"), None, 1.0, 1.0, "y")],
        "date date, region_id string, prod_estimate double, stocks double, data_source string",
    )
    return weather, market, supply


def test_align_keeps_regions_with_weather_and_supply(three_tables):
    aligned = silver.align_regions(*three_tables)
    assert aligned.columns == silver.ALIGNED_COLUMNS
    got = sorted((r["date"], r["region_id"], r["prod_estimate"], r["price_spot"]) for r in aligned.collect())
    w1, w2 = fridays(2)
    assert got[0] == (w1, "FR", 7.0, 10.0)
    assert [g[:2] for g in got] == [(w1, "FR"), (w2, "FR")] and got[1][2:] == (None, None)
    assert silver.align_regions(*three_tables, regions=["US"]).count() == 0


def test_align_with_config_meets_only_its_own_regions(three_tables):
    config = RegionConfig({"wheat": (Region("FR", 1.0, {"temp_anom": 1.0}),), "corn": (Region("US", 1.0, {"temp_anom": 1.0}),)})
    aligned = silver.align_regions(*three_tables, config=config)
    assert {(r["commodity"], r["region_id"]) for r in aligned.collect()} == {("wheat", "FR")}


def test_merge_loses_nothing_and_matches_null_regions(three_tables):
    merged = silver.silver_merge(*three_tables)
    assert merged.columns[-3:] == ["prod_estimate", "stocks", "data_source_agri"]
    rows = {(str(r["date"]), r["region_id"]): r for r in merged.collect()}
    assert set(rows) == {("2020-01-03", "FR"), ("2020-01-03", "US"), ("2020-01-10", "FR"), ("2030-01-04", None)}
    # The price week without weather has no region; the supply row without one matches it.
    assert rows["2030-01-04", None]["price_spot"] == 11.0 and rows["2030-01-04", None]["prod_estimate"] == 1.0


def test_the_nested_merge_holds_each_row_once_and_gives_the_wide_one_back(spark, three_tables):
    nested = silver.silver_nested(*three_tables)
    rows = {str(r["date"]): r for r in nested.collect()}
    assert {k: (len(r["weather"]), len(r["market"]), len(r["supply"])) for k, r in rows.items()} == {
        "2020-01-03": (2, 1, 1), "2020-01-10": (1, 0, 0), "2030-01-04": (0, 1, 1)
    }
    assert [w["region_id"] for w in rows["2020-01-03"]["weather"]] == ["FR", "US"]
    parts = [silver.nested_rows(nested, name) for name in ("weather", "market", "supply")]
    wide, again = silver.silver_merge(*three_tables), silver.silver_merge(*parts)
    assert again.columns == wide.columns and sorted(map(str, again.collect())) == sorted(map(str, wide.collect()))
    assert silver.silver_nested(*[t.where("false") for t in three_tables]).count() == 0


def test_the_index_from_the_nested_merge_reads_no_prices(spark, three_tables, tmp_path):
    path = str(tmp_path / "nested")
    silver.silver_nested(*three_tables).write.parquet(path)
    plan = silver.nested_rows(spark.read.parquet(path), "weather")._jdf.queryExecution().executedPlan().toString()
    assert "price_spot" not in plan and "prod_estimate" not in plan and "Join" not in plan
    plan = silver.silver_nested(*three_tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_contract_counts_each_broken_rule(spark):
    good = dict(date=d("2024-01-05"), region_id="FR", region_weight=None, temp_anom="1", precip_anom=0.0, ndvi=0.0, enso=0.0,
                prod_estimate=None, stocks=None, price_spot=1.0, price_front_fut=1.0, realized_vol_30d=0.1)
    bad = good | dict(date=None, temp_anom="warm", precip_anom=float("inf"), price_spot=float("nan"), realized_vol_30d=-0.1)
    schema = ("date date, region_id string, region_weight string, temp_anom string, precip_anom double, ndvi double, enso double, "
              "prod_estimate double, stocks double, price_spot double, price_front_fut double, realized_vol_30d double, extra int")
    frame = spark.createDataFrame([tuple(good.values()) + (1,), tuple(bad.values()) + (2,)], schema)
    failed = {(r["column"], r["rule"]) for r in quality.contract_report(frame).collect() if r["failures"]}
    assert failed == {("date", "not_null"), ("temp_anom", "type"), ("precip_anom", "finite"), ("price_spot", "not_null"), ("realized_vol_30d", "non_negative")}
    assert [r["extra"] for r in quality.conforming(frame).collect()] == [1]
    with pytest.raises(quality.ContractError, match="temp_anom.type: 1"):
        quality.validate(frame)
    assert quality.validate(frame.where("extra = 1")).schema["temp_anom"].dataType.typeName() == "double"
    with pytest.raises(ValueError):
        quality.contract_report(frame.drop("stocks"))
