"""Every registered query against its SQL twin, and the shape of the plans."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from cropwind.operators import forecast, regression
from cropwind.operators.design import merge_price_and_risk
from cropwind.plans import catalog, panels, pipeline

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(got.columns) == sorted(names)
    rows = comparable(cursor.fetchall(), names)
    assert comparable([tuple(r) for r in got.collect()], got.columns) == rows
    assert rows


def test_every_query_has_a_twin():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert catalog.QUERIES.items() <= driver.queries().items() and catalog.ORACLES.items() <= driver.oracle_sql().items()


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["date", "commodity", "global_risk_0_100"] and result.count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


STORED = ("stream", "silver_store", "audit", "load_in", "any_format", "quotes_mixed", "landed_twice", "second_load", "commodity_from")
BATCH = sorted(n for n in catalog.QUERIES if "roundtrip" not in n and not n.startswith(STORED))


@pytest.mark.parametrize("name", BATCH)
def test_plans_have_no_pair_join_and_no_single_task_window(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan or name == "contract_report"
    for window in re.findall(r"Window \[.*", plan):
        assert "], [" in window, "a window without keys would run in one task"


def test_landings_are_written_as_several_files(spark, monkeypatch, tmp_path):
    folders = []

    def folder(_, name):
        folders.append(tmp_path / f"{name}-{len(folders)}")
        return str(folders[-1])

    monkeypatch.setattr(catalog, "scratch_path", folder)
    catalog.landed_twice(spark, SF)
    # Two landings of several files each; the name of a landing's files ends alike.
    counts = [sorted(Counter(re.sub(r"part-\d+-", "", f.name) for f in path.glob("*.csv")).values()) for path in folders]
    assert len(counts) == 2 and all(len(c) == 2 and c[0] > 1 for c in counts)


def test_scans_read_only_what_the_query_needs(spark):
    plan = plan_of(pipeline.index_table(spark, SF))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz" in read
    assert len(read) == 4, "each table is scanned once"


def test_commodity_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "market.parquet")
    pipeline.market_table(spark, SF).write.parquet(path)
    plan = plan_of(spark.read.parquet(path).where("commodity = 'building'").select("price_spot"))
    assert "EqualTo(commodity,building)" in plan and "ReadSchema: struct<commodity:string,price_spot:double>" in plan


def test_rows_are_combined_before_they_are_shuffled(spark):
    for panel in (panels.daily_weather, panels.daily_market, panels.daily_supply, panels.daily_vendor_market):
        plan = plan_of(panel(spark, SF))
        assert plan.count("Exchange hashpartitioning") == 1 and "partial_" in plan


def test_only_the_small_systems_go_to_python(spark):
    prices, index = pipeline.stored_model_inputs(spark, SF)
    plan = plan_of(regression.fit_ols(merge_price_and_risk(prices, index)))
    assert plan.count("ArrowEvalPython") == 1
    assert re.search(r"ArrowEvalPython.*\n.*HashAggregate", plan), "the solve sees one row per series"
    forecast_plan = plan_of(forecast.market_model(prices, index))
    assert "FlatMapGroups" not in forecast_plan and "BatchEvalPython" not in forecast_plan
