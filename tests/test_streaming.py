from __future__ import annotations

import datetime as dt

import pytest
from conftest import d

from cropwind.sources import audit, tables
from cropwind.streaming import jobs


def run(df, path, mode="append"):
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()


def test_weeks_are_emitted_once_and_late_rows_count(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, region_id string, temp double, precip double"
    stamp = lambda text: dt.datetime.fromisoformat(text)

    def land(*rows):
        spark.createDataFrame([(stamp(t), "FR", v, p) for t, v, p in rows], schema).coalesce(1).write.mode("append").parquet(source)
        run(jobs.stream_weekly(spark.readStream.schema(schema).parquet(source)), out)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    # Friday evening still belongs to the week, Saturday 00:00 does not.
    assert land(("2024-01-05 23:59:00", 1.0, 1.0), ("2024-01-06 00:00:00", 5.0, 5.0), ("2024-01-16 00:00:00", 0.0, 0.0)) == []
    # Eleven days late, within the two weeks.
    assert land(("2024-01-04 00:00:00", 3.0, None), ("2024-01-21 00:00:00", 0.0, 0.0)) == [(d("2024-01-05"), "FR", 2.0, 1.0)]
    # The first week is closed now: its rows are too late and it is not emitted again.
    assert land(("2024-01-03 00:00:00", 99.0, 99.0), ("2024-01-28 00:00:00", 0.0, 0.0)) == [(d("2024-01-05"), "FR", 2.0, 1.0), (d("2024-01-12"), "FR", 5.0, 5.0)]


def test_stream_upsert_applies_batches_in_order(spark, tmp_path):
    source = str(tmp_path / "prints")
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"])
    schema = "date date, commodity string, price_spot double, seq long"

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).parquet(source)
        jobs.stream_upsert(rows, store, "prints", checkpoint=str(tmp_path / "state"), order="seq").awaitTermination()
        return sorted((r["commodity"], r["price_spot"]) for r in store.read().collect())

    day = d("2024-01-05")
    assert land((day, "corn", 2.0, 2), (day, "corn", 1.0, 1)) == [("corn", 2.0)]
    # A later batch with an earlier print changes nothing; one with a later print does.
    assert land((day, "corn", 7.0, 1), (day, "soy", 3.0, 1)) == [("corn", 2.0), ("soy", 3.0)]
    assert land((day, "corn", 8.0, 3)) == [("corn", 8.0), ("soy", 3.0)]


def test_weeks_are_corrected_whatever_order_rows_arrive_in(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "ts timestamp, region_id string, temp double, precip double"
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.WEEKLY_WEATHER, ["date", "region_id"])

    def land(*rows):
        spark.createDataFrame([(dt.datetime.fromisoformat(t), r, v, p) for t, r, v, p in rows], schema).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_weekly_corrected(rows, store, "weeks", checkpoint=str(tmp_path / "state")).awaitTermination()
        return {(str(r["date"]), r["region_id"]): (r["temp"], r["precip"]) for r in store.read().collect()}

    assert land(("2024-03-05", "FR", 4.0, 1.0), ("2024-03-06", "US", 1.0, None)) == {("2024-03-08", "FR"): (4.0, 1.0), ("2024-03-08", "US"): (1.0, 0.0)}
    # Two months late, and a second row of the first week.
    got = land(("2024-01-05 23:59:00", "FR", 2.0, 1.0), ("2024-03-07", "FR", 6.0, 2.0))
    assert got == {("2024-03-08", "FR"): (5.0, 3.0), ("2024-03-08", "US"): (1.0, 0.0), ("2024-01-05", "FR"): (2.0, 1.0)}
    # Nothing new changes nothing.
    before = sorted(p.name for p in (tmp_path / "store").rglob("*.parquet"))
    jobs.stream_weekly_corrected(spark.readStream.schema(schema).parquet(source), store, "weeks", checkpoint=str(tmp_path / "state")).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "store").rglob("*.parquet")) == before


def test_tables_of_part_files_stream_like_the_batch_tables(spark, tmp_path):
    from cropwind.plans import catalog, panels

    sf = "/root/testdata/sf0.001"
    for name in ("orders", "lineitem"):
        panels.table(spark, sf, name).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("customer", "supplier", "nation", "region"):
        panels.table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (catalog.stream_weekly, catalog.stream_upsert):
        rows = lambda where: sorted(map(repr, query(spark, where).collect()))
        assert rows(str(tmp_path)) == rows(sf) != []
    with pytest.raises(FileNotFoundError):
        panels.stream(spark, f"{tmp_path}/nowhere", "orders")


def test_larger_tables_land_in_more_files_not_larger_ones(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from cropwind.plans import catalog, panels

    sf, n, most = str(tmp_path / "in"), 6000, 300
    day = F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(cast(id % 50 AS int))")
    made = {
        "lineitem": spark.range(n).select((F.col("id") / 4).cast("bigint").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 6).alias("l_suppkey"), (F.col("id") % 7).cast("double").alias("l_quantity"), day.alias("l_shipdate")),
        "orders": spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"), F.col("id").cast("double").alias("o_totalprice"), day.alias("o_orderdate")),
        "supplier": spark.range(6).select(F.col("id").alias("s_suppkey"), F.lit(0).alias("s_nationkey")),
        "customer": spark.range(3).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Good"), "id").alias("c_mktsegment")),
        "nation": spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int"),
        "region": spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{sf}/{name}.parquet")
    monkeypatch.setattr(panels, "ROWS_PER_FILE", most, raising=False)
    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: str(tmp_path / name))

    weeks = {r["date"]: (r["temp"], r["precip"]) for r in catalog.stream_weekly_corrected(spark, sf).collect()}
    week = F.date_format(F.next_day(F.date_sub(F.to_date("l_shipdate"), 1), "FRI"), "yyyy-MM-dd")
    sums = panels.table(spark, sf, "lineitem").groupBy(week.alias("date")).agg(F.avg("l_quantity").alias("temp"), F.sum("l_linenumber").alias("precip"))
    assert weeks == {r["date"]: (pytest.approx(r["temp"], abs=1e-5), r["precip"]) for r in sums.collect()}
    closes = {(r["commodity"], r["date"]): r["price_spot"] for r in catalog.stream_upsert(spark, sf).collect()}
    assert closes == {(r["commodity"], str(r["date"])): r["close"] for r in panels.daily_market(spark, sf).collect()}

    for path, name in ((tmp_path / "corrected", "lineitem"), (tmp_path / "prints", "orders")):
        sizes = [r["count"] for r in panels.table(spark, str(path), name).groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * most
        assert len([p for p in (path / "state" / "commits").iterdir() if p.name.isdigit()]) == 4


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema, day = "ts timestamp, region_id string, temp double, precip double", dt.datetime(2024, 1, 5)
    # A batch's late rows are judged by the watermark of the batch before.
    for at in (day, day + dt.timedelta(days=60), day + dt.timedelta(days=61), day + dt.timedelta(days=1)):
        spark.createDataFrame([(at, "FR", 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    weeks = jobs.stream_weekly(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = weeks.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert jobs.late_rows_dropped(query) == 1


def test_audit_stream(spark, tmp_path):
    path, out = str(tmp_path / "logs"), str(tmp_path / "out")
    audit.log_event(spark, path, "gold", "index_written", {"path": "p", "rows": 5}, dt.datetime(2025, 11, 8))
    run(jobs.audit_stream(spark, path), out)
    audit.log_event(spark, path, "gold", "index_written", {"path": "p", "rows": 6}, dt.datetime(2025, 11, 9))
    run(jobs.audit_stream(spark, path), out)
    assert sorted(r["payload"]["rows"] for r in spark.read.parquet(out).collect()) == [5, 6]
