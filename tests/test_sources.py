from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from conftest import d, fridays
from pyspark.sql import functions as F

from cropwind.sources import audit, headers, landing, paths, tables

DAILY = "commodity string, date date, price_spot double"


def test_csv_is_matched_by_name_and_missing_files_are_empty(spark, tmp_path):
    (tmp_path / "m.csv").write_text("price_spot,extra,date,commodity\n1.5,x,2024-01-05T00:00:00Z,corn\nn/a,y,junk,soy\n")
    got = sorted(tables.csv_scan(spark, str(tmp_path / "m.csv"), tables.MARKET).select("commodity", "date", "price_spot", "data_source").collect())
    assert [tuple(r) for r in got] == [("corn", d("2024-01-05"), 1.5, None), ("soy", None, None, None)]
    assert "extra" in tables.csv_scan(spark, str(tmp_path / "m.csv"), tables.MARKET, keep_extra=True).columns
    (tmp_path / "empty.csv").write_text("")
    for name in ("none.csv", "empty.csv"):
        nothing = tables.csv_scan(spark, str(tmp_path / name), tables.MARKET)
        assert nothing.count() == 0 and nothing.columns == tables.MARKET.fieldNames()


def test_any_scan_prefers_parquet(spark, tmp_path):
    base = str(tmp_path / "prices")
    assert tables.any_scan(spark, base, tables.MARKET).count() == 0
    tables.write_table(spark.createDataFrame([("corn", d("2024-01-05"), 1.0)], DAILY), f"{base}.csv")
    assert tables.any_scan(spark, base, tables.MARKET).first()["price_spot"] == 1.0
    tables.write_table(spark.createDataFrame([("corn", d("2024-01-05"), 2.0)], DAILY), f"{base}.parquet")
    for name in (base, f"{base}.parquet"):
        assert tables.any_scan(spark, name, tables.MARKET).first()["price_spot"] == 2.0
    assert tables.any_scan(spark, f"{base}.csv", tables.MARKET).first()["price_spot"] == 1.0
    assert tables.read_table(spark, f"{base}.parquet", tables.MARKET).count() == 1
    assert tables.read_table(spark, f"{base}.csv", tables.MARKET).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "nope.csv"), tables.MARKET)


def test_nan_becomes_null(spark, tmp_path):
    tables.write_table(spark.createDataFrame([("corn", d("2024-01-05"), float("nan"))], DAILY), str(tmp_path / "n.parquet"))
    assert tables.parquet_scan(spark, str(tmp_path / "n.parquet"), tables.MARKET).first()["price_spot"] is None


def test_json_arrays_lines_and_broken_files(spark, tmp_path):
    records = [{"commodity": "corn", "date": "2024-01-14T00:00:00.000", "price_forecast": 1.0}, {"commodity": "corn", "date": "2024-01-21", "price_forecast": 2.0}]
    (tmp_path / "corn_forecast.json").write_text(json.dumps(records, indent=2))
    got = tables.json_scan(spark, str(tmp_path / "corn_forecast.json"), tables.FORECAST)
    assert sorted(r["date"] for r in got.collect()) == [d("2024-01-14"), d("2024-01-21")]
    (tmp_path / "broken.json").write_text("{not json")
    assert tables.json_scan(spark, str(tmp_path / "broken.json"), tables.FORECAST).count() == 0
    assert tables.json_scan(spark, str(tmp_path / "absent.json"), tables.FORECAST).count() == 0
    named = tables.with_commodity_from_file(spark.read.option("multiLine", True).json(str(tmp_path / "corn_forecast.json")))
    assert {r["commodity"] for r in named.collect()} == {"corn"}


def test_gold_sink_replaces_only_its_commodities(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = spark.createDataFrame([("corn", d("2024-01-05"), 1.0), ("soy", d("2024-01-05"), 2.0)], "commodity string, date date, global_risk_0_100 double")
    tables.gold_sink(rows, path, format="json")
    tables.gold_sink(rows.where("commodity = 'soy'").withColumn("global_risk_0_100", F.lit(3.0)), path, format="json")
    got = tables.json_scan(spark, path, tables.INDEX, lines=True)
    assert {(r["commodity"], r["date"], r["global_risk_0_100"]) for r in got.collect()} == {("corn", d("2024-01-05"), 1.0), ("soy", d("2024-01-05"), 3.0)}
    tables.csv_export(rows, str(tmp_path / "hedge"))
    assert spark.read.option("header", True).csv(str(tmp_path / "hedge.csv")).count() == 2


def test_store_touches_only_the_years_of_the_batch(spark, tmp_path):
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"])
    assert store.read().count() == 0
    old = spark.createDataFrame([("corn", d("2022-01-07"), 1.0), ("corn", d("2023-01-06"), 2.0), ("soy", d("2023-01-06"), 3.0)], DAILY)
    store.upsert(old, "1")
    untouched = sorted(p.name for p in (tmp_path / "store" / "year=2022").glob("*/*"))
    new = spark.createDataFrame([("corn", d("2023-01-06"), 9.0), ("corn", d("2024-01-05"), 4.0)], DAILY)
    for _ in range(2):
        store.upsert(new, "2")
        got = {(r["commodity"], str(r["date"])): r["price_spot"] for r in store.read().collect()}
        assert got == {("corn", "2022-01-07"): 1.0, ("corn", "2023-01-06"): 9.0, ("soy", "2023-01-06"): 3.0, ("corn", "2024-01-05"): 4.0}
    assert sorted(p.name for p in (tmp_path / "store" / "year=2022").glob("*/*")) == untouched
    store.overwrite(new)
    assert store.read().count() == 2


def test_store_makes_good_a_run_that_died(spark, tmp_path):
    path = str(tmp_path / "store")
    store = tables.SilverStore(spark, path, tables.MARKET, ["date", "commodity"])
    day = d("2023-01-06")
    store.upsert(spark.createDataFrame([("corn", day, 1.0)], DAILY), "1")
    second = spark.createDataFrame([("soy", day, 2.0)], DAILY)
    # The staging table of batch 2 is complete, but the year folder was not replaced.
    store._stage(second, "2", None)
    assert store.read().count() == 1
    store.upsert(spark.createDataFrame([("wheat", day, 3.0)], DAILY), "3")
    assert {(r["commodity"], r["price_spot"]) for r in store.read().collect()} == {("corn", 1.0), ("soy", 2.0), ("wheat", 3.0)}


def files(path):
    return {str(p.relative_to(path)) for p in path.glob("year=*/bucket=*/*.parquet")}


def test_a_batch_of_one_series_rewrites_one_bucket_with_one_write(spark, tmp_path, monkeypatch):
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"], buckets=16)
    names = [f"c{i}" for i in range(40)]
    store.upsert(spark.createDataFrame([(n, d(f"{y}-01-05"), 1.0) for n in names for y in (2022, 2023)], DAILY), "1")
    before = files(tmp_path / "store")
    assert len({f.split("/")[1] for f in before}) > 8
    writes = []
    write = tables.SilverStore._write
    monkeypatch.setattr(tables.SilverStore, "_write", lambda self, df: (writes.append(1), write(self, df)))
    store.upsert(spark.createDataFrame([("c7", d("2023-01-06"), 9.0)], DAILY), "2")
    gone = before - files(tmp_path / "store")
    assert len(writes) == 1 and len(gone) == 1 and gone.pop().startswith("year=2023/")
    assert store.read().count() == 81 and store.read().where("price_spot = 9").count() == 1
    # Another number of buckets counts for new stores only.
    again = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"], buckets=3)
    again.upsert(spark.createDataFrame([("c7", d("2023-01-06"), 8.0)], DAILY), "3")
    assert again.buckets == 16 and again.read().count() == 81


def test_series_are_replaced_as_a_whole(spark, tmp_path):
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"], buckets=4)
    rows = [(n, d(f"{y}-01-05"), 1.0) for n in ("a", "b", "c", "d", "e", None) for y in (2021, 2022, 2023)]
    store.upsert(spark.createDataFrame(rows, DAILY), "1")
    touched = spark.createDataFrame([("b",), (None,), ("new",)], "commodity string")
    assert sorted(store.read_series(touched).select("commodity").distinct().toPandas()["commodity"].fillna("-")) == ["-", "b"]
    store.replace_series(spark.createDataFrame([("b", d("2023-01-05"), 5.0), ("new", d("2024-01-05"), 6.0)], DAILY), touched)
    got = sorted((str(r["commodity"]), str(r["date"]), r["price_spot"]) for r in store.read().collect())
    want = [(str(n), str(day), p) for n, day, p in rows if n not in ("b", None)] + [("b", "2023-01-05", 5.0), ("new", "2024-01-05", 6.0)]
    assert got == sorted(want)
    store.replace_series(spark.createDataFrame([], DAILY), store.read().select("commodity"))
    assert store.read().count() == 0 and not files(tmp_path / "store")
    assert store.series_between(d("2020-01-01"), d("2030-01-01")).count() == 0


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_store_ends_a_move_that_died_half_way(spark, tmp_path, monkeypatch, moved):
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"], buckets=2)
    store.upsert(spark.createDataFrame([(n, d(f"{y}-01-05"), 1.0) for n in "abcd" for y in (2022, 2023)], DAILY), "1")
    move, done = tables.folder_moved, []

    def dies(*args):
        if len(done) == moved:
            raise OSError("died")
        done.append(args)
        move(*args)

    monkeypatch.setattr(tables, "folder_moved", dies)
    with pytest.raises(OSError, match="died"):
        store.upsert(spark.createDataFrame([(n, d("2023-01-05"), 2.0) for n in "abcd"] + [("a", d("2022-01-05"), 2.0)], DAILY), "2")
    monkeypatch.setattr(tables, "folder_moved", move)
    store.upsert(spark.createDataFrame([("e", d("2024-01-05"), 3.0)], DAILY), "3")
    got = {(r["commodity"], r["date"].year): r["price_spot"] for r in store.read().collect()}
    assert got == {**{(n, 2023): 2.0 for n in "abcd"}, **{(n, 2022): 1.0 for n in "bcd"}, ("a", 2022): 2.0, ("e", 2024): 3.0}


def test_gold_files_hold_disjoint_ranges(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "gold")
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 5) END AS commodity", "date_add(DATE '2000-01-01', CAST(id * 7919 % 6000 AS INT)) AS date", "CAST(id AS DOUBLE) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.gold_sink(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = {}
    for file in sorted((tmp_path / "gold").glob("commodity=*/*.parquet"), key=lambda f: f.name):
        dates = pq.read_table(file).column("date").to_pylist()
        assert dates == sorted(dates)
        spans.setdefault(file.parent.name, []).append((dates[0], dates[-1]))
    assert len(spans["commodity=hot"]) > 1
    for parts in spans.values():
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_headers_come_from_the_first_block(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"f {i}.csv").write_text(f"{'region_id,date' if i % 2 else 'date,region_id'},prod_estimate,stocks\r\n" + "FR,2024-01-05,1,2\n" * 3)
    (tmp_path / "only header.csv").write_text("date,region_id,prod_estimate,stocks")
    (tmp_path / "blank.csv").write_text("\nx,y\n")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as f:
        f.write("date,region_id,prod_estimate,stocks\n2024-01-05,US,1,2\n")
    (tmp_path / "long.csv").write_text("date,region_id,prod_estimate,stocks," + ",".join(f"c{i}" for i in range(20_000)) + "\n2024-01-05,BR,1,2" + "," * 20_000 + "\n")
    found = dict(headers.first_lines(spark, str(tmp_path)))
    assert len(found) == 34 and sum(h.startswith("region_id") for h in found.values()) == 15
    scanned = []
    monkeypatch.setattr(headers, "_scanned", lambda lines: scanned.extend(lines.inputFiles()) or [])
    headers.first_lines(spark, str(tmp_path))
    assert sorted(s.rsplit("/", 1)[1] for s in scanned) == ["long.csv", "only%20header.csv", "packed.csv.gz"]
    monkeypatch.undo()
    rows = tables.csv_scan(spark, str(tmp_path), tables.DAILY_SUPPLY)
    assert rows.where("region_id IN ('US', 'BR')").count() == 2 and rows.where("region_id = 'FR'").count() == 45


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "logs")
    for hour in (9, 10):
        audit.log_event(spark, path, "ingestion", "market_written", {"path": "p", "rows": hour}, dt.datetime(2025, 11, 8, hour))
    audit.log_event(spark, path, "ingestion", "agri_written", {}, dt.datetime(2025, 11, 9))
    got = audit.audit_scan(spark, path)
    assert got.count() == 3 and got.agg(F.sum("payload.rows")).first()[0] == 19
    assert sorted(p.name for p in (tmp_path / "logs").glob("event_date=*")) == ["event_date=2025-11-08", "event_date=2025-11-09"]


def payload(time, temp, precip):
    return json.dumps({"daily": {"time": time, "temperature_2m_mean": temp, "precipitation_sum": precip}})


def test_weather_payloads(spark, tmp_path):
    good = payload(["2024-01-01", "2024-01-02"], [1.0, None], [0.5, 2.0])
    for region, text in {"FR": good, "US": "{oops", "BR": "{}", "AR": payload(["2024-01-01"], [1.0], []), "CN": payload([], [], [])}.items():
        (tmp_path / f"{region}.json").write_text(text)
    got = sorted(tuple(r) for r in landing.one_row_per_day(landing.weather_files(spark, str(tmp_path)), "region_id").collect())
    assert got == [("FR", d("2024-01-01"), 1.0, 0.5), ("FR", d("2024-01-02"), None, 2.0)]


@pytest.mark.parametrize(
    "columns, picked",
    [(["Close", "Adj Close"], "Adj Close"), (["close_zs=f", "Open"], "close_zs=f"), (["x_adj_close", "Adj Close"], "Adj Close"),
     (["Close_ZS=F", "Close"], "Close"), (["Adj Close_ZS=F", "Close"], "Adj Close_ZS=F")],
)
def test_close_column_preference(columns, picked):
    assert landing.pick_close(columns) == picked


def test_close_column_errors_and_names():
    with pytest.raises(KeyError):
        landing.pick_close(["Open", "High"])
    assert landing.normalised_name(("Adj Close", "ZS=F")) == "adj_close_zs=f"
    assert landing.normalised_name(("Close", "")) == "close"


def test_daily_close_keeps_the_last_landed_row(spark, tmp_path):
    (tmp_path / "q.csv").write_text("date,Close_ZS=F,Adj Close_ZS=F\n2024-01-05,1,10\n2024-01-05,2,20\n2024-01-06,3,\nbad,4,4\n")
    quotes = spark.read.option("header", True).csv(str(tmp_path / "q.csv"))
    got = sorted(tuple(r) for r in landing.daily_close(quotes, "Soybean").collect())
    assert got == [("soybean", d("2024-01-05"), 20.0), ("soybean", d("2024-01-06"), None)]
    daily = spark.createDataFrame([("A", fridays(1)[0], 1.0), ("A", fridays(1)[0], 2.0)], "region_id string, date date, temp double").coalesce(1)
    assert [r["temp"] for r in landing.one_row_per_day(daily, "region_id", order="temp").collect()] == [2.0]
    with pytest.raises(ValueError, match="order column"):
        landing.one_row_per_day(daily, "region_id")


def test_files_are_read_under_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("region_id,date,prod_estimate,stocks\nFR,2024-01-05,1,2\n")
    (tmp_path / "b c.csv").write_text("stocks,region_id,date,prod_estimate\n4,US,2024-01-05,3\n")
    (tmp_path / "empty.csv").write_text("")
    got = sorted(tuple(r) for r in tables.csv_scan(spark, str(tmp_path), tables.DAILY_SUPPLY).collect())
    assert got == [("FR", d("2024-01-05"), 1.0, 2.0), ("US", d("2024-01-05"), 3.0, 4.0)]


def test_store_keeps_the_order_and_prunes_to_the_years_of_a_batch(spark, tmp_path):
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"])
    rows = lambda *r: spark.createDataFrame(list(r), f"{DAILY}, seq long")
    store.upsert(rows(("corn", d("2023-01-06"), 2.0, 5)), "a", order="seq")
    store.upsert(rows(("corn", d("2023-01-06"), 1.0, 4), ("corn", d("2024-01-05"), 9.0, 1)), "b", order="seq")
    assert sorted(r["price_spot"] for r in store.read().collect()) == [2.0, 9.0]
    plan = store._merged(store._batch(rows(("corn", d("2024-01-05"), 1.0, 1)), None), None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2024" in plan


def test_an_overwrite_drops_what_a_died_upsert_has_staged(spark, tmp_path):
    store = tables.SilverStore(spark, str(tmp_path / "store"), tables.MARKET, ["date", "commodity"])
    row = lambda price: spark.createDataFrame([("corn", d("2023-01-06"), price)], DAILY)
    store.upsert(row(1.0), "1")
    store._stage(row(2.0), "2", None)
    store.overwrite(row(50.0))
    store.upsert(spark.createDataFrame([("soy", d("2024-01-05"), 3.0)], DAILY), "1")
    assert sorted(r["price_spot"] for r in store.read().collect()) == [3.0, 50.0]


def test_shared_folder_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert paths.scratch_path(spark, "x").startswith(named)
    first, second = paths.written_together(spark, a=lambda: spark.range(3), b=lambda: spark.range(4))
    assert (first.count(), second.count()) == (3, 4)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        paths.shared_folder(Session())
