"""The steps of a run over a data folder: ingest, index, model, hedge, report.

Layout under the root folder::

    landing/weather/<region>.json      archive payloads
    landing/quotes/<commodity>.csv     daily quotes with some close column
    landing/supply/*.csv               region_id, date, prod_estimate, stocks
    silver/daily_weather | daily_market | daily_supply   upserted daily tables
    silver/weather | market | supply   weekly tables derived from them
    silver/silver_data                 the three weekly tables merged, on request
    gold/global_index | forecast | hedge_rec   one folder per commodity
    report/<series>                    tables behind the report
    logs                               audit events

Every step works on all commodities at once, or on the ones named.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropwind.functions.calendar import rolling_scope, scope_ends
from cropwind.operators import anomalies, climate, forecast, hedge, market, report, silver, weekly
from cropwind.operators.grouped import LANDED, landed
from cropwind.sources import audit, landing, tables
from cropwind.sources.config import DEFAULT_CONFIG, RegionConfig, unknown_keys
from cropwind.sources.paths import note_read, note_written, stored


class Run:
    """One data folder.  ``as_of`` is the run's clock: it ends the 15-year scope and stamps rows."""

    def __init__(self, spark: SparkSession, root: str, as_of: dt.datetime, config: RegionConfig = DEFAULT_CONFIG):
        self.spark, self.root, self.as_of, self.config = spark, root.rstrip("/"), as_of, config

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _log(self, layer: str, action: str, payload: Mapping) -> None:
        audit.log_event(self.spark, self.path("logs"), layer, action, payload, self.as_of)

    # Ingest ----------------------------------------------------------------------------------

    def _in_scope(self, daily: DataFrame) -> DataFrame:
        return daily.where(rolling_scope("date", self.as_of.date()))

    def landed_weather(self) -> DataFrame:
        """Daily weather rows of the landed payloads, the last one of each region and day."""
        files = landing.weather_files(self.spark, self.path("landing", "weather"))
        return landing.one_row_per_day(files, "region_id")

    def landed_market(self) -> DataFrame:
        """Daily closes of every quote file; the commodity is the file's name, and each header has
        its own close column."""
        rows = []
        for raw in tables.csv_frames(self.spark, self.path("landing", "quotes")):
            named = landed(tables.with_commodity_from_file(raw, suffix=r"\.csv"))
            day = next(c for c in raw.columns if landing.normalised_name(c) == "date")
            rows.append(landing.dated_close(named, date=day))
        if not rows:
            return tables.empty(self.spark, tables.DAILY_MARKET)
        return landing.latest_close(reduce(DataFrame.unionByName, rows))

    def landed_supply(self) -> DataFrame:
        rows = [
            tables.conformed(landed(raw), tables.DAILY_SUPPLY, keep_extra=True).select(*tables.DAILY_SUPPLY.fieldNames(), LANDED)
            for raw in tables.csv_frames(self.spark, self.path("landing", "supply"))
        ]
        if not rows:
            return tables.empty(self.spark, tables.DAILY_SUPPLY)
        return landing.one_row_per_day(reduce(DataFrame.unionByName, rows), "region_id")

    def store(self, table: str) -> tables.SilverStore:
        schema = {"weather": tables.WEATHER, "market": tables.MARKET, "supply": tables.SUPPLY}[table]
        return tables.SilverStore(self.spark, self.path("silver", table), schema, silver.natural_keys(table, schema.fieldNames()))

    def daily_store(self, table: str) -> tables.SilverStore:
        schema = {"weather": tables.DAILY_WEATHER, "market": tables.DAILY_MARKET, "supply": tables.DAILY_SUPPLY}[table]
        return tables.SilverStore(self.spark, self.path("silver", f"daily_{table}"), schema, silver.natural_keys(table, schema.fieldNames()))

    def weekly(self, table: str, touched: DataFrame | None = None) -> DataFrame:
        """A weekly table from all stored days in scope: z-scores, returns and volatility see the
        whole history, whatever has landed last.  ``touched`` names the series to derive."""
        days = self.daily_store(table).read() if touched is None else self.daily_store(table).read_series(touched)
        derive = {"weather": anomalies.weather_anomalies, "market": market.weekly_market, "supply": weekly.weekly_supply}[table]
        return derive(self._in_scope(days))

    def _touched(self, table: str, batch: DataFrame) -> DataFrame:
        """The series whose weekly rows may change: those that have landed, and those with days that
        have come into the scope or left it since the last run.  Without a last run it is every series."""
        daily, last = self.daily_store(table), note_read(self.spark, self.path("silver", f"{table}_derived"))
        landed = batch.select(*daily.series)
        if last is None:
            return landed.unionByName(daily.read().select(*daily.series)).distinct()
        before, now = dt.date.fromisoformat(last["as_of"]), self.as_of.date()
        for old, new in zip(scope_ends(before), scope_ends(now), strict=True):
            if old != new:
                landed = landed.unionByName(daily.series_between(min(old, new), max(old, new)))
        return landed.distinct()

    def ingest(self, batch_id: str, force: bool = False) -> None:
        """Merge what has landed into the daily tables and derive the weekly rows of the series that
        this touches; ``force`` replaces the daily tables by what has landed and derives all anew."""
        landings = {"weather": self.landed_weather, "market": self.landed_market, "supply": self.landed_supply}
        for table, build in landings.items():
            self.landed(table, build(), batch_id, force)
            store = self.store(table)
            self._log("ingestion", f"{table}_written", {"path": store.path, "rows": store.read().count()})

    def landed(self, table: str, days: DataFrame, batch_id: str, force: bool = False) -> None:
        """Merge daily rows into their table and derive the weekly rows of the series they touch."""
        daily, store = self.daily_store(table), self.store(table)
        if force:
            daily.overwrite(days)
            store.overwrite(self.weekly(table))
        else:
            with stored(days, f"landed-{table}") as batch, stored(self._touched(table, batch), "touched") as touched:
                daily.upsert(batch, batch_id)
                store.replace_series(self.weekly(table, touched), touched)
        # Only now: what a run that died before has landed is derived when it lands again.
        note_written(self.spark, self.path("silver", f"{table}_derived"), {"as_of": self.as_of.date().isoformat()})

    def merge_silver(self) -> None:
        """The three tables side by side by date; no step needs it, so a run does not write it."""
        merged = silver.silver_merge(*[self.store(t).read() for t in ("weather", "market", "supply")])
        tables.write_table(merged, self.path("silver", "silver_data.parquet"))

    # Gold ------------------------------------------------------------------------------------

    def _write_gold(self, df: DataFrame, name: str) -> None:
        tables.gold_sink(df, self.path("gold", name), format="json")
        self._log("gold", f"{name}_written", {"path": self.path("gold", name)})

    def gold(self, name: str) -> DataFrame:
        if name == "hedge_rec":
            return tables.json_scan(self.spark, self.path("gold", name), tables.HEDGE, lines=True)
        schema = {"global_index": tables.INDEX, "forecast": tables.FORECAST}[name]
        return tables.json_scan(self.spark, self.path("gold", name), schema, lines=True)

    def climate_index(self, commodities: Iterable[str] | None = None, require_data: bool = False) -> None:
        """The index needs the weather alone, so it reads the weather table, not the merged one.

        ``require_data`` makes an index without rows an error.
        """
        config = self.config.only(*commodities) if commodities else self.config
        self._write_gold(climate.global_index(self.store("weather").read(), config), "global_index")
        if require_data and self.gold("global_index").isEmpty():
            raise ValueError("no region of the config has data")

    def _chosen(self, df: DataFrame, commodities: Iterable[str] | None) -> DataFrame:
        return df if not commodities else df.where(F.col("commodity").isin([c.lower() for c in commodities]))

    def market_model(self, commodities: Iterable[str] | None = None) -> None:
        prices = self._chosen(self.store("market").read(), commodities)
        self._write_gold(forecast.market_model(prices, self.gold("global_index")), "forecast")

    def hedge(
        self,
        commodities: Iterable[str] | None = None,
        profiles: Iterable[str] = tuple(hedge.PROFILES),
        roles: Iterable[str] = hedge.ROLES,
        exposure: float = 10000.0,
    ) -> None:
        state = hedge.latest_state(self._chosen(self.gold("forecast"), commodities), self.gold("global_index"))
        asked = hedge.with_request_grid(state, profiles, roles, exposure)
        self._write_gold(hedge.recommend(asked, self.as_of), "hedge_rec")

    # Report ----------------------------------------------------------------------------------

    def report_tables(self, window: str = "12M") -> dict[str, DataFrame]:
        path, index, prices = self.gold("forecast"), self.gold("global_index"), self.store("market").read()
        hedges = self.gold("hedge_rec")
        pct = report.pct_band_series(path)
        return {
            "kpis": report.kpi_row(path, index, hedges),
            "forecast_band": report.forecast_band_series(path),
            "forecast_domain": report.forecast_domain(path),
            "pct_band": pct,
            "pct_domain": report.pct_domain(pct),
            "price_history": report.price_history(prices, window),
            "risk_history": report.risk_history(index, window),
            "hedge_summary": report.hedge_summary_table(hedges),
            "hedge_detail": report.hedge_detail_table(hedges),
            "hedge_rec": hedges,
        }

    def report(self, window: str = "12M") -> None:
        for name, table in self.report_tables(window).items():
            tables.csv_export(table, self.path("report", name))

    def full(self, batch_id: str, commodities: Iterable[str] | None = None, force: bool = False, **wanted) -> None:
        commodities = list(commodities) if commodities else None
        self.ingest(batch_id, force)
        self.climate_index(commodities)
        self.market_model(commodities)
        self.hedge(commodities, **wanted)
        self.report()


def unconfigured(run: Run) -> DataFrame:
    """Commodities with prices but without regions: the model leaves them out."""
    return unknown_keys(run.store("market").read(), run.config.to_frame(run.spark), "commodity")
