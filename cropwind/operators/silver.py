"""Silver layer: upsert, regional alignment and the merged table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropwind.functions.calendar import parse_date
from cropwind.functions.columns import require_columns
from cropwind.operators.grouped import LANDED, is_scan, keep_last, landed
from cropwind.sources.config import RegionConfig

# The aligned table's columns.
ALIGNED_COLUMNS = [
    "date",
    "region_id",
    "region_weight",
    "temp_anom",
    "precip_anom",
    "ndvi",
    "enso",
    "prod_estimate",
    "stocks",
    "price_spot",
    "price_front_fut",
    "realized_vol_30d",
]


def natural_keys(table: str, columns: Iterable[str]) -> list[str]:
    """Upsert key of a silver table; supply counts per commodity where it has that column."""
    keys = {
        "weather": ["date", "region_id"],
        "market": ["date", "commodity"],
        "supply": ["date", "region_id"],
    }[table]
    return [*keys, "commodity"] if table == "supply" and "commodity" in columns else keys


def incremental_update(
    existing: DataFrame | None,
    new: DataFrame | None,
    on: Iterable[str],
    date: str = "date",
    order: str | None = None,
) -> DataFrame:
    """Union of both batches with one row per key; the new batch wins, then the latest row in it.

    ``order`` names the column that says which of two rows of one batch is later.  Without it
    the landing order decides for a batch that comes straight from files or was tagged by
    ``landed``; for any other batch rows have no order, and the greatest row of a key is kept.
    Rows without a date are dropped.  A first load is reduced to one row per key as well, so
    applying the same batch twice changes nothing.
    """
    if new is None and existing is None:
        raise ValueError("nothing to update: both batches are missing")
    batches = [(0, existing), (1, new)]
    tagged = []
    for number, batch in batches:
        if batch is None:
            continue
        if order is None and LANDED not in batch.columns and is_scan(batch):
            batch = landed(batch)
        position = _position(batch, order)
        tagged.append(
            batch.withColumns({"_batch": F.lit(number), "_position": position})
            .drop(LANDED)
            .withColumn(date, parse_date(date) if batch.schema[date].dataType.typeName() != "date" else F.col(date))
            .where(F.col(date).isNotNull())
        )
    combined = tagged[0] if len(tagged) == 1 else tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    values = F.struct(*[c for c in combined.columns if c not in ("_batch", "_position")])
    return keep_last(combined, on, ["_batch", "_position", values]).drop("_batch", "_position")


def _position(batch: DataFrame, order: str | None) -> Column:
    """The order value or the landing order in one form, so that two batches can be put together."""
    none = F.lit(None)
    place = F.col(LANDED) if order is None and LANDED in batch.columns else None
    return F.struct(
        (F.col(order) if order else none).cast("bigint").alias("order"),
        (place["time"] if place is not None else none).cast("timestamp").alias("time"),
        (place["file"] if place is not None else none).cast("string").alias("file"),
        (place["block"] if place is not None else none).cast("bigint").alias("block"),
        (place["row"] if place is not None else none).cast("bigint").alias("row"),
    )


def align_regions(
    weather: DataFrame,
    market: DataFrame,
    supply: DataFrame,
    regions: Iterable[str] | None = None,
    config: RegionConfig | None = None,
) -> DataFrame:
    """Weather per region and week with supply of the region and prices of the week.

    Only regions with weather and supply appear.  Without ``config`` the market table must
    hold one commodity, whose prices go to every region.  With ``config`` the result has a
    ``commodity`` column and each commodity meets only its own regions.
    """
    left = weather
    if regions is not None:
        left = left.where(F.col("region_id").isin(list(regions)))
    left = left.join(supply.select("region_id").distinct(), "region_id", "left_semi")
    left = left.join(supply.select("date", "region_id", "prod_estimate", "stocks"), ["date", "region_id"], "left")
    prices = ["price_spot", "price_front_fut", "realized_vol_30d"]
    columns = ALIGNED_COLUMNS
    if config is None:
        left = left.join(market.select("date", *prices), "date", "left")
    else:
        members = config.broadcast_frame(weather.sparkSession).select("commodity", "region_id")
        left = left.join(members, "region_id", "inner")
        left = left.join(market.select("date", "commodity", *prices), ["date", "commodity"], "left")
        columns = ["commodity", *ALIGNED_COLUMNS]
    # The weight is filled in by the index step.
    return left.withColumn("region_weight", F.lit(None).cast("double")).select(*columns)


def _suffixed(df: DataFrame, taken: Iterable[str], keys: Iterable[str], suffix: str) -> DataFrame:
    clash = {c: f"{c}{suffix}" for c in df.columns if c in set(taken) and c not in set(keys)}
    return df.withColumnsRenamed(clash)


def _full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which NULL keys match each other, as in a table merge."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    joined = left.join(renamed, condition, "full_outer")
    kept = [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in keys else F.col(c) for c in left.columns]
    return joined.select(*kept, *[c for c in right.columns if c not in keys])


def silver_merge(weather: DataFrame, market: DataFrame | None, supply: DataFrame | None) -> DataFrame:
    """All three tables side by side: prices by date, supply by date and region, nothing lost.

    Colliding columns of market and supply get the suffix ``_market`` or ``_agri``.  A market
    table with several commodities repeats each weather row once per commodity.
    """
    require_columns(weather.columns, ["date", "region_id"])
    merged = weather.where(F.col("date").isNotNull())
    if market is not None:
        dated = market.where(F.col("date").isNotNull())
        merged = _full_outer(merged, _suffixed(dated, merged.columns, ["date"], "_market"), ["date"])
    if supply is not None:
        dated = supply.where(F.col("date").isNotNull())
        keys = ["date", "region_id"]
        merged = _full_outer(merged, _suffixed(dated, merged.columns, keys, "_agri"), keys)
    return merged


def silver_nested(weather: DataFrame, market: DataFrame, supply: DataFrame) -> DataFrame:
    """The merged table before its rows are multiplied: one row per date with the arrays ``weather``,
    ``market`` and ``supply`` of the rows of that date.

    An array is as long as a date has regions or commodities, as silver tables hold one row for each;
    it is empty where its table has none. Rows are sorted within an array. ``nested_rows`` gives a table
    back, and ``silver_merge`` of the three is the wide form.
    """
    parts = {"weather": weather, "market": market, "supply": supply}
    kinds = {name: T.StructType([f for f in part.schema if f.name != "date"]) for name, part in parts.items()}
    rows = None
    for name, part in parts.items():
        packed = {n: F.struct(*kinds[n].fieldNames()) if n == name else F.lit(None).cast(kinds[n]) for n in kinds}
        tagged = part.where(F.col("date").isNotNull()).select("date", *[value.alias(n) for n, value in packed.items()])
        rows = tagged if rows is None else rows.unionByName(tagged)
    # One shuffle by date for all three; NULLs are not collected.
    return rows.groupBy("date").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in kinds])


def nested_rows(nested: DataFrame, name: str) -> DataFrame:
    """One of the tables of ``silver_nested``, row by row; the other arrays are not read."""
    return nested.select("date", F.inline(name))
