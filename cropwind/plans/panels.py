"""Daily panels derived from the order tables.

Market segments play the commodities, supplier regions the growing regions.  Two wide panels
have one series per supplier, so their series count grows with the data and they have
weeks without rows.

Small tables are joined first, so the fact table is joined once, with only the columns it
needs.  No broadcast is forced: Spark broadcasts a dimension whose size allows it, and the
adaptive skew join splits the rows of a hot supplier or customer when it does not.  The
grouped aggregates reduce each task's rows before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropwind.sources.config import Region, RegionConfig
from cropwind.sources.paths import is_folder


# Stated schemas spare each read the job that would infer them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table as a stream: a folder of part files, or one file; a missing table is an error."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


#: Rows of a landed file, on average; one task writes it.
ROWS_PER_FILE = 500_000


def landed_stream(spark: SparkSession, sf_dir: str, name: str, path: str, keys: Iterable[str], batches: int = 4) -> DataFrame:
    """The table landed in the folder ``path`` and streamed in ``batches`` micro-batches.

    Rows are dealt to files by a hash of ``keys``: rows of one key come together, and every batch has rows
    from all parts of the table.  A larger table has more files in each batch, not larger ones, so the
    share of the task that writes a file does not grow with it.
    """
    rows = table(spark, sf_dir, name)
    files = batches * max(1, math.ceil(rows.count() / (batches * ROWS_PER_FILE)))
    rows.repartition(files, F.xxhash64(*keys)).write.parquet(f"{path}/{name}.parquet")
    # A file without rows is not written.
    landed = len(table(spark, path, name).inputFiles())
    return stream(spark, path, name, files_per_batch=math.ceil(landed / batches))


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("region_id")
    )


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = nation_regions(spark, sf_dir)
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "region_id")


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_linenumber"
    )
    return (
        lines.join(supplier_regions(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("region_id", "date")
        .agg(
            (F.sum("l_quantity") / F.count("*")).alias("temp"),
            F.sum("l_linenumber").cast("double").alias("precip"),
        )
    )


def daily_station_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather series per supplier."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date"))
        .agg(
            (F.sum("l_quantity") / F.count("*")).alias("temp"),
            F.sum("l_linenumber").cast("double").alias("precip"),
        )
    )


def daily_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of the day is the close."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("commodity"))
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("commodity", "date")
        .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))
    )


def daily_vendor_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price series per supplier: the highest line price of the day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("vendor_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.max("l_extendedprice").alias("close"))
    )


def daily_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("date")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = customers.join(nation_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return (
        orders.join(places.select("c_custkey", "region_id"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("region_id", "date")
        .agg(F.count("*").cast("double").alias("prod_estimate"), (cents.cast("double") / 100).alias("stocks"))
    )


_EVEN = {"temp_anom": 0.40, "precip_anom": 0.40, "ndvi": 0.10, "enso": 0.10}
_RAIN = {"temp_anom": 0.35, "precip_anom": 0.45, "ndvi": 0.10, "enso": 0.10}
_DRY = {"temp_anom": 0.30, "precip_anom": 0.50, "ndvi": 0.10, "enso": 0.10}
# No column named soil exists: its weight is spread over the others.
_SOIL = {"temp_anom": 0.30, "precip_anom": 0.40, "ndvi": 0.10, "soil": 0.20}

PANEL_CONFIG = RegionConfig(
    {
        "automobile": (
            Region("AFRICA", 0.20, _EVEN),
            Region("AMERICA", 0.30, _EVEN),
            Region("ASIA", 0.10, _EVEN),
            Region("EUROPE", 0.15, _EVEN),
            Region("MIDDLE EAST", 0.25, _EVEN),
        ),
        # Four regions only, and one that has no weather.
        "building": (
            Region("AFRICA", 0.20, _EVEN),
            Region("AMERICA", 0.30, _DRY),
            Region("EUROPE", 0.15, _EVEN),
            Region("MIDDLE EAST", 0.25, _EVEN),
            Region("ATLANTIS", 0.10, _EVEN),
        ),
        "furniture": (
            Region("AMERICA", 0.35, _RAIN),
            Region("ASIA", 0.40, _EVEN),
            Region("EUROPE", 0.25, _RAIN),
        ),
        "household": (
            Region("AFRICA", 0.50, _SOIL),
            Region("ASIA", 0.50, _DRY),
        ),
        "machinery": (
            Region("AMERICA", 0.45, _RAIN),
            Region("EUROPE", 0.40, _SOIL),
            Region("MIDDLE EAST", 0.15, _DRY),
        ),
    }
)
