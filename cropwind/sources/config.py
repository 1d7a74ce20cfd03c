"""Region weights, factor weights and the small reference dimensions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("commodity", T.StringType(), False),
        T.StructField("region_id", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("factors", T.MapType(T.StringType(), T.DoubleType(), False), False),
    ]
)


@dataclass(frozen=True)
class Region:
    region_id: str
    weight: float
    factors: Mapping[str, float]


@dataclass(frozen=True)
class RegionConfig:
    """commodity -> regions with their weight and factor mix."""

    commodities: Mapping[str, tuple[Region, ...]]

    @classmethod
    def from_mapping(cls, raw: Mapping) -> RegionConfig:
        """From the parsed file form ``{commodity: {regions: [{id, weight, factors}]}}``."""
        return cls(
            {
                name: tuple(
                    Region(str(r["id"]), float(r.get("weight", 0.0)), dict(r.get("factors", {})))
                    for r in body.get("regions", [])
                )
                for name, body in raw.items()
            }
        )

    @classmethod
    def from_file(cls, path: str) -> RegionConfig:
        """From a JSON file, or a YAML file where a YAML parser is installed."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return cls.from_mapping(json.loads(text))
        try:
            import yaml
        except ImportError as exc:
            raise ImportError("reading a YAML config needs PyYAML; use JSON instead") from exc
        return cls.from_mapping(yaml.safe_load(text))

    def only(self, *names: str) -> RegionConfig:
        """Restrict to some commodities."""
        for name in names:
            if name not in self.commodities:
                raise KeyError(f"commodity {name!r} is not configured")
            if not self.commodities[name]:
                raise ValueError(f"no regions configured for commodity {name!r}")
        return RegionConfig({name: self.commodities[name] for name in names})

    def region_ids(self) -> list[str]:
        return sorted({r.region_id for regions in self.commodities.values() for r in regions})

    def factor_names(self) -> list[str]:
        return sorted({f for regions in self.commodities.values() for r in regions for f in r.factors})

    def check_factors(self, columns: Iterable[str]) -> None:
        """Every region needs a factor that is a column, with weights that do not cancel out."""
        columns = set(columns)
        for commodity, regions in self.commodities.items():
            for r in regions:
                present = [w for f, w in r.factors.items() if f in columns]
                if not present:
                    raise ValueError(f"{commodity}/{r.region_id}: none of the factors is a column")
                if sum(present) == 0:
                    raise ValueError(f"{commodity}/{r.region_id}: factor weights add up to zero")

    def rows(self) -> list[tuple]:
        return [
            (name, r.region_id, r.weight, {f: float(w) for f, w in r.factors.items()})
            for name, regions in self.commodities.items()
            for r in regions
        ]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), CONFIG_SCHEMA)

    def broadcast_frame(self, spark: SparkSession) -> DataFrame:
        """The config with a broadcast hint when its size, known here, is below the session's threshold."""
        frame = self.to_frame(spark)
        size = sum(64 + len(c) + len(r) + sum(32 + len(f) for f in factors) for c, r, _, factors in self.rows())
        limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return F.broadcast(frame) if size <= limit else frame

    def factor_frame(self, spark: SparkSession) -> DataFrame:
        """Long form: one row per commodity, region and factor."""
        return self.to_frame(spark).select("commodity", "region_id", "weight", F.explode("factors").alias("factor", "factor_weight"))


# The standard region and factor weights.
_STANDARD = {"temp_anom": 0.40, "precip_anom": 0.40, "ndvi": 0.10, "enso": 0.10}
_RAIN_LED = {"temp_anom": 0.35, "precip_anom": 0.45, "ndvi": 0.10, "enso": 0.10}
_DRY_LED = {"temp_anom": 0.30, "precip_anom": 0.50, "ndvi": 0.10, "enso": 0.10}
_GREEN_LED = {"temp_anom": 0.30, "precip_anom": 0.40, "ndvi": 0.20, "enso": 0.10}

DEFAULT_CONFIG = RegionConfig(
    {
        "wheat": (
            Region("FR", 0.20, _STANDARD),
            Region("US", 0.30, _STANDARD),
            Region("BR", 0.10, _DRY_LED),
            Region("UA", 0.40, _STANDARD),
        ),
        "soybean": (
            Region("US", 0.35, _RAIN_LED),
            Region("BR", 0.40, _STANDARD),
            Region("AR", 0.15, _RAIN_LED),
            Region("CN", 0.10, _GREEN_LED),
        ),
        "corn": (
            Region("US", 0.35, _RAIN_LED),
            Region("BR", 0.25, _STANDARD),
            Region("CN", 0.15, _RAIN_LED),
            Region("UA", 0.25, _STANDARD),
        ),
    }
)

# Latitude and longitude of the region centres.
REGION_CENTRES = {
    "FR": (46.2276, 2.2137),
    "US": (39.8283, -98.5795),
    "BR": (-14.2350, -51.9253),
    "AR": (-34.6037, -58.3816),
    "CN": (35.8617, 104.1954),
    "UA": (48.3794, 31.1656),
}

# Front-future ticker per commodity.
TICKERS = {
    "soybean": "ZS=F",
    "corn": "ZC=F",
    "wheat": "ZW=F",
    "coffee": "KC=F",
    "sugar": "SB=F",
    "cocoa": "CC=F",
}


def ticker(commodity: str) -> str:
    try:
        return TICKERS[commodity.lower()]
    except KeyError:
        raise ValueError(f"unknown commodity: {commodity}") from None


def region_centres(spark: SparkSession) -> DataFrame:
    rows = [(r, lat, lon) for r, (lat, lon) in REGION_CENTRES.items()]
    return spark.createDataFrame(rows, "region_id string, latitude double, longitude double")


def commodity_tickers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TICKERS.items()), "commodity string, ticker string")


def with_region_centre(df: DataFrame) -> DataFrame:
    """Add the centre of each known region; rows of unknown regions are left out."""
    return df.join(F.broadcast(region_centres(df.sparkSession)), "region_id", "inner")


def with_ticker(df: DataFrame) -> DataFrame:
    """Add the ticker of each known commodity, matched without regard to case."""
    names = F.broadcast(commodity_tickers(df.sparkSession).withColumnRenamed("commodity", "_known"))
    return df.join(names, F.lower("commodity") == F.col("_known"), "inner").drop("_known")


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``key`` that have no row in ``known``: what an inner join would drop."""
    return df.select(key).distinct().join(known.select(key), key, "left_anti")
