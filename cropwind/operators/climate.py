"""Regional stress scores and the global risk index."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.functions.columns import quoted, require_columns, text
from cropwind.functions.numeric import logistic_scale
from cropwind.sources.config import RegionConfig


def regional_score(
    columns: Iterable[str], weights: Mapping[str, float], scale_a: float = 1.0, scale_b: float = 0.0
) -> Column:
    """0-100 score of one factor mix.

    Factors without a column are left out and the other weights rescaled to one; a NULL in
    any factor used makes the score NULL.
    """
    columns = set(columns)
    present = {name: float(w) for name, w in weights.items() if name in columns}
    if not present:
        raise ValueError("none of the factors is a column of the table")
    total = sum(present.values())
    if total == 0:
        raise ValueError("the factor weights add up to zero")
    mix = reduce(lambda a, b: a + b, [F.col(n) * F.lit(w / total) for n, w in present.items()])
    return logistic_scale(mix, a=scale_a, b=scale_b)


def configured_score(
    columns: Iterable[str], factors: Iterable[str], map_column: str = "factors", scale_a: float = 1.0, scale_b: float = 0.0
) -> Column:
    """The same score with the weights in a map column, so one job serves every factor mix."""
    columns = set(columns)
    present = [f for f in factors if f in columns]
    if not present:
        raise ValueError("none of the factors is a column of the table")
    weights = [f"{map_column}[{text(f)}]" for f in present]
    total = " + ".join(f"coalesce({w}, 0D)" for w in weights)
    # A factor the row does not list adds nothing; a listed factor that is NULL spoils the score.
    mix = " + ".join(f"if({w} IS NULL, 0D, {w} * {quoted(f)})" for f, w in zip(present, weights, strict=True))
    return logistic_scale(F.expr(f"try_divide({mix}, {total})"), a=scale_a, b=scale_b)


def regional_scores(silver: DataFrame, config: RegionConfig, per_commodity: bool = False) -> DataFrame:
    """Mean score per commodity, region and date.

    ``silver`` needs ``date``, ``region_id`` and factor columns; every row serves all commodities
    that list its region.  With ``per_commodity`` a row serves only the commodity it names.  The
    config is a driver-side literal whose size is checked before it is broadcast; regions
    without config drop out of the inner join.
    """
    require_columns(silver.columns, ["date", "region_id"])
    config.check_factors(silver.columns)
    factors = [f for f in config.factor_names() if f in silver.columns]
    regions = config.broadcast_frame(silver.sparkSession)
    on = ["commodity", "region_id"] if per_commodity else ["region_id"]
    narrow = silver.select("date", *on, *factors).where(F.col("date").isNotNull())
    return (
        narrow.join(regions, on, "inner")
        .select("commodity", "region_id", "date", "weight", configured_score(silver.columns, factors).alias("_score"))
        .groupBy("commodity", "region_id", "date")
        .agg(F.avg("_score").alias("regional_score"), F.max("weight").alias("weight"))
    )


def contributions(scores: DataFrame) -> DataFrame:
    """Score times region weight; a missing score contributes nothing."""
    return scores.select(
        "commodity",
        "region_id",
        "date",
        F.coalesce(F.col("regional_score") * F.col("weight"), F.lit(0.0)).alias("contribution"),
    )


def global_index(silver: DataFrame, config: RegionConfig, per_commodity: bool = False) -> DataFrame:
    """0-100 index per commodity and date; weights of absent regions are not redistributed."""
    return (
        contributions(regional_scores(silver, config, per_commodity))
        .groupBy("commodity", "date")
        .agg(F.sum("contribution").alias("global_risk_0_100"))
        .select("date", "commodity", "global_risk_0_100")
    )


def global_index_wide(silver: DataFrame, config: RegionConfig) -> DataFrame:
    """The index with one ``contrib_<region>`` column per configured region, in one shuffle.

    The region list comes from the config, so no job is needed to find the pivot values.
    """
    long = contributions(regional_scores(silver, config))
    regions = config.region_ids()
    parts = [F.coalesce(F.sum(F.when(F.col("region_id") == r, F.col("contribution"))), F.lit(0.0)).alias(f"contrib_{r}") for r in regions]
    return (
        long.groupBy("commodity", "date")
        .agg(F.sum("contribution").alias("global_risk_0_100"), *parts)
        .select("date", "commodity", "global_risk_0_100", *[F.col(f"`contrib_{r}`") for r in regions])
    )


def simple_score(weather: DataFrame) -> DataFrame:
    """Unweighted stress: positive means warmer and drier than usual."""
    return weather.select("date", "region_id", (F.col("temp_anom") - F.col("precip_anom")).alias("climate_score"))


def simple_index(weather: DataFrame) -> DataFrame:
    """Equal-weight mean of the simple score over regions."""
    return simple_score(weather).groupBy("date").agg(F.avg("climate_score").alias("global_climate_index"))
