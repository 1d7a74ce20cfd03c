"""Keep-one-row choices that survive a hot key.

They are grouped aggregates, so each task reduces its own rows before the shuffle and the
copies of a key never have to sit in one task, as a row number over the key would need.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple (which should be unique per key).

    NULL is a key value of its own, as in ``drop_duplicates``.
    """
    return _keep_one(df, list(keys), list(order), F.max_by)


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """One row per key: the one with the smallest ``order`` tuple."""
    return _keep_one(df, list(keys), list(order), F.min_by)


def _keep_one(df: DataFrame, keys: list[str], order: list[str | Column], choose) -> DataFrame:
    values = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    if not values:
        return df.select(*keys).distinct()
    chosen = df.groupBy(*keys).agg(choose(F.struct(*values), rank).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


LANDED = "_landed"


def landed(scan: DataFrame) -> DataFrame:
    """Tag the rows of a direct file scan with their landing order: file time, name, place in the file.

    Spark deals files to tasks by size, so a row number over tasks would let a small old file win.
    """
    meta = F.col("_metadata")
    return scan.withColumn(
        LANDED,
        F.struct(
            meta["file_modification_time"].alias("time"),
            meta["file_name"].alias("file"),
            meta["file_block_start"].alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` comes straight from files, so that :func:`landed` can tell their order."""
    try:
        df.select("_metadata.file_block_start")
    except AnalysisException:
        return False
    return True
