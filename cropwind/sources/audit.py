"""Audit events as JSON lines in one folder per day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField(
            "payload",
            T.StructType([T.StructField("path", T.StringType()), T.StructField("rows", T.LongType())]),
        ),
    ]
)


def audit_event(layer: str, action: str, payload: Mapping, at: dt.datetime) -> tuple:
    """One event; ``at`` is UTC."""
    return (at.isoformat() + "Z", layer, action, (payload.get("path"), payload.get("rows")))


def audit_append(events: DataFrame, path: str) -> None:
    """Append events to the folder of their day.  One task per input partition writes its own file."""
    dated = events.select(*AUDIT_SCHEMA.fieldNames(), F.substring("timestamp", 1, 10).alias("event_date"))
    dated.write.mode("append").partitionBy("event_date").json(path)


def log_event(spark: SparkSession, path: str, layer: str, action: str, payload: Mapping, at: dt.datetime) -> None:
    audit_append(spark.createDataFrame([audit_event(layer, action, payload, at)], AUDIT_SCHEMA), path)


def audit_scan(spark: SparkSession, path: str) -> DataFrame:
    """Events of all days, lines that are no event left out."""
    return spark.read.schema(AUDIT_SCHEMA).json(path).where(F.col("timestamp").isNotNull()).select(*AUDIT_SCHEMA.fieldNames())
