"""Streams: upsert of landed batches, weekly weather in any order of arrival, audit tail."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cropwind.functions.columns import as_names
from cropwind.sources.audit import AUDIT_SCHEMA
from cropwind.sources.paths import shared_folder
from cropwind.sources.tables import SilverStore


def stream_weekly(
    daily: DataFrame, keys: str | Iterable[str] = "region_id", late: str = "14 days", ts: str = "ts"
) -> DataFrame:
    """Weekly mean temperature and total precipitation of a stream; ``ts`` is a timestamp.

    Rows may be ``late``; a week is emitted once, when the watermark passes its end.  Weeks
    run from Saturday to Friday: the epoch was a Thursday, hence the offset of two days.
    """
    return _weeks(daily.withWatermark(ts, late), as_names(keys), ts)


def _weeks(daily: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return (
        daily.groupBy(F.window(ts, "7 days", "7 days", "2 days").alias("_week"), *keys)
        .agg(F.avg("temp").alias("temp"), F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip"))
        .select(_utc_day_before("_week.end").alias("date"), *keys, "temp", "precip")
    )


def stream_weekly_corrected(
    daily: DataFrame,
    store: SilverStore,
    name: str,
    keys: str | Iterable[str] = "region_id",
    checkpoint: str | None = None,
    ts: str = "ts",
    forget: str | None = None,
) -> StreamingQuery:
    """Weekly weather of a stream in ``store``, whatever order the rows arrive in.

    The state holds sum and count of every week.  A micro-batch emits each week that it changes
    again, with all rows so far, and the store replaces the week's row; weeks are as many as
    the calendar has for each key.  With ``forget`` (an age such as "60 days") older weeks leave the state
    and rows that come later than that are left out, as in :func:`stream_weekly`.
    """
    keys = as_names(keys)
    weeks = _weeks(daily.withWatermark(ts, forget) if forget else daily, keys, ts)

    def apply(batch: DataFrame, number: int) -> None:
        store.upsert(batch, batch_id=f"{name}-{number}")

    location = checkpoint or f"{shared_folder(daily.sparkSession)}/stream-{name}"
    return (
        weeks.writeStream.foreachBatch(apply)
        .outputMode("update")
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start()
    )


def _utc_day_before(moment: str) -> Column:
    return F.date_sub(F.to_date(F.to_utc_timestamp(moment, F.current_timezone())), 1)


def stream_upsert(
    rows: DataFrame, store: SilverStore, name: str, checkpoint: str | None = None, order: str | None = None
) -> StreamingQuery:
    """Upsert each micro-batch into ``store``; ``order`` names the column that says which row is later.

    The store keeps that column, so a row that is later wins in whichever batch it comes.
    Merging is idempotent: a batch that is replayed after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.upsert(batch, batch_id=f"{name}-{number}", order=order)

    location = checkpoint or f"{shared_folder(rows.sparkSession)}/stream-{name}"
    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start()
    )


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows of a query's recent batches that came after the watermark had passed them.

    With several batches the weeks of :func:`stream_weekly` depend on the order of arrival; rows
    later than ``late`` are left out, and this is their count (of groups, where Spark has
    combined a batch's rows before it looked at the watermark).
    """
    return sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Audit events as they are appended."""
    events = spark.readStream.schema(AUDIT_SCHEMA).option("recursiveFileLookup", True).json(path)
    return events.where(F.col("timestamp").isNotNull())
