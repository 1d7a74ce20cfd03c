"""Tables on disk: tolerant readers, writers and the silver store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropwind.functions.calendar import parse_date
from cropwind.functions.columns import as_names, quoted
from cropwind.functions.numeric import null_if_nan
from cropwind.operators.grouped import keep_last
from cropwind.operators.silver import incremental_update
from cropwind.sources.headers import first_lines
from cropwind.sources.paths import exists, folder_moved, is_folder, leaf_folders, note_read, note_written, removed

D, S, DT = T.DoubleType(), T.StringType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DAILY_WEATHER = _schema(region_id=S, date=DT, temp=D, precip=D)
DAILY_MARKET = _schema(commodity=S, date=DT, close=D)
DAILY_SUPPLY = _schema(region_id=S, date=DT, prod_estimate=D, stocks=D)
WEEKLY_WEATHER = _schema(date=DT, region_id=S, temp=D, precip=D)
WEATHER = _schema(date=DT, region_id=S, temp_anom=D, precip_anom=D, ndvi=D, enso=D)
MARKET = _schema(date=DT, commodity=S, price_spot=D, price_front_fut=D, realized_vol_30d=D, data_source=S)
SUPPLY = _schema(date=DT, region_id=S, prod_estimate=D, stocks=D, data_source=S)
INDEX = _schema(date=DT, commodity=S, global_risk_0_100=D)
FORECAST = _schema(commodity=S, date=DT, price_forecast=D, y_forecast=D, price_lo95=D, price_hi95=D)

HEDGE = _schema(
    commodity=S, profile=S, role=S, exposure=D, forecast_horizon_weeks=T.IntegerType(), scenario=S, risk_score=D,
    hedge_ratio=D, hedge_notional=D, instrument=S, forecast_price=D, instrument_maturity=S, instrument_strike=D,
    summary=S, justification=S, timestamp=S,
)



def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def conformed(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Columns of ``schema`` matched by name: text that does not fit becomes NULL, NaN becomes
    NULL, absent columns are NULL."""
    columns = []
    for field in schema.fields:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        raw = F.col(quoted(field.name))
        if isinstance(field.dataType, T.DateType):
            value = raw if isinstance(df.schema[field.name].dataType, T.DateType) else parse_date(raw)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = null_if_nan(raw.try_cast(field.dataType))
        else:
            value = raw.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    extra = [F.col(quoted(c)) for c in df.columns if c not in schema.fieldNames()] if keep_extra else []
    return df.select(*columns, *extra)


def csv_frames(spark: SparkSession, path: str) -> list[DataFrame]:
    """One frame for each distinct header among the CSV files of a path.

    Spark names the columns of all files after the first one's header, so files are grouped by
    their first line and each group is read under its own.  Only the first block of a file is
    read for that.
    """
    try:
        lines = first_lines(spark, path)
    except AnalysisException as error:
        if _is_missing(error):
            return []
        raise
    files: dict[str, list[str]] = {}
    for file, header in lines:
        if header.strip():
            files.setdefault(header.removeprefix("\ufeff").rstrip("\r"), []).append(file)
    return [spark.read.options(header=True, enforceSchema=False).csv(group) for group in files.values()]


def csv_scan(spark: SparkSession, path: str, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """CSV with headers, matched by column name in each file.  A missing or empty file gives no rows."""
    frames = [conformed(raw, schema, keep_extra) for raw in csv_frames(spark, path)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames, empty(spark, schema)) if frames else empty(spark, schema)


def parquet_scan(spark: SparkSession, path: str, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Parquet files; a missing path gives no rows."""
    try:
        return conformed(spark.read.parquet(path), schema, keep_extra)
    except AnalysisException as error:
        if _is_missing(error):
            return empty(spark, schema)
        raise


def json_scan(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False, commodity_suffix: str | None = None) -> DataFrame:
    """JSON records: an array per file, or one record per line with ``lines`` as :func:`gold_sink`
    writes them.  Missing or unreadable files give no rows.  With ``commodity_suffix`` the commodity
    is the file's name up to that suffix, see :func:`with_commodity_from_file`.

    Dates are read as text first, so ISO timestamps and plain days both work.
    """
    as_text = T.StructType(
        [T.StructField(f.name, S if isinstance(f.dataType, T.DateType) else f.dataType) for f in schema.fields]
    )
    try:
        raw = spark.read.schema(as_text).option("multiLine", not lines).json(path)
    except AnalysisException as error:
        if _is_missing(error):
            return empty(spark, schema)
        raise
    # A broken document is read as a record without any field.
    filled = F.coalesce(*[F.col(quoted(c)).cast("string") for c in raw.columns]).isNotNull()
    rows = raw.where(filled)
    return conformed(rows if commodity_suffix is None else with_commodity_from_file(rows, commodity_suffix), schema)


def any_scan(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """``base`` with or without extension: parquet first, then CSV, else no rows."""
    if base.endswith(".csv"):
        return csv_scan(spark, base, schema)
    stem = base.removesuffix(".parquet")
    for path in dict.fromkeys([base, f"{stem}.parquet"]):
        try:
            return conformed(spark.read.parquet(path), schema)
        except AnalysisException as error:
            if not _is_missing(error):
                raise
    return csv_scan(spark, f"{stem}.csv", schema)


def _format_of(path: str) -> str:
    return "parquet" if path.lower().rstrip("/").endswith((".parquet", ".parq")) else "csv"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet or CSV by suffix; unlike the scans, a missing path is an error."""
    if _format_of(path) == "parquet":
        return conformed(spark.read.parquet(path), schema)
    if not csv_frames(spark, path) and not is_folder(spark, path):
        raise ValueError(f"{path} has no header")
    return csv_scan(spark, path, schema)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet or CSV by suffix, replacing what is there."""
    df.write.format(_format_of(path)).option("header", True).mode("overwrite").save(path)


def gold_sink(df: DataFrame, path: str, keys: str | Iterable[str] = "commodity", format: str = "parquet") -> None:
    """One folder per commodity; only the commodities written are replaced.

    Rows are dealt by sampled ranges of commodity and date: files hold disjoint ranges in the order of
    their numbers, so a filter by date skips files, and a large commodity is cut into several.
    """
    keys = as_names(keys)
    order = [*map(quoted, keys), *[c for c in ("date",) if c in df.columns]]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy(*keys)
        .format(format)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .save(path)
    )


def csv_export(hedge: DataFrame, path: str) -> None:
    """A report table as CSV with a header, in the order of its columns."""
    write_table(hedge.orderBy(*map(quoted, hedge.columns)), path if path.endswith(".csv") else f"{path}.csv")


def with_commodity_from_file(df: DataFrame, suffix: str = "_forecast") -> DataFrame:
    """Add the commodity named by the file a row came from: ``wheat_forecast.json`` -> wheat."""
    return df.withColumn("commodity", F.regexp_extract(F.col("_metadata.file_name"), f"^(.*){suffix}", 1))


#: Buckets of a new store. A series (the key without its date) has one bucket in every year.
BUCKETS = 8


class SilverStore:
    """A silver table in folders by year and bucket of series that is upserted batch by batch.

    A write puts the rows of the folders that it touches into ``<path>_staging``, notes that they are
    complete, and moves the folders into the table, which copies no data.  A run that died before the
    note changed nothing; one that died after it is made good by the next write, as moving the folders
    that are left gives the same table.  An overwrite replaces the whole table and drops what a died run
    had staged.  Merging a batch again changes nothing, so no batch is ever skipped.

    With ``order`` the stored table remembers each row's order value, so that the latest row wins
    whichever batch brings it.  Without it the newer batch wins.  ``buckets`` counts for a new store; an
    old one keeps its number.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, on: Iterable[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.on = spark, path.rstrip("/"), schema, list(on)
        self.series = [c for c in self.on if c != "date"]
        self.staging, self.noted = f"{self.path}_staging", f"{self.path}_staged"
        self._wanted_buckets = buckets
        self._stored = T.StructType(
            [*schema.fields, T.StructField("_order", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
        )

    @cached_property
    def buckets(self) -> int:
        layout = note_read(self.spark, f"{self.path}_layout")
        if layout is None:
            layout = {"buckets": self._wanted_buckets}
            note_written(self.spark, f"{self.path}_layout", layout)
        return layout["buckets"]

    def _bucket(self) -> Column:
        hashed = F.xxhash64(*map(quoted, self.series)) if self.series else F.lit(0)
        return F.pmod(hashed, F.lit(self.buckets)).cast("int").alias("bucket")

    def _scan(self, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(self._stored).parquet(path)
        except AnalysisException as error:
            if _is_missing(error):
                return empty(self.spark, self._stored)
            raise

    def read(self) -> DataFrame:
        return self._scan(self.path).select(*self.schema.fieldNames())

    def _buckets_of(self, touched: DataFrame) -> list[int]:
        """As literals, buckets prune the folders to read; there are no more than the store has."""
        return sorted(row["bucket"] for row in touched.select(self._bucket()).distinct().collect())

    def _same_series(self, rows: DataFrame, touched: DataFrame, how: str) -> DataFrame:
        named = touched.select(*[F.col(quoted(c)).alias(f"_s{i}") for i, c in enumerate(self.series)]).distinct()
        same = [F.col(quoted(c)).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(self.series)]
        return rows.join(named, same, how)

    def read_series(self, touched: DataFrame) -> DataFrame:
        """Rows of the series named in ``touched``; other buckets are not read."""
        rows = self._scan(self.path).where(F.col("bucket").isin(self._buckets_of(touched)))
        return self._same_series(rows, touched, "left_semi").select(*self.schema.fieldNames())

    def series_between(self, first: dt.date, last: dt.date) -> DataFrame:
        """The series with rows in a range of days; other years are not read."""
        days = (F.col("year") >= first.year) & (F.col("year") <= last.year) & F.col("date").between(F.lit(first), F.lit(last))
        return self._scan(self.path).where(days).select(*self.series).distinct()

    def overwrite(self, new: DataFrame) -> None:
        """Replace the table by ``new``, one row per key; what a died run has staged is dropped."""
        removed(self.spark, self.noted)
        only = incremental_update(None, conformed(new, self.schema), self.on)
        only = only.withColumns({"_order": F.lit(None).cast("bigint"), "year": F.year("date"), "bucket": self._bucket()})
        self._write(only.select(*self._stored.fieldNames()).repartition("year", "bucket"))
        self._note({"whole": True})
        self._apply()

    def upsert(self, new: DataFrame, batch_id: str, order: str | None = None) -> None:
        """Merge ``new`` into the table; its rows win over stored ones with the same key, unless
        ``order`` says that a stored one is later.  Only the folders of its keys are rewritten."""
        self._apply()
        self._stage(new, batch_id, order)
        self._apply()

    def replace_series(self, rows: DataFrame, touched: DataFrame) -> None:
        """Put ``rows`` in the place of all rows of the series named in ``touched``."""
        self._apply()
        buckets = self._buckets_of(touched)
        if not buckets:
            return
        old = self._scan(self.path).where(F.col("bucket").isin(buckets))
        self._write(self._same_series(old, touched, "left_anti").unionByName(self._batch(rows, None)).repartition("year", "bucket"))
        # Folders of these buckets in which nothing is left.
        now = set(leaf_folders(self.spark, self.staging, 2))
        ends = tuple(f"/bucket={b}" for b in buckets)
        self._note({"drop": [f for f in leaf_folders(self.spark, self.path, 2) if f.endswith(ends) and f not in now]})
        self._apply()

    def _batch(self, new: DataFrame, order: str | None) -> DataFrame:
        position = F.col(quoted(order)).cast("bigint") if order else F.lit(None).cast("bigint")
        rows = conformed(new, self.schema, keep_extra=True).withColumn("_order", position)
        rows = rows.select(*self.schema.fieldNames(), "_order").where(F.col("date").isNotNull())
        # One row per key before anything is stored: the copies of a key are combined in each task.
        one = keep_last(rows, self.on, ["_order", F.struct(*self.schema.fieldNames())])
        return one.withColumns({"year": F.year("date"), "bucket": self._bucket()}).select(*self._stored.fieldNames())

    def _merged(self, batch: DataFrame, order: str | None) -> DataFrame:
        """Rows of the touched folders with the batch merged in."""
        # The folders of one batch are no more than the store's, and as literals they prune what is read.
        buckets: dict[int, list[int]] = {}
        for row in batch.select("year", "bucket").distinct().collect():
            buckets.setdefault(row["year"], []).append(row["bucket"])
        touched = [(F.col("year") == y) & F.col("bucket").isin(sorted(b)) for y, b in sorted(buckets.items())]
        old = self._scan(self.path).where(reduce(Column.__or__, touched, F.lit(False)))
        both = old.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
        # Folder by folder, so that the rows are shuffled once for the merge and for the write.
        both = both.repartition("year", "bucket")
        return keep_last(both, ["year", "bucket", *self.on], ["_order", "_batch"] if order else ["_batch"]).drop("_batch")

    def _write(self, df: DataFrame) -> None:
        (
            df.sortWithinPartitions("year", "bucket", *self.on)
            .write.partitionBy("year", "bucket")
            .mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .parquet(self.staging)
        )

    def _stage(self, new: DataFrame, batch_id: str, order: str | None) -> None:
        # Kept for the two jobs that read it: the folders it touches, and the merge.
        batch = self._batch(new, order).persist()
        try:
            self._write(self._merged(batch, order))
        finally:
            batch.unpersist()
        self._note({"batch": batch_id})

    def _note(self, value: dict) -> None:
        note_written(self.spark, self.noted, value)

    def _apply(self) -> None:
        """Move what is staged and complete into the table; done again after a crash, it ends the same."""
        staged = note_read(self.spark, self.noted)
        if staged is None:
            return
        if staged.get("whole"):
            if exists(self.spark, self.staging):
                folder_moved(self.spark, self.staging, self.path)
        else:
            for folder in staged.get("drop", ()):
                removed(self.spark, f"{self.path}/{folder}")
            for folder in leaf_folders(self.spark, self.staging, 2):
                folder_moved(self.spark, f"{self.staging}/{folder}", f"{self.path}/{folder}")
        removed(self.spark, self.noted)
        removed(self.spark, self.staging)
