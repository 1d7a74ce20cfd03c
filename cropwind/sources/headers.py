"""First lines of files, read from their first block by tasks."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks get the code itself, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes in which a first line must end; a longer one is found by a scan.
HEADER_BYTES = 1 << 16
#: Endings of files that Spark decompresses.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file; null where only Spark can open the file or the line is too long."""
    for batch in batches:
        lines: list[str | None] = []
        for path in batch.column("file").to_pylist():
            start = b""
            if not path.endswith(PACKED):
                try:
                    store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
                    with store.open_input_stream(name, compression=None) as stream:
                        start = stream.read(HEADER_BYTES)
                except (OSError, ValueError):
                    start = b""
            end = re.search(rb"[\r\n]", start)
            lines.append(start[: end.start()].decode(errors="replace") if end else None)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(lines, pa.string())], names=["file", "header"])


def first_lines(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of the files of a path, by name.

    The list of files is what Spark's own scan keeps on the driver; it is made without reading content.
    Tasks read one block of each file. Files that they cannot open are scanned as text.
    """
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"))
    found = [(r["file"], r["header"]) for r in listed.mapInArrow(_first_lines, "file string, header string").collect()]
    closed = [file for file, header in found if header is None]
    known = [(file, header) for file, header in found if header is not None]
    return sorted(known + (_scanned(spark.read.text(closed)) if closed else []))


def _scanned(lines: DataFrame) -> list[tuple[str, str]]:
    start = lines.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("place")
    )
    first = start.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    return [(unquote(r["file"]), r["header"]) for r in first.collect()]
