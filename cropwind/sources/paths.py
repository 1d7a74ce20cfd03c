"""Where intermediate tables go."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session may do without the setting and gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so the setting is required there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    # A master that cannot be read belongs to a remote session, which is a cluster.
    master = spark.conf.get("spark.master", None) or ""
    if re.match(r"local($|\[)", master):
        return _local_folder()
    raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name for one run's table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    """One temporary folder per process, for local sessions only."""
    return tempfile.mkdtemp(prefix="cropwind-")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder; a path that does not exist is an error."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        raise FileNotFoundError(path)
    return files.getFileStatus(where).isDirectory()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; one that is gone already does no harm."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def note_written(spark: SparkSession, path: str, value: dict) -> None:
    """A few values in a file of their own. It is there as a whole or not at all."""
    files, part = _file_system(spark, f"{path}.part")
    out = files.create(part, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    folder_moved(spark, f"{path}.part", path)


def note_read(spark: SparkSession, path: str) -> dict | None:
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def folder_moved(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder (or file) in the place of another one; only names change, no data is copied."""
    files, new = _file_system(spark, source)
    old = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not files.delete(old, True):
        files.mkdirs(old.getParent())
    if not files.rename(new, old):
        raise OSError(f"{source} could not be moved to {target}")


def leaf_folders(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Partition folders ``a=1/b=2`` below a table's path, of which there are as many as the layout has."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return []
    found = [("", where)]
    for _ in range(depth):
        below = [(name, status) for name, folder in found for status in files.listStatus(folder) if status.isDirectory()]
        found = [(f"{name}/{s.getPath().getName()}".lstrip("/"), s.getPath()) for name, s in below if "=" in s.getPath().getName()]
    return sorted(name for name, _ in found)


@contextmanager
def stored(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a stored table that is deleted at the end of the block."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        removed(df.sparkSession, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` as a table in the shared folder and go on from there.

    Used for weekly panels that several later steps read: the raw rows are scanned once, lost
    executors cost no recomputation, and Spark knows the true size when it plans the joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_together(spark: SparkSession, **builders: Callable[[], DataFrame]) -> list[DataFrame]:
    """Build and store independent tables at the same time: one Spark job each, none waiting for
    the other's last task."""
    def store(name: str) -> DataFrame:
        return written(builders[name](), name)

    with ThreadPoolExecutor(max_workers=len(builders)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(store), name) for name in builders]
        return [job.result() for job in running]
