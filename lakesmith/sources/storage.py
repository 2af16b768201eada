"""Small file-system calls through the session's Hadoop configuration."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _open(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def glob_exists(spark: SparkSession, pattern: str) -> bool:
    files, path = _open(spark, pattern)
    found = files.globStatus(path)
    return found is not None and len(found) > 0


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Partition columns of a Parquet table, from its folder names."""
    columns: list[str] = []
    while True:
        files, pattern = _open(spark, "/".join([path.rstrip("/"), *["*=*"] * (len(columns) + 1)]))
        found = files.globStatus(pattern)
        if not found:
            return columns
        columns.append(found[0].getPath().getName().split("=", 1)[0])


def partition_folders(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a table's first partition column, from its folder names."""
    files, pattern = _open(spark, f"{path.rstrip('/')}/{column}=*")
    return [f.getPath().getName().split("=", 1)[1] for f in files.globStatus(pattern) or []]


def staging_path(path: str, kind: str = "staged") -> str:
    """A new folder next to a table, so on the same shared storage."""
    return f"{path.rstrip('/')}__{kind}-{uuid.uuid4().hex}"


@contextmanager
def staged_copy(df: DataFrame, path: str, staged: bool = True) -> Iterator[DataFrame]:
    """A frame written next to a table for the time of a block, and read back.

    It is then evaluated once however often it is read, and every read sees the
    same rows. ``staged=False`` passes the frame through.
    """
    if not staged:
        yield df
        return
    spark = df.sparkSession
    copy = staging_path(path, "source")
    try:
        df.write.parquet(copy)
        yield spark.read.schema(df.schema).parquet(copy)
    finally:
        files, folder = _open(spark, copy)
        files.delete(folder, True)


def put_back(spark: SparkSession, path: str) -> None:
    """Restore a table whose replacement broke off between setting it aside and putting in the new one.

    The folder set aside holds the whole table. Several of them are a state that
    no replacement leaves, so a person must decide.
    """
    files, live = _open(spark, path)
    if files.exists(live):
        return
    _, aside = _open(spark, f"{path.rstrip('/')}__previous-*")
    found = files.globStatus(aside) or []
    if len(found) > 1:
        raise RuntimeError(f"{path} is missing and {len(found)} earlier states lie beside it; move one back")
    if found and not files.rename(found[0].getPath(), live):
        raise RuntimeError(f"could not put the table back: {path}")


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put a completely written folder in the place of a table.

    The old folder is renamed first and dropped last, so a failure in between
    leaves it next to the table; the next write puts it back (:func:`put_back`). A reader that opened the old files fails rather
    than mix both; a table format with transactions avoids that.
    """
    files, live = _open(spark, path)
    _, new = _open(spark, staged)
    _, old = _open(spark, f"{path.rstrip('/')}__previous-{uuid.uuid4().hex}")
    had_table = files.exists(live)
    if had_table and not files.rename(live, old):
        raise RuntimeError(f"could not set the table aside: {path}")
    if not files.rename(new, live):
        if had_table:
            files.rename(old, live)
        raise RuntimeError(f"could not put the new table in place: {path}")
    if had_table:
        files.delete(old, True)
    spark.catalog.refreshByPath(path)
