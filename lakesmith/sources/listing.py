"""Object inventories: read from an inventory table, or listed in parallel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY_SCHEMA = "bucket string, key string, size long, last_modified timestamp"
_UNIT_SCHEMA = "bucket string, base string, key string, size long, last_modified timestamp, folder boolean"
_BATCH = 10_000


def inventory_from(
    df: DataFrame,
    *,
    bucket: str = "bucket",
    key: str = "key",
    size: str = "size",
    last_modified: str | None = "last_modified",
) -> DataFrame:
    """The inventory columns of a frame such as a storage inventory report."""
    changed = F.col(last_modified) if last_modified else F.lit(None)
    return df.select(
        F.trim(F.trim(bucket), F.lit("/")).alias("bucket"),
        F.col(key).alias("key"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        changed.cast("timestamp").alias("last_modified"),
    )


def _children(base: str, folder: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(base.replace("s3a://", "s3://", 1))
    path = f"{root}/{folder}" if folder else root
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        yield info, info.path[len(root) :].lstrip("/"), info.type == fs.FileType.Directory


def _row(bucket: str, base: str, info, key: str, folder: bool) -> tuple:
    changed = None if folder else pd.Timestamp(info.mtime).tz_convert("UTC").tz_localize(None)
    return bucket, base, key, 0 if folder else int(info.size or 0), changed, folder


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["bucket", "base", "key", "size", "last_modified", "folder"])
    frame["last_modified"] = pd.to_datetime(frame["last_modified"])
    return frame


def _expand(batches: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
    """Replace folders by what they hold: one level, or everything below."""
    for batch in batches:
        rows: list[tuple] = []
        files = batch[~batch["folder"]]
        if len(files):
            yield files
        open_folders = [tuple(r) for r in batch[batch["folder"]][["bucket", "base", "key"]].itertuples(index=False)]
        while open_folders:
            bucket, base, key = open_folders.pop()
            for info, child, is_folder in _children(base, key):
                if is_folder and deep:
                    open_folders.append((bucket, base, child))
                else:
                    rows.append(_row(bucket, base, info, child, is_folder))
                if len(rows) >= _BATCH:
                    yield _frame(rows)
                    rows = []
        if rows:
            yield _frame(rows)


def list_objects(
    spark: SparkSession, buckets: Sequence[tuple[str, str]], *, split_depth: int = 2, tasks: int | None = None
) -> DataFrame:
    """Inventory of ``(bucket, base URI)`` pairs, hidden folders included.

    Folders are opened level by level and dealt out again after each of the
    first ``split_depth`` levels, so one large bucket is listed by many tasks;
    each task then walks its folders and emits batches. A single folder is listed
    by one task: for buckets with very large flat folders use the inventory
    report of the storage (:func:`inventory_from`).
    """
    tasks = tasks or spark.sparkContext.defaultParallelism * 4
    units = spark.createDataFrame([(b, base, "", 0, None, True) for b, base in buckets], _UNIT_SCHEMA)
    for level in range(split_depth + 1):
        deep = level == split_depth
        units = units.repartition(tasks, "bucket", "key").mapInPandas(
            lambda batches, deep=deep: _expand(batches, deep), _UNIT_SCHEMA
        )
    return units.filter(~F.col("folder")).select("bucket", "key", "size", "last_modified")
