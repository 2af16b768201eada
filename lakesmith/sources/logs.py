"""Actions of table logs, read as JSON and Parquet without a connector.

Reads commit files and version-1 checkpoints of any number of tables in one
scan each. Checkpoints with a UUID in their name (version 2) are refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import glob_exists

_COMMIT_SCHEMA = """
    add struct<path string, size bigint, modificationTime bigint>,
    remove struct<path string, size bigint, deletionTimestamp bigint>,
    commitInfo struct<timestamp bigint>,
    protocol struct<minReaderVersion int>,
    metaData struct<id string>
"""
_CHECKPOINT_SCHEMA = """
    add struct<path string, size bigint, modificationTime bigint>,
    remove struct<path string, size bigint, deletionTimestamp bigint>
"""
ACTION_SCHEMA = """table string, version long, kind string, path string, size long,
    modification_time timestamp, deletion_time timestamp"""


def plain_path(uri: Column) -> Column:
    """Local URIs without their scheme, so that they equal the path they were read from."""
    return F.regexp_replace(uri, "^file:/+", "/")


def _table_and_version(df: DataFrame) -> DataFrame:
    source = F.col("_metadata.file_path")
    return df.select(
        "*",
        plain_path(F.substring_index(source, "/_delta_log/", 1)).alias("table"),
        F.substring_index(source, "/", -1).alias("file_name"),
    ).withColumn("version", F.regexp_extract("file_name", r"^(\d{20})\.", 1).try_cast("long"))


def _decoded(path: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def _action(kind: Column, path: Column, size: Column, changed: Column, removed: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        path.alias("path"),
        size.alias("size"),
        F.timestamp_millis(changed).alias("modification_time"),
        F.timestamp_millis(removed).alias("deletion_time"),
    )


def _file_action() -> Column:
    """The add or remove of a log line, null for other lines."""
    add, remove, none = F.col("add"), F.col("remove"), F.lit(None).cast("long")
    added = _action(F.lit("add"), _decoded(add["path"]), add["size"], add["modificationTime"], none)
    removed = _action(F.lit("remove"), _decoded(remove["path"]), remove["size"], none, remove["deletionTimestamp"])
    return F.when(add.isNotNull(), added).when(remove.isNotNull(), removed)


def _rows(df: DataFrame, *actions: Column) -> DataFrame:
    """One row per action that is not null."""
    found = F.filter(F.array(*actions), lambda a: a.isNotNull())
    return df.select("table", "version", F.explode(found).alias("a")).select("table", "version", "a.*")


def read_log_actions(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """``(table, version, kind, path, size, modification_time, deletion_time)``.

    State up to a table's last checkpoint comes from that checkpoint, later
    actions from the commits; every retained commit also yields rows of kind
    ``commit``, whose versions the history length counts.
    """
    roots = [t.rstrip("/") for t in tables]
    with ThreadPoolExecutor(16) as pool:
        with_log = list(pool.map(lambda r: glob_exists(spark, f"{r}/_delta_log/*.json"), roots))
        with_checkpoint = list(
            pool.map(lambda r: glob_exists(spark, f"{r}/_delta_log/*.checkpoint*"), roots)
        )
    logs = [r for r, found in zip(roots, with_log) if found]
    checkpointed = [r for r, found in zip(roots, with_checkpoint) if found]
    if not logs and not checkpointed:
        return spark.createDataFrame([], ACTION_SCHEMA)

    parts = []
    last = None
    if checkpointed:
        found = _table_and_version(
            spark.read.schema(_CHECKPOINT_SCHEMA).parquet(*[f"{r}/_delta_log/*.checkpoint*.parquet" for r in checkpointed])
        )
        version_1 = F.col("file_name").rlike(r"^\d{20}\.checkpoint(\.\d{10}\.\d{10})?\.parquet\z")
        message = F.concat(F.lit("unsupported checkpoint: "), F.col("file_name"))
        found = found.filter(F.when(version_1, True).otherwise(F.raise_error(message).cast("boolean")))
        last = found.groupBy("table").agg(F.max("version").alias("__last"))
        state = found.join(last, "table").filter(F.col("version") == F.col("__last"))
        parts.append(_rows(state, _file_action()))
    if logs:
        commits = _table_and_version(
            spark.read.schema(_COMMIT_SCHEMA).json([f"{r}/_delta_log/*.json" for r in logs])
        ).filter(F.col("file_name").rlike(r"^\d{20}\.json\z"))
        later = F.lit(True)
        if last is not None:
            commits = commits.join(last, "table", "left")
            later = F.col("__last").isNull() | (F.col("version") > F.col("__last"))
        none = F.lit(None).cast("long")
        commit = _action(F.lit("commit"), F.lit(None).cast("string"), none, none, none)
        # Both from one pass: a line is an action, and evidence of its commit.
        parts.append(_rows(commits, F.when(later, _file_action()), commit))
    actions = parts[0]
    for part in parts[1:]:
        actions = actions.unionByName(part)
    return actions


def read_log_files(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Commit and checkpoint files: ``(table, version, kind, last_modified)``; contents are not read."""
    roots = [t.rstrip("/") for t in tables if glob_exists(spark, f"{t.rstrip('/')}/_delta_log/*")]
    schema = "table string, version long, kind string, last_modified timestamp"
    if not roots:
        return spark.createDataFrame([], schema)
    files = (
        spark.read.format("binaryFile")
        .load([f"{r}/_delta_log/[0-9]*" for r in roots])
        .select("path", F.col("modificationTime").alias("last_modified"))
    )
    name = F.substring_index("path", "/", -1)
    kind = F.when(name.rlike(r"^\d{20}\.json\z"), "commit").when(
        name.rlike(r"^\d{20}\.checkpoint"), "checkpoint"
    )
    return files.select(
        plain_path(F.substring_index("path", "/_delta_log/", 1)).alias("table"),
        F.regexp_extract(name, r"^(\d{20})\.", 1).try_cast("long").alias("version"),
        kind.alias("kind"),
        "last_modified",
    ).filter("kind IS NOT NULL")
