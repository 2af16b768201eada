"""Table statistics from the actions of table logs.

``actions``: table, version, kind ('add', 'remove', 'commit'), path, size,
modification_time, deletion_time - one row per log action, of any number of
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: histories from here on raise the alert of a full inventory.
HISTORY_CAP = 500


def latest_actions(actions: DataFrame) -> DataFrame:
    """Per data file its last action; an add wins over a remove in the same version.

    The order fits one number, so the aggregate is a hash aggregate over plain
    values, combined before the shuffle.
    """
    order = F.col("version") * 2 + (F.col("kind") == "add").cast("int")
    values = ("size", "modification_time", "deletion_time")
    return (
        actions.filter(F.col("kind").isin("add", "remove"))
        .withColumn("__order", order)
        .groupBy("table", "path")
        .agg(F.max("__order").alias("__last"), *[F.max_by(v, "__order").alias(v) for v in values])
        .select(
            "table",
            "path",
            F.shiftright("__last", 1).alias("version"),
            (F.col("__last") % 2 == 1).alias("live"),
            *values,
        )
    )


def live_files(actions: DataFrame) -> DataFrame:
    return latest_actions(actions).filter("live").drop("live", "deletion_time")


def tombstones(actions: DataFrame) -> DataFrame:
    """Files whose last action removed them, with the time of the removal."""
    return latest_actions(actions).filter(~F.col("live")).select("table", "path", "deletion_time")


def table_stats(
    actions: DataFrame, tables: DataFrame | None = None, history_limit: int | None = None
) -> DataFrame:
    """One row per table: version, live files, bytes, mean file size, history length.

    ``tables`` (column ``table``) adds rows with ``is_delta = false`` for tables
    without a log. The history is the number of retained
    versions, at most ``history_limit`` if one is given.
    """
    files = (
        latest_actions(actions)
        .groupBy("table")
        .agg(
            F.count_if("live").alias("num_files"),
            F.sum(F.when(F.col("live"), F.coalesce("size", F.lit(0))).otherwise(0)).alias("size_bytes"),
        )
    )
    versions = (
        actions.groupBy("table", "version")
        .agg(F.bool_or(F.col("kind") == "commit").alias("has_commit"))
        .groupBy("table")
        .agg(F.max("version").alias("version"), F.count_if("has_commit").alias("history_len"))
    )
    stats = versions.join(files, "table", "left")
    if tables is not None:
        stats = tables.select("table").distinct().join(stats, "table", "left")
    zero = F.lit(0).cast("long")
    history = F.coalesce("history_len", zero)
    if history_limit is not None:
        history = F.least(history, F.lit(history_limit).cast("long"))
    stats = stats.select(
        "table",
        F.col("version").isNotNull().alias("is_delta"),
        F.col("version").cast("long").alias("version"),
        F.coalesce("num_files", zero).alias("num_files"),
        history.alias("history_len"),
        F.coalesce("size_bytes", zero).cast("long").alias("size_bytes"),
    )
    mean = F.when(
        (F.col("num_files") > 0) & (F.col("size_bytes") > 0), F.col("size_bytes") / F.col("num_files")
    )
    return stats.withColumn("avg_file_bytes", mean)
