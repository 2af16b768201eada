"""Maintenance candidates: files no table needs, commits past their retention.

The jobs report; deleting stays with the caller or the table format.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours an unreferenced file is kept, days a commit is kept.
RETENTION_HOURS = 168
LOG_RETENTION_DAYS = 30


def _moment(now: dt.datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def orphan_files(
    files: DataFrame,
    latest: DataFrame,
    now: dt.datetime | Column,
    *,
    retention_hours: int = RETENTION_HOURS,
    include_untracked: bool = False,
) -> DataFrame:
    """Stored files of tables that are no longer referenced and past the retention.

    ``files``: table, path, size, last_modified. ``latest``: the last action per
    file (see ``latest_actions``), or just the live files as table, path. A
    removed file ages from its removal, others from their last change. Without
    ``include_untracked`` only removed files are candidates.
    """
    cutoff = _moment(now) - F.make_interval(hours=F.lit(retention_hours))
    # A removal comes after the last change, so this holds for both and reaches the scan.
    old = files.filter(F.col("last_modified") < cutoff)
    if "live" not in latest.columns:
        return old.join(latest.select("table", "path"), ["table", "path"], "left_anti")
    states = latest.select(
        "table", "path", F.col("live").alias("__live"), F.col("deletion_time").alias("__removed")
    )
    tracked = old.join(states, ["table", "path"], "left" if include_untracked else "inner")
    unused = ~F.coalesce("__live", F.lit(False)) & F.coalesce(F.col("__removed") < cutoff, F.lit(True))
    return tracked.filter(unused).drop("__live", "__removed")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("table").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")
    )


def expired_commits(
    log_files: DataFrame, now: dt.datetime | Column, *, retention_days: int | None = None
) -> DataFrame:
    """Commit files older than the retention and below the table's last checkpoint.

    ``log_files``: table, version, kind ('commit' or 'checkpoint'), last_modified.
    The retention is at least one day.
    """
    days = LOG_RETENTION_DAYS if retention_days is None else max(1, int(retention_days))
    cutoff = _moment(now) - F.make_interval(days=F.lit(days))
    checkpoints = (
        log_files.filter(F.col("kind") == "checkpoint")
        .groupBy("table")
        .agg(F.max("version").alias("__checkpoint"))
    )
    commits = log_files.filter((F.col("kind") == "commit") & (F.col("last_modified") < cutoff))
    return (
        commits.join(checkpoints, "table")
        .filter(F.col("version") < F.col("__checkpoint"))
        .drop("__checkpoint")
    )


def maintenance_tally(results: DataFrame) -> DataFrame:
    """One row ``ok, failures, removed`` from ``(uri, removed, error)``."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    return results.agg(
        F.count_if(~failed).alias("ok"),
        F.count_if(failed).alias("failures"),
        F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removed"),
    )
