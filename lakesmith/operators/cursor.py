"""Incremental-load cursors from the table configuration and the run log.

``config``: project, table_name, enabled, path, ...
``runs``:   id, project, table_name, status, watermark_to, finished_at, ...
Timestamps of the run log are UTC instants; windows are business wall clock.
The clock is an argument.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_sp, business_time, ntz_literal, wall_clock
from .align import quoted

# Hours read on the first run, minutes read again on later ones.
DEFAULT_LOOKBACK_HOURS = 25
SAFETY_OVERLAP_MINUTES = 10

# Columns an open event sets, and those a close event sets.
OPEN_FIELDS = (
    "project", "table_name", "watermark_col", "extraction_type", "watermark_from", "run_id", "started_at",
)
CLOSE_FIELDS = ("finished_at", "rows_extracted", "rows_loaded", "error_message", "watermark_to")


def max_ts(df: DataFrame, column: str) -> DataFrame:
    """One row ``max_ts``: the latest business wall clock; unreadable values are ignored."""
    clock = wall_clock(quoted(column), df.schema[column].dataType)
    return df.agg(F.max(clock).alias("max_ts"))


def enabled_tables(config: DataFrame, project: str | None = None) -> DataFrame:
    if project is not None:
        config = config.filter(F.col("project") == project)
    return config.filter(F.col("enabled"))


def table_config(config: DataFrame, table_name: str, project: str | None = None) -> DataFrame:
    """The enabled configuration row of a table; an error when there is none, or more than one."""
    row = enabled_tables(config, project).filter(F.col("table_name") == table_name)
    found = row.limit(2).count()
    if found != 1:
        raise ValueError(f"{'several' if found else 'no'} enabled configurations of table {table_name}")
    return row


def list_tables(config: DataFrame, project: str | None = None, path_col: str = "delta_bronze_path") -> DataFrame:
    """``(table_name, path)`` of enabled rows with a path, by name."""
    return (
        enabled_tables(config, project)
        .filter(F.trim(path_col) != "")
        .select("table_name", F.col(path_col).alias("path"))
        .orderBy("table_name")
    )


def last_watermarks(runs: DataFrame) -> DataFrame:
    """Per table the watermark of the success that finished last.

    The latest finish counts, not the largest watermark: a late backfill moves
    the cursor back. Successes without a watermark do not move it.
    """
    latest = F.max(F.struct("finished_at", "id", "watermark_to")).alias("last")
    return (
        runs.filter((F.col("status") == "success") & F.col("watermark_to").isNotNull())
        .groupBy("project", "table_name")
        .agg(latest)
        .select("project", "table_name", "last.watermark_to", "last.finished_at")
    )


def cursor_windows(
    config: DataFrame,
    runs: DataFrame,
    now: dt.datetime | Column,
    *,
    lookback_hours: int = DEFAULT_LOOKBACK_HOURS,
    overlap_minutes: int = SAFETY_OVERLAP_MINUTES,
) -> DataFrame:
    """``(project, table_name, from_ts, to_ts, first_run)`` of every enabled table at once."""
    to_ts = now if isinstance(now, Column) else ntz_literal(business_time(now))
    last = last_watermarks(runs)
    zoned = isinstance(runs.schema["watermark_to"].dataType, T.TimestampType)
    since_last = as_sp("watermark_to", zoned) - F.make_interval(mins=F.lit(overlap_minutes))
    first = to_ts - F.make_interval(hours=F.lit(lookback_hours))
    return (
        enabled_tables(config)
        .select("project", "table_name")
        .join(last, ["project", "table_name"], "left")
        .select(
            "project",
            "table_name",
            F.coalesce(since_last, first).alias("from_ts"),
            to_ts.alias("to_ts"),
            F.col("watermark_to").isNull().alias("first_run"),
        )
    )


def run_state(events: DataFrame) -> DataFrame:
    """One row per run from its open and close events.

    Events hold ``id, event_seq, status`` and the columns of either kind; an
    open event has the status ``running``. A later event of a kind wins.
    """
    opened = F.col("status") == "running"
    seq = F.col("event_seq")
    open_row = F.max(F.when(opened, F.struct(seq, *OPEN_FIELDS)))
    close_row = F.max(F.when(~opened, F.struct(seq, "status", *CLOSE_FIELDS)))
    per_run = events.groupBy("id").agg(open_row.alias("o"), close_row.alias("c"))
    return per_run.select(
        "id",
        *[F.col(f"o.{f}") for f in OPEN_FIELDS],
        F.coalesce("c.status", F.lit("running")).alias("status"),
        *[F.col(f"c.{f}") for f in CLOSE_FIELDS],
    )
