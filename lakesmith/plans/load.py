"""One incremental load cycle of a table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import business_range, wall_clock
from ..operators.align import quoted
from ..operators.cursor import cursor_windows, max_ts, run_state
from ..operators.dedupe import latest_per_key
from ..sinks.files import materialize
from ..sinks.tables import merge
from ..sources.control import RUN_EVENT_SCHEMA, close_run, open_run, run_events
from ..sources.storage import glob_exists


def in_window(df: DataFrame, column: str, from_ts: dt.datetime, to_ts: dt.datetime) -> DataFrame:
    """Rows whose business time lies in the closed window; the bounds reach the scan."""
    return df.filter(business_range(quoted(column), df.schema[column].dataType, from_ts, to_ts))


def incremental_load(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    *,
    project: str,
    table_name: str,
    keys: Sequence[str],
    watermark_col: str,
    run_log: str,
    now: dt.datetime,
    clean: Callable[[DataFrame], DataFrame] = lambda df: df,
    version_col: str | None = None,
    partition_col: str | None = None,
    run_id: str = "manual",
) -> int:
    """Read the open window of a source, clean it, merge it and move the cursor.

    The new watermark is the largest business time read, never the clock, so an
    empty window leaves the cursor where it is. Returns the merged rows.
    """
    config = spark.createDataFrame([(project, table_name, True)], "project string, table_name string, enabled boolean")
    events = run_events(spark, run_log) if glob_exists(spark, f"{run_log}/*.parquet") else None
    if events is None:
        events = spark.createDataFrame([], RUN_EVENT_SCHEMA)
    window = cursor_windows(config, run_state(events), now).first()
    log_id = open_run(
        spark, run_log, table_name, watermark_col, window["from_ts"], project=project, run_id=run_id, now=now
    )
    try:
        batch = materialize(in_window(source, watermark_col, window["from_ts"], window["to_ts"]), "batch")
        extracted = batch.count()
        latest = latest_per_key(clean(batch), keys, version_col or watermark_col)
        loaded = merge(latest, path, merge_keys=keys, partition_col=partition_col)
        peak = max_ts(batch, watermark_col).first()["max_ts"]
    except Exception as error:
        close_run(spark, run_log, log_id, "failed", error_message=str(error), now=now)
        raise
    close_run(spark, run_log, log_id, "success", extracted, loaded, watermark_to=peak, now=now)
    return loaded


def window_filter(df: DataFrame, column: str, windows: DataFrame) -> DataFrame:
    """Rows of several tables at once, each in its own window.

    ``df`` holds ``project, table_name`` next to the rows, ``windows`` comes from
    ``cursor_windows`` and has one row per table.
    """
    clock = wall_clock(quoted(column), df.schema[column].dataType)
    bounds = windows.select("project", "table_name", "from_ts", "to_ts")
    joined = df.join(bounds, ["project", "table_name"])
    return joined.filter(clock.between(F.col("from_ts"), F.col("to_ts"))).drop("from_ts", "to_ts")
