"""Control tables: configuration and run log, from a database or from files."""

from __future__ import annotations

import datetime as dt
import secrets
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import BUSINESS_ZONE
from ..sinks.files import append_rows

RUN_EVENT_SCHEMA = """id long, event_seq int, status string, project string, table_name string,
    watermark_col string, extraction_type string, watermark_from timestamp, run_id string,
    started_at timestamp, finished_at timestamp, rows_extracted long, rows_loaded long,
    error_message string, watermark_to timestamp"""


def control_table(
    spark: SparkSession,
    name: str,
    *,
    jdbc_url: str | None = None,
    schema: str = "logs",
    properties: dict[str, str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """A control table over JDBC (filters are pushed to the database) or from Parquet."""
    if jdbc_url:
        return spark.read.jdbc(jdbc_url, f"{schema}.{name}", properties=properties or {})
    if path is None:
        raise ValueError("give jdbc_url or path")
    return spark.read.parquet(path)


def run_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_EVENT_SCHEMA).parquet(path)


def _instant(value: dt.datetime) -> dt.datetime:
    """An aware instant; a naive value is business wall clock."""
    from zoneinfo import ZoneInfo

    return value.replace(tzinfo=ZoneInfo(BUSINESS_ZONE)) if value.tzinfo is None else value


def _given(**names: Any) -> Any:
    """The value of an argument that has two names."""
    for value in names.values():
        if value is not None:
            return value
    raise TypeError("missing argument: " + " or ".join(names))


def open_run(
    spark: SparkSession,
    path: str,
    table_name: str,
    watermark_col: str | None = None,
    watermark_from: dt.datetime | None = None,
    extraction_type: str = "incremental",
    run_id: str = "manual",
    *,
    project: str,
    wm_col: str | None = None,
    from_ts: dt.datetime | None = None,
    now: dt.datetime | None = None,
) -> int:
    """Append the open event of a run and return its id."""
    column = _given(watermark_col=watermark_col, wm_col=wm_col)
    start = _given(watermark_from=watermark_from, from_ts=from_ts)
    log_id = secrets.randbits(62)
    append_rows(spark, path, RUN_EVENT_SCHEMA, {
        "id": log_id, "event_seq": 0, "status": "running", "project": project, "table_name": table_name,
        "watermark_col": column, "extraction_type": extraction_type, "watermark_from": _instant(start),
        "run_id": run_id, "started_at": now or dt.datetime.now(dt.timezone.utc),
    })
    return log_id


def close_run(
    spark: SparkSession,
    path: str,
    log_id: int,
    status: str,
    rows_extracted: int = 0,
    rows_loaded: int = 0,
    error_message: str | None = None,
    watermark_to: dt.datetime | None = None,
    *,
    now: dt.datetime | None = None,
) -> None:
    """Append the close event of a run; without ``watermark_to`` the cursor stays."""
    append_rows(spark, path, RUN_EVENT_SCHEMA, {
        "id": log_id, "event_seq": 1, "status": status, "rows_extracted": rows_extracted,
        "rows_loaded": rows_loaded, "error_message": error_message,
        "watermark_to": _instant(watermark_to) if watermark_to is not None else None,
        "finished_at": now or dt.datetime.now(dt.timezone.utc),
    })
