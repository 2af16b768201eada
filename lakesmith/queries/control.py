"""Cursors, run log, failure and growth reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.dates import ntz_literal
from ..operators import align, cursor, report
from ..operators.health import with_growth
from ..plans.load import incremental_load, window_filter
from ..session import scratch_dir
from ..sources.snapshots import latest_snapshot, save_snapshot
from ..sources.tables import open_table
from .inputs import load, sql

_NOW = dt.datetime(2024, 1, 31)


def last_watermark(spark, sf):
    """A3, L2: per table the watermark of the success that finished last."""
    return cursor.last_watermarks(load(spark, sf, "run_log"))


_LAST = """
    SELECT project, table_name, watermark_to, finished_at FROM {run_log}
    WHERE status = 'success' AND watermark_to IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY project, table_name ORDER BY finished_at DESC, id DESC) = 1"""


def cursor_windows(spark, sf):
    """The read window of every enabled table."""
    return cursor.cursor_windows(load(spark, sf, "table_config"), load(spark, sf, "run_log"), _NOW)


_WINDOWS = f"""
    SELECT c.project, c.table_name,
           coalesce(l.watermark_to - INTERVAL '10' MINUTE, TIMESTAMP '{_NOW}' - INTERVAL '25' HOUR) AS from_ts,
           TIMESTAMP '{_NOW}' AS to_ts, l.watermark_to IS NULL AS first_run
    FROM {{table_config}} c LEFT JOIN ({_LAST}) l ON c.project = l.project AND c.table_name = l.table_name
    WHERE c.enabled"""


def load_window(spark, sf):
    """Rows of all tables inside their windows, in one pass."""
    windows = cursor.cursor_windows(load(spark, sf, "table_config"), load(spark, sf, "run_log"), _NOW)
    rows = load(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("project"),
        F.concat(F.lit("tb_"), F.col("user_id")).alias("table_name"), "event_id", "ts", "value",
    )
    return window_filter(rows, "ts", windows)


LOAD_WINDOW = f"""
    WITH w AS ({_WINDOWS})
    SELECT w.project, w.table_name, event_id, ts, value FROM events e
    JOIN w ON w.project = 'p' || (e.user_id % 5) AND w.table_name = 'tb_' || e.user_id
    WHERE ts BETWEEN from_ts AND to_ts"""


def enabled_tables(spark, sf):
    """Enabled tables with a path, of all projects."""
    return cursor.list_tables(load(spark, sf, "table_config"))


ENABLED_TABLES = """
    SELECT table_name, delta_bronze_path AS path FROM {table_config}
    WHERE enabled AND trim(delta_bronze_path) <> ''"""

# Each event opens a run; all but the signups close it, some of them twice.
_RUN_EVENTS = """
    SELECT event_id AS id, 0 AS event_seq, 'running' AS status, 'p' || (user_id % 5) AS project,
           'tb_' || user_id AS table_name, 'ts' AS watermark_col, 'incremental' AS extraction_type,
           ts - INTERVAL '1' DAY AS watermark_from, 'run_' || event_id AS run_id, ts AS started_at,
           CASE WHEN 1 = 0 THEN ts END AS finished_at, CASE WHEN 1 = 0 THEN user_id END AS rows_extracted,
           CASE WHEN 1 = 0 THEN user_id END AS rows_loaded, CASE WHEN 1 = 0 THEN props END AS error_message,
           CASE WHEN 1 = 0 THEN ts END AS watermark_to
    FROM {events}
    UNION ALL
    SELECT event_id, 1, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, NULL, NULL, NULL, NULL,
           NULL, NULL, NULL, ts + INTERVAL '5' MINUTE, user_id, user_id % 10,
           CASE WHEN event_type = 'error' THEN props END, CASE WHEN event_type = 'click' THEN ts END
    FROM {events} WHERE event_type <> 'signup'
    UNION ALL
    SELECT event_id, 2, 'failed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, ts + INTERVAL '9' MINUTE, user_id, 0,
           'closed again', NULL
    FROM {events} WHERE event_type = 'view'"""


def run_state(spark, sf):
    """One row per run from its events."""
    return cursor.run_state(spark.sql(_RUN_EVENTS, events=load(spark, sf, "events")))


RUN_STATE = """
    SELECT event_id AS id, 'p' || (user_id % 5) AS project, 'tb_' || user_id AS table_name, 'ts' AS watermark_col,
           'incremental' AS extraction_type, ts - INTERVAL '1' DAY AS watermark_from, 'run_' || event_id AS run_id,
           ts AS started_at,
           CASE event_type WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'failed'
                ELSE 'success' END AS status,
           CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN ts + INTERVAL '9' MINUTE
                ELSE ts + INTERVAL '5' MINUTE END AS finished_at,
           CASE WHEN event_type <> 'signup' THEN user_id END AS rows_extracted,
           CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN 0 ELSE user_id % 10 END AS rows_loaded,
           CASE event_type WHEN 'error' THEN props WHEN 'view' THEN 'closed again' END AS error_message,
           CASE WHEN event_type = 'click' THEN ts END AS watermark_to
    FROM events"""


def max_business_ts(spark, sf):
    """A2: the latest readable business time of a text column."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    text = F.when(F.col("o_orderstatus") == "P", "sem data").otherwise(day)
    return cursor.max_ts(load(spark, sf, "orders").select(text.alias("ts")), "ts")


MAX_BUSINESS_TS = "SELECT max(o_orderdate) AS max_ts FROM orders WHERE o_orderstatus <> 'P'"


def _failed(spark, sf):
    return report.failed_runs(
        load(spark, sf, "run_records"), ntz_literal(_NOW), lookback_hours=240, exclude=["dag_3", "dag_4"]
    )


def failed_runs(spark, sf):
    """Failed runs of ten days with their trigger."""
    return report.with_trigger(_failed(spark, sf)).select("dag_id", "run_id", "start_date", "trigger")


_FAILED = f"""
    SELECT *, CASE lower(trim(run_type)) WHEN 'scheduled' THEN 'agendado' WHEN 'manual' THEN 'manual'
                   WHEN 'backfill' THEN 'backfill'
                   ELSE CASE WHEN triggered_by = 'UI' THEN 'manual' WHEN run_type = '' THEN 'outro'
                             ELSE run_type END END AS trig
    FROM {{run_records}}
    WHERE state = 'failed' AND start_date >= TIMESTAMP '{_NOW}' - INTERVAL '240' HOUR
      AND dag_id NOT IN ('dag_3', 'dag_4')"""
FAILED_RUNS = f'SELECT dag_id, run_id, start_date, trig AS "trigger" FROM ({_FAILED})'


def failures_by_trigger(spark, sf):
    """A10."""
    return report.failures_by_trigger(_failed(spark, sf))


FAILURES_BY_TRIGGER = f"""
    SELECT count(*) FILTER (WHERE trig = 'manual') AS manual, count(*) FILTER (WHERE trig = 'agendado') AS agendado,
           count(*) FILTER (WHERE trig NOT IN ('manual', 'agendado')) AS outro FROM ({_FAILED})"""


def failure_rows(spark, sf):
    """L4: the newest failures and the closing line."""
    return report.failure_rows(_failed(spark, sf))


FAILURE_ROWS = f"""
    WITH f AS ({_FAILED}),
    r AS (SELECT *, row_number() OVER (ORDER BY start_date DESC, dag_id, run_id) AS n FROM f)
    SELECT CAST(n AS INT) AS line_no, 'Falha ' || trig || ' · ' || dag_id AS label,
           'run_id=' || run_id || ' · fim=' || regexp_replace(CAST(end_date AS VARCHAR), '\\.?0+$', '') AS detail
    FROM r WHERE n <= 40
    UNION ALL
    SELECT 41, 'Falhas (truncado)', 'exibindo 40 de ' || count(*) FROM f HAVING count(*) > 40"""


def _bucket_lines(spark, sf):
    return load(spark, sf, "bucket_metrics").withColumn("target", F.concat(F.lit("s3a://"), "bucket"))


def growth_lines(spark, sf):
    """One line per bucket."""
    return report.growth_rows(_bucket_lines(spark, sf))


GROWTH_LINES = """
    WITH b AS (SELECT *, 's3a://' || bucket AS target, greatest(total_bytes, 0) AS size FROM {bucket_metrics})
    SELECT target, target AS label,
           CASE WHEN size < 1024 THEN size || ' B'
                WHEN size < 1024 ** 2 THEN printf('%.1f KiB', size / 1024.0::DOUBLE)
                WHEN size < 1024 ** 3 THEN printf('%.1f MiB', size / (1024.0::DOUBLE ** 2))
                ELSE printf('%.1f GiB', size / (1024.0::DOUBLE ** 3)) END
           || ' · ' || object_count || ' objs · Δ '
           || CASE WHEN growth_pct IS NULL THEN 'sem base anterior'
                   ELSE (CASE WHEN growth_pct > 0 THEN '+' ELSE '' END) || printf('%.1f%%', growth_pct) END
           || CASE WHEN loose_pct > 0 THEN printf('; loose=%.1f%%', loose_pct) ELSE '' END
           || CASE WHEN growth_pct >= 40 THEN ' [acima do limiar]' ELSE '' END AS detail,
           coalesce(growth_pct >= 40, false) AS above_limit
    FROM b"""


def growth_summary(spark, sf):
    """Totals of the growth report, with the alert count of the events of type error."""
    alerts = load(spark, sf, "events").filter("event_type = 'error'")
    return report.growth_summary(_bucket_lines(spark, sf), alerts, 10.0)


GROWTH_SUMMARY = """
    SELECT count(*) AS bucket_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
           CAST(sum(object_count) AS BIGINT) AS total_objects, count(*) FILTER (WHERE growth_pct >= 10) AS growth_warns,
           (SELECT count(*) FROM events WHERE event_type = 'error') AS health_alert_count
    FROM {bucket_metrics}"""


def snapshot_growth(spark, sf):
    """Balances per nation against a stored snapshot of the suppliers."""
    path = scratch_dir(spark, "snapshot")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).alias("total_bytes")
    before = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(cents("s_acctbal"))
    save_snapshot(before.withColumn("total_bytes", F.lit(1).cast("long")), path, dt.datetime(2024, 1, 1))
    save_snapshot(before, path, dt.datetime(2024, 1, 2))
    now = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(cents("c_acctbal"))
    return with_growth(now, latest_snapshot(spark, path), "nation", "total_bytes")


SNAPSHOT_GROWTH = """
    WITH p AS (SELECT s_nationkey AS nation, sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS b FROM supplier GROUP BY 1),
    c AS (SELECT c_nationkey AS nation, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total_bytes
          FROM customer GROUP BY 1)
    SELECT c.nation, total_bytes,
           CASE WHEN b IS NULL THEN NULL WHEN b <= 0 THEN CASE WHEN total_bytes > 0 THEN 100.0 END
                ELSE (CAST(total_bytes AS DOUBLE) - CAST(b AS DOUBLE)) / CAST(b AS DOUBLE) * 100.0 END AS growth_pct
    FROM c LEFT JOIN p ON c.nation = p.nation"""



def load_cycle(spark, sf):
    """Two incremental loads, the second continuing from the first one's watermark."""
    path, log = scratch_dir(spark, "cycle"), scratch_dir(spark, "cycle-log")
    for day in (10, 12):
        incremental_load(
            spark, load(spark, sf, "events"), path, project="p", table_name="events", keys=["user_id", "event_type"],
            watermark_col="ts", run_log=log, now=dt.datetime(2024, 1, day),
        )
    return open_table(spark, path).select("user_id", "event_type", "ts", "event_id", "value")


LOAD_CYCLE = """
    WITH bounds AS (
      SELECT TIMESTAMP '2024-01-10' - INTERVAL '25' HOUR AS lo, TIMESTAMP '2024-01-10' AS mid,
             TIMESTAMP '2024-01-12' AS hi)
    SELECT user_id, event_type, ts, event_id, value FROM events, bounds
    WHERE ts BETWEEN lo AND hi
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1"""


def business_timestamps(spark, sf):
    """Zoned instants become business wall clock, untyped columns text."""
    df = load(spark, sf, "events").select(
        "event_id", "ts", F.lit(None).alias("untyped"),
        F.concat(F.col("ts").cast("string"), F.lit(" UTC")).cast("timestamp").alias("instant"),
    )
    return align.coerce_void_fields(align.business_timestamps_to_ntz(df))


BUSINESS_TIMESTAMPS = """
    SELECT event_id, ts, timezone('America/Sao_Paulo', timezone('UTC', ts)) AS instant,
           CAST(NULL AS VARCHAR) AS untyped FROM events"""

QUERIES = {
    "load_cycle": (load_cycle, LOAD_CYCLE),
    "business_timestamps": (business_timestamps, BUSINESS_TIMESTAMPS),
    "last_watermark": (last_watermark, sql(_LAST)),
    "cursor_windows": (cursor_windows, sql(_WINDOWS)),
    "load_window": (load_window, sql(LOAD_WINDOW)),
    "enabled_tables": (enabled_tables, sql(ENABLED_TABLES)),
    "run_state": (run_state, RUN_STATE),
    "max_business_ts": (max_business_ts, MAX_BUSINESS_TS),
    "failed_runs": (failed_runs, sql(FAILED_RUNS)),
    "failures_by_trigger": (failures_by_trigger, sql(FAILURES_BY_TRIGGER)),
    "failure_rows": (failure_rows, sql(FAILURE_ROWS)),
    "growth_lines": (growth_lines, sql(GROWTH_LINES)),
    "growth_summary": (growth_summary, sql(GROWTH_SUMMARY)),
    "growth": (snapshot_growth, SNAPSHOT_GROWTH),
}
