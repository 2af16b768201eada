"""Health snapshots kept between runs, and exported run records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import partition_folders
from .tables import open_table

RUN_SCHEMA = """dag_id string, dag_run_id string, run_id string, run_type string, triggered_by string,
    external_trigger boolean, start_date timestamp, end_date timestamp, state string"""


def save_snapshot(df: DataFrame, path: str, ts: dt.datetime) -> None:
    """Append a snapshot taken at ``ts``, in the folder of its day."""
    stamped = df.withColumn("ts", F.lit(ts)).withColumn("day", F.lit(ts.date().isoformat()))
    stamped.write.mode("append").partitionBy("day").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, before: dt.datetime | None = None) -> DataFrame | None:
    """The rows of the newest snapshot (before an instant), ``None`` without any.

    Days are tried from the newest folder on, and only that day's times are read.
    """
    table = open_table(spark, path)
    if table is None:
        return None
    for day in sorted(partition_folders(spark, path, "day"), reverse=True):
        rows = table.filter(F.col("day") == day)
        if before is not None:
            if day > before.date().isoformat():
                continue
            rows = rows.filter(F.col("ts") < F.lit(before))
        newest = rows.agg(F.max("ts")).first()[0]
        if newest is not None:
            return rows.filter(F.col("ts") == F.lit(newest)).drop("day")
    return None


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records exported as JSON lines."""
    runs = spark.read.schema(RUN_SCHEMA).json(path)
    return runs.withColumn("run_id", F.coalesce("dag_run_id", "run_id")).drop("dag_run_id")
