"""Writes that need no existing table state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_dir


def append_rows(spark: SparkSession, path: str, schema: str, *rows: dict[str, Any]) -> None:
    """Append a few driver-side rows; columns without a value are null."""
    names = T._parse_datatype_string(schema).fieldNames()
    frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
    frame.coalesce(1).write.mode("append").parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that is read several times to the shared scratch folder and read it back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
