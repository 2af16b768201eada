"""Path-addressed tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.align import quoted, resolve_columns

_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "DELTA_MISSING", "DELTA_TABLE_NOT_FOUND", "DELTA_PATH")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the duration of a block; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def open_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame | None:
    """The table at a path, or ``None`` when there is none.

    Without a schema the partition columns of a Parquet table are text, so that
    a value such as ``007`` survives.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        with settings(spark, spark__sql__sources__partitionColumnTypeInference__enabled="false"):
            return reader.load(path)
    except AnalysisException as error:
        if (error.getCondition() or "").startswith(_ABSENT):
            return None
        raise


def is_table(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    return open_table(spark, path, fmt) is not None


def count_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> int:
    """Row count from the file footers, 0 for an absent table."""
    table = open_table(spark, path, fmt)
    return 0 if table is None else table.count()


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Only the named columns; names match without regard to case."""
    table = open_table(spark, path, fmt)
    if table is None:
        raise RuntimeError(f"table not found: {path}")
    return table.select(*[quoted(c) for c in resolve_columns(table.columns, columns)])
