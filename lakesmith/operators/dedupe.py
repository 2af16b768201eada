"""Latest row per key and duplicate counts.

NULL keys count as equal here (unlike in the upsert).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import business_range, business_time
from .align import quoted, resolve_columns


def _sortable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _sortable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_sortable(f.dataType) for f in data_type)
    return not isinstance(data_type, (T.MapType, T.VariantType, T.NullType))


def _column_named(df: DataFrame, name: str | None) -> str | None:
    return next((c for c in df.columns if name and c.lower() == name.lower()), None)


def latest_per_key(
    df: DataFrame,
    key_cols: Sequence[str],
    version_col: str | None = "_extracted_at",
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """The row with the highest version per key, null versions last.

    Ties are settled by ``tie_cols`` (highest first), then by the remaining
    columns in order (lowest first), so the result does not depend on how the
    input is split. The rank filter runs before the shuffle as well
    (``WindowGroupLimit``): each map task sends at most one row per key, so a
    hot key costs as many rows as there are map tasks.
    """
    keys = resolve_columns(df.columns, key_cols)
    version = _column_named(df, version_col)
    ties = resolve_columns(df.columns, tie_cols or [])
    order = [quoted(c).desc_nulls_last() for c in dict.fromkeys([version, *ties]) if c]
    settled = {*keys, version, *ties}
    order += [
        quoted(f.name).asc_nulls_last()
        for f in df.schema
        if f.name not in settled and _sortable(f.dataType)
    ]
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*(order or [F.lit(0)]))
    return (
        df.withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )


def since_condition(df: DataFrame, date_col: str, since: dt.datetime | dt.date | str) -> Column:
    """Holds for dates at or after ``since`` (business wall clock); null when unreadable."""
    return business_range(quoted(date_col), df.schema[date_col].dataType, business_time(since))


def _keep_condition(df: DataFrame, date_col: str | None, since) -> Column | None:
    date = _column_named(df, date_col)
    if since is None or date is None:
        return None
    return since_condition(df, date, since)


def dedupe(
    df: DataFrame,
    key_cols: Sequence[str],
    version_col: str | None = "_extracted_at",
    date_col: str | None = "dt_atualz",
    since: dt.datetime | dt.date | str | None = "2023-01-01",
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Drop rows dated before ``since`` or without a date, then keep the latest per key.

    Beware of the default: a table with a column ``dt_atualz`` loses everything
    before 2023-01-01 and every row whose date is missing. Pass ``since=None``
    to keep all dates.
    """
    keep = _keep_condition(df, date_col, since)
    kept = df if keep is None else df.filter(keep)
    return latest_per_key(kept, key_cols, version_col, tie_cols)


def dedupe_counts(
    df: DataFrame,
    key_cols: Sequence[str],
    date_col: str | None = "dt_atualz",
    since: dt.datetime | dt.date | str | None = "2023-01-01",
) -> DataFrame:
    """One row ``before, after, removed, purged_pre, deduped`` for :func:`dedupe`.

    Counting needs no order: one aggregate per key with partial sums.
    """
    keys = resolve_columns(df.columns, key_cols)
    condition = _keep_condition(df, date_col, since)
    keep = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    per_key = (
        df.select(*[quoted(k) for k in keys], keep.alias("__keep"))
        .groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("__rows"), F.count_if("__keep").alias("__kept"))
    )
    zero = F.lit(0).cast("long")
    total = per_key.agg(
        F.coalesce(F.sum("__rows"), zero).alias("before"),
        F.count_if(F.col("__kept") > 0).alias("after"),
        F.coalesce(F.sum(F.col("__rows") - F.col("__kept")), zero).alias("purged_pre"),
    )
    return total.select(
        "before",
        "after",
        (F.col("before") - F.col("after")).alias("removed"),
        "purged_pre",
        (F.col("before") - F.col("purged_pre") - F.col("after")).alias("deduped"),
    )


def key_duplicates(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """One row ``total, unique, duplicates``; NULL keys are equal (``countDistinct`` skips them)."""
    keys = [quoted(k) for k in resolve_columns(df.columns, key_cols)]
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return per_key.agg(
        F.coalesce(F.sum("__rows"), F.lit(0).cast("long")).alias("total"),
        F.count(F.lit(1)).alias("unique"),
    ).select("total", "unique", (F.col("total") - F.col("unique")).alias("duplicates"))
